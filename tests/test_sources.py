"""Archive partition pruning, clearing, and column pruning at the scan."""
from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from pricesieve.plans.fixtures import fixture
from pricesieve.sources import archive, export
from pricesieve.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_archive_prunes_and_clears(spark):
    arch = fixture(spark, SF, "fx_archive")
    path = export.export_dir(spark, "test-archive")
    archive.write(arch, path)
    urls = ["https://shop.example.com/c/2", "https://shop.example.com/c/4"]
    back = archive.read(spark, path, urls)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", _plan(back))
    assert {r.url for r in back.collect()} == {u for u in urls if arch.filter(F.col("url") == u).count()}
    archive.clear(spark, path, back.schema)
    assert spark.read.parquet(path).count() == 0


def test_one_scrape_per_url(spark):
    """The first scrape of a URL in a batch stays, with force the last; none without products."""
    schema = "url string, ts string, products array<string>, chunks array<string>"
    new = spark.createDataFrame([("u", "3", ["c"], ["z"]), ("u", "2", ["b"], ["y"]), ("u", "1", [], ["x"]), ("v", "1", None, ["w"])], schema)
    old = new.filter("false").select(F.lit("").alias("scrape_id"), "url", "ts", "products")
    for force, ts, chunks in ((False, "2", ["y"]), (True, "3", ["z"])):
        assert [(r.url, r.ts, r.chunks) for r in archive.upsert(old, new, force).collect()] == [("u", ts, chunks)]


def test_scan_reads_only_needed_columns(spark):
    df = read_table(spark, SF, "pages").select("page_id", F.length("url").alias("n")).filter(F.col("page_id") > 3)
    plan = _plan(df)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in plan


def test_large_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Signatures of files over the limit come from splits of them, with the answers of whole reads."""
    import gzip
    body = bytes(range(256)) * 400
    files = {"a.pdf": b"%PDF-1.4\n" + body, "b.bin": body + b"\n%PDF", "c.bin": b"\n%PDF" + body, "d.bin": b"%PD\n" + body,
             "e.pdf.gz": gzip.compress(b"%PDF" + os.urandom(90000)), "f.pdf": b"%PDF" + b"\xff\x00" * 60000, "g.bin": b"%PD", "h.pdf": b"%PDF",
             "j k.pdf": b"%PDF\r" + body}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), data[:4] == b"%PDF") for name, data in files.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for limit in (1 << 26, 1000):
            monkeypatch.setattr(export, "WHOLE_BYTES", limit)
            got = export.binary_catalogue(spark, f"{tmp_path}/*")
            assert {r.file: (r.length, r.is_pdf) for r in got.collect()} == want
        lines = spark.read.option("lineSep", "\n").text(f"{tmp_path}/*")
        assert lines.select(F.input_file_name().alias("f"), F.spark_partition_id().alias("p")).filter("f like '%b.bin'") \
            .distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
