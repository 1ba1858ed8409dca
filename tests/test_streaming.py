"""The stateless page operators run on a stream of stored pages."""
from __future__ import annotations

import tempfile

from pricesieve.sources.tables import read_table
from pricesieve.streaming import pages as sp


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="pricesieve-stream-src-")
    out = tempfile.mkdtemp(prefix="pricesieve-stream-out-")
    ck = tempfile.mkdtemp(prefix="pricesieve-stream-ck-")
    batch = read_table(spark, "/root/testdata/sf0.001", "pages")
    batch.repartition(3).write.mode("overwrite").parquet(src + "/in")
    q = sp.start(sp.page_chunks(sp.page_stream(spark, src + "/in")), out + "/chunks", ck + "/c")
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/chunks")
    exp = sp.page_chunks(batch)
    assert got.count() == exp.count()
    assert got.exceptAll(exp.select(*got.columns)).count() == 0
