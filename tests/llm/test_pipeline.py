"""The pipeline against a brute-force version, stage by stage."""
from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from pricesieve.llm import golay_simhash, line_crf, line_quality
from pricesieve.llm.common import staged
from tests.llm.test_operators import _components, _fingerprint, check_packing
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
    ids = {n: sorted(r.doc_id for r in b.select("doc_id").distinct().collect()) for n, (_, b) in seen.items()}
    before, after = seen["quality_rules"]
    con = duck(SF)
    kept = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({line_quality.ORACLE}) WHERE kept").fetchall())
    assert ids["quality_rules"] == kept and after.columns == before.columns
    before, after = seen["quality_classifier"]
    model = line_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.orderBy("doc_id").collect()
    scores = line_crf.score_documents(model, [r.text for r in rows])
    assert ids["quality_classifier"] == [r.doc_id for r, s in zip(rows, scores) if s >= 0.3] and after.columns == before.columns
    before, after = seen["near_dedup"]
    fps = {r.doc_id: _fingerprint(r.text) for r in before.collect()}
    want = _components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= golay_simhash.MAX_DISTANCE)
    assert ids["near_dedup"] == sorted(set(want.values())) and after.columns == before.columns
    before, after = seen["packing"]
    rows = after.collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in before.collect()])
    assert used <= 1.03 * -(-sum(r.length for r in rows) // 2048) + 2


def test_oracles(spark):
    con, queries, oracle = duck(SF), entry.queries(), entry.oracle_sql()
    for key in ("op3_url_rules", "op10_quality_rules"):
        r = compare(spark, con, SF, key, queries[key], oracle[key])
        assert r.get("ok"), r


def test_every_operator_is_registered():
    names = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
