"""Orders decided without one window or one join over all rows."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricesieve.operators import dedup, explore

SCHEMA = "row_id long, product_name string, price string, provider string, description string"


def test_running_totals_of_sparse_ids(spark):
    """Ids 2^30 apart give as many ranges as there are shuffle partitions, not one a row."""
    ids = [i << 30 for i in range(300)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, (i >> 30) % 7) for i in ids], "id long, n long")
    out = explore.running_totals(df, "id", {"rank": F.lit(1), "total": F.col("n")})
    total, want = 0, []
    for k in range(300):
        total += k % 7
        want.append((k << 30, k % 7, k + 1, total))
    assert sorted(map(tuple, out.collect())) == want
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert explore.running_totals(df.limit(0), "id", {"rank": F.lit(1)}).collect() == []


def test_running_totals_go_by_lead_first(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, g long")
    out = explore.running_totals(df, "id", {"rank": F.lit(1)}, lead=-F.col("g")).collect()
    order = sorted(range(100), key=lambda i: (-(i % 3), i))
    assert {r.id: r["rank"] for r in out} == {i: k + 1 for k, i in enumerate(order)}


def _greedy(n, edges):
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    heads = set()
    for i in range(n):
        if not near[i] & heads:
            heads.add(i)
    return heads


def test_leader_signatures_against_the_greedy_loop(spark):
    rng = random.Random(2)
    for n, m in ((60, 120), (40, 0)):
        pairs = {tuple(rng.sample(range(n), 2)) for _ in range(m)}
        edges = sorted({(min(p), max(p)) if rng.random() < 0.5 else (max(p), min(p)) for p in {tuple(sorted(p)) for p in pairs}})
        nodes = spark.createDataFrame([(str(i), (0.0, i)) for i in range(n)], "sig_id string, first struct<q:double,r:long>")
        table = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "s1 string, s2 string")
        got = {int(r.sig_id) for r in dedup.leader_signatures(nodes, table).collect()}
        assert got == _greedy(n, edges)


def test_rounds_read_only_open_edges(spark, monkeypatch):
    """A path of similar signatures takes a round for two of them, and the edges fall each round."""
    read = []
    plain = dedup.materialize

    def counted(df):
        out = plain(df)
        if out.columns == ["a", "b"] or out.columns == ["b", "a"]:
            read.append(out.count())
        return out

    monkeypatch.setattr(dedup, "materialize", counted)
    nodes = spark.createDataFrame([(str(i), (0.0, i)) for i in range(8)], "sig_id string, first struct<q:double,r:long>")
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(7)], "s1 string, s2 string")
    got = {r.sig_id for r in dedup.leader_signatures(nodes, edges).collect()}
    assert got == {"0", "2", "4", "6"}
    assert read == [7, 5, 3, 1, 0]


def test_rows_of_a_signature_that_is_not_similar_to_itself(spark):
    """Rows without a provider score 0.7 with their like (no duration): all lead at 0.8.  Followers
    of another signature's leader are those processed after it."""
    rows = [(1, "Red Widget", "$10", "", ""), (2, "Red Widget", "$10", "", ""), (3, "Red Widget", "$10", "Acme", ""),
            (4, "Red Widget", "$10", "Acme", "")]
    got = {r.row_id: r.leader_id for r in dedup.dedup_leaders(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert got[1] == 1 and got[2] == 2 and got[3] == got[4]
