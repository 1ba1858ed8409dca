"""Indicators over the joined text of a site against plain Python, and the containment join."""
from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import verify

PHRASES = ["service include", "price from $5", "package", "plans", "free trial", "choose between", "option available",
           "hour session $40", "prices   start \n at 12", "nothing here", "gold plan", "words and words", "x" * 70]


def _pages(seed):
    rng = random.Random(seed)
    rows, key = [], 0
    for url in ("a", "b", "c"):
        words = " ".join(rng.choice(PHRASES) for _ in range(60)).split(" ")
        while words:
            n = rng.randint(0, 4)
            rows.append((key, url, " ".join(words[:n])))
            words = words[n:]
            key += rng.choice([1, 1, 5000])
    return rows + [(key + 1, "d", None), (key + 2, "d", ""), (key + 3, "e", "free  quote")]


def _expected(rows, names):
    out = []
    for url in {r[1] for r in rows}:
        text = " ".join(t or "" for _, u, t in sorted(rows) if u == url)
        for i, (p, kind) in enumerate(K.PRODUCT_INDICATORS):
            for m in re.finditer(p, text, re.IGNORECASE):
                context = text[max(0, m.start() - 100):m.end() + 100]
                if not any(n in context.lower() for u, n in names if u == url and n):
                    out.append((url, i, kind, m.group(0), context, m.start()))
    return sorted(out)


@pytest.mark.parametrize("block", [256, 4096])
def test_page_indicators(spark, block):
    rows = _pages(block)
    names = [("a", "gold plan"), ("b", "x" * 70), ("b", ""), ("e", "nothing")]
    chunks = spark.createDataFrame(rows, "chunk_id long, url string, text string")
    products = spark.createDataFrame(names, "source_url string, product_name string")
    got = sorted(tuple(r) for r in verify.page_indicators(chunks, products, block=block).select(
        "url", "indicator_no", "type", "match", "context", "position").collect())
    want = _expected(rows, names)
    assert got == want and len(want) > 50
    # matches that lie in no single chunk
    whole = {m for u, i, _, m, *_ in want}
    assert any(not any(m in (t or "") for _, _, t in rows) for m in whole)


def test_page_blocks_hold_the_text_once(spark):
    rows = _pages(3)
    blocks = verify.page_blocks(spark.createDataFrame(rows, "chunk_id long, url string, text string"), block=100).collect()
    for url in "abce":
        own = sorted((b.block, b.text) for b in blocks if b.url == url)
        assert "".join(t for _, t in own) == " ".join(t or "" for _, u, t in sorted(rows) if u == url)
        assert all(len(t) == 100 for _, t in own[:-1])


def test_names_with_a_common_beginning_have_keys_of_their_own(spark):
    names = spark.createDataFrame([("s", f"premium plan {i:04d}") for i in range(300)] + [("s", "ab"), ("s", "pr")], "url string, name string")
    keys = verify._rarest_gram(names, "url", 3)
    assert keys.count() == 302
    assert keys.groupBy("gram").count().agg(F.max("count")).first()[0] <= 60
    left = spark.createDataFrame([(1, "s", "buy PREMIUM PLAN 0007 now"), (2, "s", "premium plan"), (3, "s", "xaby"), (4, "t", "ab"), (5, "s", "")],
                                 "k long, url string, t string")
    assert sorted(r.k for r in verify.contains_any(left, "t", names, ["k"]).collect()) == [1, 2, 3]


def test_offsets_of_chunks_are_never_broadcast(spark):
    """The size of derived tables is guessed from small files, so only hints keep them off the driver."""
    from pricesieve.plans.fixtures import fixture
    from pricesieve.plans.q_verify import cut_chunks
    chunks = cut_chunks(fixture(spark, "/root/testdata/sf0.001", "fx_product_answers"))
    plan = verify.page_blocks(chunks)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
