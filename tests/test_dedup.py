"""Deduplication: hand-computed cases and the properties that define the greedy leaders."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricesieve.functions.similarity import common_length, similarity, word_order_similarity, word_set_similarity
from pricesieve.operators import dedup
from pricesieve.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"
SCHEMA = "row_id long, product_name string, price string, provider string, description string"
SIGNATURE = ["n_name", "n_price", "n_provider", "n_duration"]


def test_fuzzy_values():
    assert round(similarity("this is a test", "this is a test!"), 8) == 0.96551724
    assert word_order_similarity("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1.0
    assert word_set_similarity("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert common_length("abcbdab", "bdcaba") == 4


def test_leaders_by_hand(spark):
    rows = [(1, "Red Widget", "$10", "Acme", "30 minutes"), (2, "red  widget", "$10.00", "Acme", "30 min"),
            (3, "Red Widget", "$10", "", "30 minutes"), (4, "Blue Bolt", "$10", "Acme", "30 minutes")]
    got = {r.row_id: r.leader_id for r in dedup.dedup_leaders(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    # 1 and 2 agree in all four; 3 lacks the provider; 4 has another name
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("threshold", [0.8, 0.75, 0.9])
def test_leader_properties(spark, threshold):
    """No two leaders reach the threshold; every other row reaches it with its leader, and with
    no leader that is processed before that one."""
    p = fixture(spark, SF, "fx_products")
    prepared = dedup.prepare(p).select("row_id", *SIGNATURE)
    table = prepared.select(*SIGNATURE).distinct().withColumn("sig_id", F.monotonically_increasing_id()).cache()
    by_signature = {tuple(r[c] for c in SIGNATURE): r.sig_id for r in table.collect()}
    sig = {r.row_id: by_signature[tuple(r[c] for c in SIGNATURE)] for r in prepared.collect()}
    score = {}
    for r in dedup.pair_scores(table, threshold).collect():
        score[r.s1, r.s2] = score[r.s2, r.s1] = r.score
    rank = {r.row_id: r["rank"] for r in dedup.quality_rank(p).collect()}
    rows = dedup.dedup_leaders(p, threshold).collect()
    leaders = sorted((r.row_id for r in rows if r.is_leader), key=rank.get)

    def same(a, b):
        return score.get((sig[a], sig[b]), 0.0) >= threshold

    assert not any(same(a, b) for i, a in enumerate(leaders) for b in leaders[:i])
    for r in rows:
        if not r.is_leader:
            assert r.leader_id == next(x for x in leaders if same(x, r.row_id))
            assert rank[r.leader_id] < rank[r.row_id]


def test_long_answers_keep_their_ids(spark):
    """An answer of more than 1,000 items doesn't meet the items of the next chunk."""
    from pricesieve.operators import answers
    items = answers.answer_items(fixture(spark, SF, "fx_product_answers"))
    top = items.agg(F.max("item_no")).first()[0]
    assert items.select((F.col("chunk_id") * (top + 1) + F.col("item_no")).alias("i")).distinct().count() == items.count()


def test_exact_flag_strips_all_white_space(spark):
    from pricesieve.operators import edits
    rows = [(1, "Widget", "$1", None, ""), (2, "\tWidget\n", " $1", None, ""), (3, None, "$1", "", ""), (4, None, "$2", "", "")]
    got = {r.row_id: (r.dup_exact, r.dup_provider)
           for r in edits.dup_provider(edits.dup_exact(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, False), 4: (True, True)}


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_stretches_decide_as_the_whole_and_store_few_links(spark, monkeypatch, threshold):
    """Leaders taken in short stretches are those of the plain greedy loop, with the same first
    leaders, though the links of all signatures are never stored."""
    import random
    rng = random.Random(5)
    prices = ["$10", "$10.50", "$19", "$0", "0", "Free", "call us", "call me", None, ""]
    rows = [(i, rng.choice(["Red Widget", "Red Wodget", "Widget", "Blue Bolt", "!!!"]), rng.choice(prices),
             rng.choice(["Acme", "Bolts", None]), rng.choice(["30 min", "1 hr", None])) for i in range(400)]
    p = spark.createDataFrame(rows, SCHEMA)
    stored = []
    plain = dedup.materialize

    def counted(df):
        out = plain(df)
        if out.columns == ["s1", "s2"]:
            stored.append(out.count())
        return out

    monkeypatch.setattr(dedup, "materialize", counted)
    monkeypatch.setattr(dedup, "FIRST_STRETCH", 16)
    monkeypatch.setattr(dedup, "STRETCH_LINKS", 64)
    got = {r.row_id: r.leader_id for r in dedup.dedup_leaders(p, threshold).collect()}
    prepared = {r.row_id: tuple(r[c] for c in SIGNATURE) for r in dedup.prepare(p).collect()}
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(dict.fromkeys(prepared.values()))],
                                  "sig_id long, n_name string, n_price string, n_provider string, n_duration string")
    number = {s: i for i, s in enumerate(dict.fromkeys(prepared.values()))}
    pairs = [(r.s1, r.s2) for r in dedup.pair_scores(table, threshold).collect() if r.score >= threshold]
    links = {frozenset(x) for x in pairs}
    assert len(links) == len(pairs)  # each pair once, without a distinct over them
    rank = {r.row_id: r["rank"] for r in dedup.quality_rank(p).collect()}
    leaders, want = [], {}
    for row in sorted(prepared, key=rank.get):
        want[row] = next((x for x in leaders if frozenset((number[prepared[x]], number[prepared[row]])) in links), row)
        if want[row] == row:
            leaders.append(row)
    assert got == want
    assert len(stored) > 1 and sum(stored) < len(links) / 2


@pytest.mark.parametrize("threshold", [0.8, 0.75, 0.6])
def test_name_pairs_are_scored_before_any_shuffle(spark, monkeypatch, threshold):
    """All similar name pairs of a block, each once, though it is dealt to several tasks; a pair is
    not shuffled before it is known to be similar."""
    import random
    from pricesieve.functions.similarity import name_similarity
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)} | {""})
    sigs = [(i, name, "$1", provider, duration) for i, (name, provider, duration) in enumerate(
        (name, provider, duration) for name in names for provider in ("acme", "bolts", None) for duration in ("30 minute", "") if rng.random() < 0.8)]
    plans, plain = [], dedup.materialize

    def planned(df):
        if "name_sim" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(dedup, "materialize", planned)
    monkeypatch.setattr(dedup, "BLOCK_NAMES", 8, raising=False)
    sig = spark.createDataFrame(sigs, "sig_id long, n_name string, n_price string, n_provider string, n_duration string")
    found = dedup.name_candidates(sig, threshold)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = [(r.blk, r.name1, r.name2, r.name_sim) for r in found.collect()]
    want = set()
    for mark, at, bound in (("p:", 3, dedup.name_bound(threshold)), ("d:", 4, dedup.name_bound(threshold, provider=False)),
                            ("*", None, dedup.name_bound(threshold, False, False))):
        if mark == "d:" and threshold >= 0.8 or bound > 1:
            continue
        for key in {s[at] for s in sigs if s[at]} if at else {""}:
            block = sorted({s[1] for s in sigs if at is None or s[at] == key} - {""})
            want |= {(mark + key, x, y, s) for i, x in enumerate(block) for y in block[i:] if (s := name_similarity(x, y)) >= bound}
    assert len(got) == len(set(got)) and set(got) == want
    plans = [plan for plan in plans if "ArrowEvalPython" in plan]
    assert plans
    for plan in plans:
        below = plan.split("ArrowEvalPython", 1)[1].split("Join", 1)[0]
        assert "Exchange" not in below and "Aggregate" not in below


def test_many_names_of_a_provider_are_not_all_paired(spark, monkeypatch):
    """At low thresholds most names of a provider are similar enough; their pairs are stored for a
    stretch and its leaders alone, and the leaders are those of the plain greedy loop."""
    import random
    threshold, rng = 0.7, random.Random(11)
    names = sorted({" ".join(rng.sample("red blue old new ring bolt plate gear hot cold large small".split(), 3)) for _ in range(200)})
    rows = [(i, name, rng.choice(["$10", "$10.50", "$11"]), "acme", "") for i, name in enumerate(rng.sample(names, 60))]
    table = spark.createDataFrame(rows, "sig_id long, n_name string, n_price string, n_provider string, n_duration string")
    links = {tuple(sorted((r.s1, r.s2))) for r in dedup.pair_scores(table, threshold).collect() if r.score >= threshold}
    every = dedup.name_candidates(table, threshold).filter("blk <> '*'").count()
    stored, plain = [], dedup.materialize

    def counted(df):
        out = plain(df)
        if "name_sim" in out.columns:
            stored.append(out.filter("blk <> '*'").count())
        return out

    monkeypatch.setattr(dedup, "materialize", counted)
    monkeypatch.setattr(dedup, "FIRST_STRETCH", 30)
    monkeypatch.setattr(dedup, "STRETCH_LINKS", 1000)
    heads, met = dedup.greedy_leaders(table, threshold)
    leaders, first = [], {}
    for i in range(len(rows)):
        first[i] = next((x for x in leaders if (x, i) in links), i)
        if first[i] == i:
            leaders.append(i)
    assert sorted(r.sig_id for r in heads.collect()) == leaders and 1 < len(leaders) < 30
    # leaders that don't meet an earlier one meet none
    got = {r.sig_id: r.met for r in met.groupBy("sig_id").agg(F.min("met").alias("met")).collect()}
    assert {i: got.get(i, i) for i in first} == first
    assert every > 1000 and max(stored) < every * 2 / 3


SIG_SCHEMA = "sig_id long, n_name string, n_price string, n_provider string, n_duration string"


def _some_signatures(names, count, seed=7):
    import random
    rng = random.Random(seed)
    prices = ["$10", "$10.5", "$19", "$0", "$300", "call us", "call me", "", None]
    rows = {(rng.choice(names), rng.choice(prices + [f"${i}.25" for i in range(8, 40)]), rng.choice(["acme", "bolts", None]),
             rng.choice(["30 minute", "1 hour", ""])) for _ in range(count)}
    return [(i, *row) for i, row in enumerate(sorted(rows, key=str))]


def _shuffled_rows(df):
    """The rows that the shuffles of ``df`` write, and the columns of each shuffle; one that is read twice counts once."""
    df.collect()
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            walk(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(plan.plan())
        elif kind != "ReusedExchangeExec":
            if kind == "ShuffleExchangeExec":
                found.append((plan.metrics().apply("shuffleRecordsWritten").value(), plan.output().mkString(",")))
            for i in range(plan.children().size()):
                walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(n for n, _ in found), " ".join(cols for _, cols in found)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_signatures_are_shuffled_once_a_similar_name_and_not_for_each_key(spark, no_broadcast):
    rows = [r for r in _some_signatures(["red widget", "red widgets", "red wodget", "red wodgets"], 900) if r[3]]
    n, _ = _shuffled_rows(dedup.pair_scores(spark.createDataFrame(rows, SIG_SCHEMA), 0.8))
    # by name for either side (2), as the second (1) and as the first of a pair (2.5 names each)
    assert len(rows) > 200 and n < 8 * len(rows)


def test_ids_of_columns_are_made_behind_the_shuffle(spark, no_broadcast):
    cols = SIGNATURE
    rows = _some_signatures(["red widget", "red wodget", "blue bolt"], 120)
    table = spark.createDataFrame(rows, SIG_SCHEMA)
    ids = dedup.signature_id(*cols)
    made = dedup.pair_scores(table.drop("sig_id"), 0.8, ids)
    n, columns = _shuffled_rows(made)
    assert n and "sig_id" not in columns and "s1" not in columns
    of = {r.sig_id: r.made for r in table.select("sig_id", ids.alias("made")).collect()}
    # of two alike names the first of a pair is the one with the lesser id
    want = {(frozenset((of[r.s1], of[r.s2])), r.score) for r in dedup.pair_scores(table, 0.8).collect()}
    got = [(frozenset((r.s1, r.s2)), r.score) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0.8, 0.7, 0.5])
def test_a_hot_name_is_cut_in_cells_that_make_each_pair_once(spark, monkeypatch, threshold):
    """Signatures of few names, in cells of 8, against all pairs scored by a plain loop."""
    from pricesieve.functions.similarity import name_similarity, similarity
    rows = _some_signatures(["red widget", "red wodget", "widget", "blue bolt", "!", ""], 260)
    monkeypatch.setattr(dedup, "LEAST_CELL", 2)
    monkeypatch.setattr(dedup, "MOST_CELL", 8)
    monkeypatch.setattr(dedup, "TASK_PAIRS", 64)
    found = [r for r in dedup.pair_scores(spark.createDataFrame(rows, SIG_SCHEMA), threshold).collect()]
    got = {frozenset((r.s1, r.s2)): r.score for r in found}
    assert len(got) == len(found)

    def number(p):
        return float(p[1:]) if p and p[0] == "$" else None

    def score(x, y):
        name = name_similarity(x[1], y[1]) if x[1] and y[1] else 0.0
        provider, duration = x[3] is not None and x[3] == y[3], x[4] != "" and x[4] == y[4]
        name = min(1.0, name + 0.15) if provider and name > 0.7 else name
        name = min(1.0, name + 0.1) if duration and name > 0.6 else name
        a, b = number(x[2]), number(y[2])
        if not x[2] or not y[2]:
            price = 0.0
        elif a is not None and b is not None:
            price = 1.0 if a == b else 1.0 - abs(a - b) / max(a, b)
        else:
            price = similarity(x[2], y[2])
        return 0.5 * name + 0.2 * price + (0.2 if provider else 0.0) + (0.1 if duration else 0.0)

    want = {frozenset((x[0], y[0])): s for i, x in enumerate(rows) for y in rows[i:] if (s := score(x, y)) >= threshold}
    assert len(want) > 500 and {k: s for k, s in got.items() if s >= threshold} == want


@pytest.mark.parametrize("query", ["pair_scores", "pair_links"])
def test_pair_queries_shuffle_no_ids(spark, no_broadcast, query):
    """The signature is a pair's id: it is made behind the shuffle, not sent beside its own columns."""
    from pricesieve.plans.registry import QUERIES, load_all
    load_all()
    n, columns = _shuffled_rows(QUERIES[query](spark, SF))
    assert n and "n_price" in columns and not any(c in columns for c in ("sig_id", "s1", "s2"))
