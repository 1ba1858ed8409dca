"""The similarity join of names against all pairs, and the deduplication at low thresholds."""
from __future__ import annotations

import itertools
import random

import pytest

from pricesieve.functions.similarity import name_similarity
from pricesieve.operators import dedup
from pricesieve.operators.name_join import similar_name_candidates

WORDS = "plan basic premium gold 5gb 10gb data mega the fast line phone home é x".split()


def _names(seed, count=90):
    rng = random.Random(seed)
    out = {"plan", "plan plan", "ab", "ba", "a b", "-", "premium", "zzzzzzzz", "gold gold basic"}
    while len(out) < count:
        words = [w if rng.random() < 0.8 else "".join(rng.sample(w, len(w))) for w in rng.choices(WORDS, k=rng.randint(1, 5))]
        out.add(" ".join(words))
    return sorted(out)


@pytest.mark.parametrize("s", [1.0, 0.8, 0.6, 0.3])
def test_no_similar_pair_is_lost(spark, s):
    names = _names(int(10 * s))
    got = [tuple(r) for r in similar_name_candidates(spark.createDataFrame([(n,) for n in names], "name string"), s).collect()]
    want = {(a, b) for a, b in itertools.combinations_with_replacement(names, 2) if name_similarity(a, b) >= s - 1e-9}
    assert want <= set(got) and len(got) == len(set(got)) and all(a <= b for a, b in got)
    if s >= 0.8:
        assert len(got) < len(names) * (len(names) + 1) / 4


def test_candidates_grow_with_the_rows(spark):
    """Twice as many names of their own words give about twice the candidates."""
    def candidates(n):
        rng = random.Random(2)
        names = {" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8)) for _ in range(2)) for _ in range(n)}
        return similar_name_candidates(spark.createDataFrame([(x,) for x in names], "name string"), 1.0 - 2e-9).count()

    assert candidates(400) < 2.6 * candidates(200)


def test_bounds():
    assert dedup.name_bound(0.7, False, False) == pytest.approx(1.0, abs=1e-6)
    assert dedup.name_bound(0.75, False, False) > 1
    assert dedup.name_bound(0.5) == 0
    assert dedup.name_bound(0.6, False, False) == pytest.approx(0.8, abs=1e-6)
    with pytest.raises(ValueError):
        dedup.pair_scores(None, 0.4)


def test_low_thresholds_by_hand(spark):
    schema = "row_id long, product_name string, price string, provider string, description string"
    rows = [(1, "Red Widget", "$10", "Acme", None), (2, "Red Widget", "$10", "Other", None), (3, "Red Widget", "$11", "", None),
            (4, "Blue Bolt", "$10", "Acme", None), (5, "!!!", "$10", "Acme", "30 minutes"), (6, "???", "$10", "Acme", "30 minutes")]
    table = spark.createDataFrame(rows, schema)
    lead = {t: {r.row_id: r.leader_id for r in dedup.dedup_leaders(table, t).collect()} for t in (0.7, 0.5)}
    # 0.7: name and price alone reach it, without provider; $11 does not
    assert lead[0.7][2] == lead[0.7][1] and lead[0.7][3] == 3
    # 0.5: the name alone does; empty names with all the rest equal do too
    assert lead[0.5][3] == lead[0.5][1] == lead[0.5][2] and lead[0.5][5] == lead[0.5][6]
