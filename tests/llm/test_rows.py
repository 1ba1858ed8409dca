"""Rows that share an id: nearest neighbours and near-duplicate removal judge each row by itself."""
from __future__ import annotations

import numpy as np

from pricesieve.llm import golay_simhash, nn_descent
from tests.llm.test_operators import _components, _fingerprint


def test_one_vec_id_with_several_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i % 7, (centres[c] + rng.normal(size=12) * 0.03).astype("f4").tolist(), c % 2)
            for i, c in enumerate(rng.integers(0, 6, 40).tolist())]
    rows += rows[:4] + [(None, rows[0][1], rows[0][2]), (2, None, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    got = [tuple(r) for r in nn_descent.near_duplicates(table).collect()]
    usable = [r for r in rows if r[0] is not None and r[1] is not None]
    x = np.array([r[1] for r in usable], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in usable])
    linked = (x @ x.T >= nn_descent.THRESHOLD) & (label[:, None] == label[None, :])
    comp = _components(range(len(usable)), lambda a, b: linked[a, b])
    least = {}
    for i, r in enumerate(usable):
        least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    want = [(r[0], int(linked[i].sum()) - 1, least[comp[i]], r[0] == least[comp[i]]) for i, r in enumerate(usable)]
    # the repeated vector whose row has no vec_id, and the row without a vector
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    other = [r for r in got if r[0] is None]
    assert len(got) == len(rows) and len(other) == 1
    assert sorted((r for r in got if r[0] is not None), key=key) == sorted([*want, (2, 0, 2, True)], key=key)


def test_keep_one_goes_by_rows(spark):
    t, u, w = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuw")
    rows = [(1, t, "a"), (7, u, "b"), (7, t, "c"), (7, u, "d"), (None, w, "e"), (None, w, "f"), (None, t, "g"), (9, None, "h"), (8, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = golay_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    fps = [_fingerprint(r[1]) for r in rows]
    comp = _components(range(len(rows)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert len(got) == len(set(comp.values()))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got) == sorted(
        [(False, 1, t), (False, 7, u), (True, None, w), (False, 8, "")])
    assert golay_simhash.keep_one(docs.limit(0)).count() == 0
