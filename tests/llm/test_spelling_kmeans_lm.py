"""Spelling groups, Hadamard clustering and Pitman-Yor scores against brute force."""
from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pricesieve.llm import hadamard_kmeans, pitman_yor, spelling_groups
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "x") for i, t in rows], DOCS).coalesce(2)


# --- spelling groups -----------------------------------------------------------------------

def _vocabulary(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if _near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _spelling_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 20)
        for _ in range(3):
            at = rng.randrange(len(w) + 1)
            words += [rng.choice([w[:at] + "a" + w[at:], w[:at] + w[at + 1:], w[:at] + "b" + w[at + 1:], w + w[-1]])] * rng.randint(1, 9)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return rows + [(3, rows[3][1]), (None, "LEVER Lever lever Élever éléver levér"), (50, None), (51, ""), (52, "y" * 30_000 + " " + "Z" * 4)]


@pytest.mark.parametrize("limit", [1, 8, 16_384])
def test_spelling_groups(spark, limit):
    rows = _spelling_rows(5)
    want = _variants(_vocabulary(rows))
    got = {r.word: tuple(r)[1:] for r in spelling_groups.variant_groups(docs(spark, rows), limit=limit).collect()}
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 30 and any(r != (f or w) for w, (f, r, *_) in want.items())


def test_spelling_groups_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = _variants(_vocabulary([(r.doc_id, r.text) for r in table.collect()]))
    got = {r.word: tuple(r)[1:] for r in spelling_groups.variant_groups(table).collect()}
    assert got == want


def test_spelling_groups_empty(spark):
    assert spelling_groups.variant_groups(docs(spark, [])).count() == 0
    assert spelling_groups.variant_groups(docs(spark, [(1, None), (2, "  ")])).count() == 0


def test_hot_groups_are_cut(spark):
    """Words with one beginning: groups end within the limit, and each pair meets once."""
    words = [("prefix" + "".join(p), 3) for p in itertools.product("abcd", repeat=5)]
    groups = spelling_groups.candidate_groups(spark.createDataFrame(words, "word string, n long"), 40)
    sizes = groups.groupBy(*spelling_groups.KEY).count().where("hi - lo > 1").agg({"count": "max"}).first()[0]
    assert sizes <= 40
    near = {r.word: r.n_near for r in spelling_groups.near_words(spark.createDataFrame(words, "word string, n long"), 40).collect()}
    assert near == {w: 15 for w, _ in words}


# --- Hadamard clustering -------------------------------------------------------------------

def _kmeans(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        rows = assign()
        for c in range(len(centres)):
            own = [v for _, v, j, _ in rows if j == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    rows = assign()
    total = sum(d for *_, d in rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, sum(e for *_, j, e in rows if j == c), total, names[c]) for i, _, c, d in rows)


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    m = hadamard_kmeans.walsh_matrix()
    assert (m @ m.T == 64 * np.eye(64, dtype=int)).all()
    assert (np.diff(m, axis=1) != 0).sum(axis=1).tolist() == list(range(64))
    v, c = rng.integers(-50, 50, (300, 64)), rng.integers(-50, 50, (9, 64))
    c[5] = c[2]
    cluster, d = hadamard_kmeans.nearest(hadamard_kmeans.transform(v), hadamard_kmeans.transform(c))
    plain = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == plain.argmin(axis=1)).all() and (d == plain.min(axis=1)).all()
    assert len(hadamard_kmeans.nearest(np.zeros((0, 64), np.int64), c)[0]) == 0


@pytest.mark.parametrize("k,count", [(4, 60), (16, 9)])
def test_clusters(spark, k, count):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 1 / 3]) for _ in range(64)]) for i in range(count)]
    rows += [rows[0], (1, rows[2][1]), (None, rows[3][1])]
    odd = [(90, None), (91, []), (92, [0.0] * 63), (93, [0.0] * 65), (94, [None] + [0.0] * 63),
           (95, [math.nan] + [0.0] * 63), (96, [-math.inf] + [0.0] * 63)]
    table = spark.createDataFrame([(i, e, "clash") for i, e in rows + odd], "vec_id long, embedding array<double>, cluster string")
    got = sorted((str(r.vec_id), *tuple(r)[1:]) for r in hadamard_kmeans.cluster(table, k=k).collect())
    assert got == _kmeans(rows, k, 3)
    assert hadamard_kmeans.cluster(table.limit(0)).count() == 0


def test_too_large_components_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no exact long"):
        hadamard_kmeans.cluster(table).count()


def test_cluster_oracle(spark):
    from pricesieve.llm import queries

    r = compare(spark, duck(SF), SF, "op12", queries.op12_hadamard_kmeans, queries.ORACLE["op12_hadamard_kmeans"])
    assert r.get("ok"), r


# --- Pitman-Yor ----------------------------------------------------------------------------

def test_log_gamma():
    x = np.concatenate([np.linspace(0.05, 30, 500), [1e3, 1e6, 1e9]])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-9)


def test_pack():
    a = [np.arange(5, dtype=np.int64) - 2, np.zeros(0, np.uint32), np.array([1, 2**40], np.uint64)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, pitman_yor.unpack(pitman_yor.pack(*a))))


def _paths(c, a, p, d):
    """Weight and normalisers of every seating order of ``c`` customers of one dish."""
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, c), k) for k in range(c)):
        t, weight, normal = 1, a * p, 1.0
        for n in range(1, c):
            new, old = (a + d * t) * p, n - d * t
            normal *= new + old
            weight *= new if n in cuts else old
            t += n in cuts
        yield cuts, weight, normal


@pytest.mark.parametrize("c,p,few", [(2, 0.3, 200), (5, 0.3, 200), (6, 0.02, 0), (5, 0.3, 10**9)])
def test_seating_and_weights(monkeypatch, c, p, few):
    """The rule seats with its exact probabilities, together or one by one, and the Gibbs steps
    reach the exact distribution of table counts."""
    monkeypatch.setattr(pitman_yor, "FEW", few)
    a, d, size = 2.0, 0.6, 40_000
    rng = np.random.default_rng(c)
    paths = list(_paths(c, a, p, d))
    cc, aa, pp = np.full(size, c), np.full(size, a), np.full(size, p)
    row, cut = pitman_yor.seat(cc, aa, pp, d, rng)
    seen = Counter(tuple(x.tolist()) for x in np.split(cut, np.cumsum(np.bincount(row, minlength=size))[:-1]))
    for cuts, weight, normal in paths:
        assert abs(seen[cuts] / size - weight / (a * p) / normal) < 0.012
    one = [np.full(1, x) for x in (c, a, p)]
    for cuts, _, normal in paths:
        w = pitman_yor.log_weight(one[0], np.zeros(len(cuts), np.int64), np.array(cuts, np.int64), one[1], one[2], d)
        assert math.isclose(math.exp(w[0]), normal, rel_tol=1e-9)
    t, cuts = np.ones(size, np.int64), np.zeros(0, np.int64)
    for _ in range(25):
        t, cuts = pitman_yor.resample(cc, t, cuts, t + 0, pp, d, a, rng)
    total = sum(w for _, w, _ in paths)
    for k in range(1, c + 1):
        want = sum(w for x, w, _ in paths if len(x) + 1 == k) / total
        assert abs((t == k).mean() - want) < 0.012


def test_seating_of_a_hot_dish():
    """A dish of ten million customers costs its tables only."""
    for p, least, most in ((0.01, 1, 100), (0.9, 100, 100_000)):
        row, cut = pitman_yor.seat(np.array([10_000_000]), np.array([50.0]), np.array([p]), 0.5, np.random.default_rng(2))
        assert least <= len(cut) <= most and (np.diff(cut) > 0).all() and cut.max() < 10_000_000


def _tokens(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
            for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def _check_base(got, rows):
    learn = Counter(t for i, x in rows if pitman_yor.fold(i) != 1 for t in _tokens(x))
    n, v = sum(learn.values()), len(learn)
    want = sorted((str(i), pitman_yor.fold(i) == 1, len(_tokens(x)), sum(learn[t] > 0 for t in _tokens(x)), n,
                   round(sum(math.log10((learn[t] + 0.5) / (n + 0.5 * (v + 1))) for t in _tokens(x)), 6)) for i, x in rows)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    for r in got:
        assert r.score <= 1e-9 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_base_counts_and_scores_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = pitman_yor.scores(table).collect()
    _check_base(got, [(r.doc_id, r.text) for r in table.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _corpus(seed, count=120):
    rng = random.Random(seed)
    after = {w: rng.choices("abcdefgh", k=2) for w in "abcdefgh"}
    out = []
    for i in range(count):
        w, words = rng.choice("abcdefgh"), []
        for _ in range(rng.randint(0, 30)):
            words.append(w)
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.choice("abcdefgh")
        out.append((i, " ".join(words)))
    return out


def test_pairs_are_learnt(spark):
    """On text whose words depend on the word before, held-out texts score far above the base; rows
    with nulls, repeated ids, odd white space and unknown words have their defined scores; blocks
    and buckets don't change anything but the random seating."""
    rows = _corpus(4) + [(500, None), (501, ""), (502, "  \x0b\n"), (None, "A b C"), (3, "a  unknown1\x1cx \x85 É"), (3, "a b")]
    got = pitman_yor.scores(docs(spark, rows)).collect()
    _check_base(got, rows)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert len(held) > 10 and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    again = pitman_yor.scores(docs(spark, rows)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_probabilities_of_all_texts_sum_to_one(spark):
    """Texts of up to six of the words a, b and an unknown one: what is missing to one is the
    probability of longer texts, which training texts of at most two words make small."""
    learn = [i for i in range(400) if pitman_yor.fold(i) != 1]
    rows = list(zip(learn, itertools.cycle(["a", "b", "a", "", "b a"])))
    held = (i for i in range(1000, 100_000) if pitman_yor.fold(i) == 1)
    texts = [" ".join(t) for n in range(7) for t in itertools.product(["a", "b", "never"], repeat=n)]
    rows += [(next(held), t) for t in texts]
    got = pitman_yor.scores(docs(spark, rows)).where("held_out").collect()
    assert len(got) == len(texts)
    assert 0.999 < sum(10 ** r.score for r in got) < 1 + 1e-9


def test_scores_without_documents(spark):
    assert pitman_yor.scores(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if pitman_yor.fold(i) == 1)
    (r,) = pitman_yor.scores(docs(spark, [(held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
