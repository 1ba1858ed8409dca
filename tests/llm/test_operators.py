"""Small fixtures with nulls, empty and odd texts, repeated rows and empty tables, each
operator against a brute-force version."""
from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from pricesieve.llm import (
    bestfit, bpe_automaton, golay_simhash, html_mincut, license_scan, line_crf, line_quality, nn_descent, token_files,
    url_rules,
)
from pricesieve.llm.common import public_tokenizer, shared_folder, staged
from pricesieve.llm.components import connected_components

TEXTS = [None, "", "a", "  \n\t ", "one two three", "One  TWO\tthree", "<|endoftext|> x<|endoftext|>", "aaa " * 40,
         "é ñ 中文 \U0001f600 ́x", "line one\nline two\n\nline one\n" * 5, "word " * 3000, "a\x1cb \x85 c", "don't we'll  go"]
DOCS = "doc_id long, text string, source string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 2}", "clash") for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "s1", "clash"), (None, "no id here", "s0", "clash"), (4, TEXTS[4], None, "clash")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer(name))


def test_html(spark):
    page = ("<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; x</h1><p><b>First  text,\nwith words.<br><p>Second one."
            "<div class='comments'><p>I liked it.</p></div></article><div class=ad>Buy now.</div><script>'<p>no</p>'</script>"
            "<footer>&copy; us</footer></body>")
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain words only, but a sentence of them."), (4, "u", "<p")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_mincut.extract(pages).collect()}
    want = "T & x\nFirst text, with words.\nSecond one."
    assert got[1, "u"] == (want, len(want)) and got[2, None] == ("", 0) and got[3, "u"] == ("", 0)
    assert len(got) == 5
    assert html_mincut.extract(pages.limit(0)).count() == 0


def test_minimum_cut_is_least():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        prices = np.array([rng.uniform(-3, 3) for _ in range(n)])
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            return (sum(max(p, 0) if not x else max(-p, 0) for p, x in zip(prices, labels))
                    + sum(w for a, b, w in edges if labels[a] != labels[b]))

        got = html_mincut.minimum_cut(prices, edges)
        assert cost(got) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_token_files(spark, docs, empty, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path, public_tokenizer("word_bpe_49k.json"))
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, path).collect()]
    tok, at = _library("word_bpe_49k.json"), 0
    by_doc = {r.doc_id: r.text for r in docs.collect()}
    for doc, start, n, ids in sorted(got, key=lambda r: r[1]):
        want = [*tok.encode(by_doc[doc] or "", add_special_tokens=False).ids, 1]
        assert start == at and n == len(want) and np.frombuffer(ids, "<u4").tolist() == want
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and len(got) == docs.count()
    assert {r.doc_id for r in token_files.read_tokens(spark, path, [5, 7]).collect()} == {5, 7}
    assert token_files.round_trip(empty, public_tokenizer("word_bpe_49k.json")).count() == 0


def test_url_rules(spark):
    urls = ["https://WWW.Example.org/es/1", "http://example.org/en/12?x", "http://a.example.org:80/en/1", "ftp://x.com/fr/#a",
            "http://com/de/", "http://xcom/de/", "x://notexample.org/es/", None, "no scheme", "", "://", "http://org", "http://org/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    rules = url_rules.QUERY_RULES + [("a.example.org", "/", "block")]
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for r in url_rules.judge(pages, table).collect():
        u = [*urls, urls[0]][r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
    assert url_rules.judge(pages.limit(0), table).count() == 0


def test_crf_marginals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, coupling = rng.normal(size=n), np.array([0.7, 1.3])
        weight = {y: np.exp(sum(s for s, k in zip(scores, y) if k) + sum(coupling[a] for a, b in zip(y, y[1:]) if a == b))
                  for y in itertools.product([0, 1], repeat=n)}
        total = sum(weight.values())
        good, _ = line_crf.forward_backward(np.concatenate([scores, scores]), np.array([0, n]), np.array([n, n]), coupling)
        want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        assert good == pytest.approx(want + want)


def test_crf_documents(spark, docs, empty):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta of the in".split()) + ("###" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:]), "s", "x"))
    train = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = line_crf.quality_scores(train, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in held) and all(0 <= r.score <= 1 for r in got)
    assert line_crf.keep_good(docs, train, labels).columns == docs.columns
    assert line_crf.quality_scores(empty, labels).count() == 0
    assert {r.score for r in line_crf.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def _fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [64, 1])
def test_simhash(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(golay_simhash, "MAX_KEY_GROUP", limit)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in golay_simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    ids = [d for d in fps if d is not None]
    want = _components(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {k: v for k, v in got.items() if k[0] is not None} == {(d, f"{fps[d]:016x}"): want[d] for d in ids}
    assert golay_simhash.near_duplicates(empty).count() == 0
    kept = golay_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


@pytest.mark.parametrize("limit", [64, 1])
def test_fingerprint_links_lose_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(golay_simhash, "MAX_KEY_GROUP", limit)
    rng = random.Random(9)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 4)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = staged(spark.createDataFrame([(f,) for f in signed], "fp long"), "fps")
    got = {r.node: r.root for r in connected_components(golay_simhash.fingerprint_links(table)).collect()}
    want = _components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {f: got.get(f, f) for f in signed} == want


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[::97]
    by_byte, leader, _ = golay_simhash.golay_tables()
    assert len(set(leader.tolist())) == 2048 and max(int(e).bit_count() for e in leader) == 3
    keys = golay_simhash.golay_keys(words)
    for _ in range(20):
        flip = (1 << np.random.default_rng(_).integers(0, 23, len(words))) | (1 << np.random.default_rng(_ + 99).integers(0, 23, len(words)))
        other = golay_simhash.golay_keys(words ^ flip)
        assert (keys[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_bpe_automaton(spark, docs, empty):
    tok, coder = _library("byte_bpe_50k.json"), bpe_automaton.encoder(public_tokenizer("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abe st  \n\té中!1'<|>") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    for t, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(t) == want.ids
        assert coder.automaton.decode(want.ids) == tok.decode(want.ids, skip_special_tokens=False)
    for r in bpe_automaton.digests(docs, public_tokenizer("byte_bpe_50k.json")).collect():
        text = {d.doc_id: d.text for d in docs.collect()}[r.doc_id] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_automaton.digests(empty, public_tokenizer("byte_bpe_50k.json")).count() == 0


def check_packing(rows, docs):
    """Pieces cover every document's ids and sequences have no gaps or overlaps."""
    tok = _library("byte_bpe_50k.json")
    want = sorted((d or -1, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
                  for d, t in docs for ids in [[*tok.encode(t or "", add_special_tokens=False).ids, 0]]
                  for cuts in [[0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]]
                  for k, (s, e) in enumerate(zip(cuts, cuts[1:])))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


@pytest.mark.parametrize("lane_rows", [100_000, 40])
def test_bestfit(spark, docs, empty, monkeypatch, lane_rows):
    monkeypatch.setattr(bestfit, "LANE_ROWS", lane_rows)
    rng = random.Random(4)
    more = [(100 + i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(int(rng.expovariate(1 / 400)))), "s", "c") for i in range(150)]
    table = docs.unionAll(spark.createDataFrame(more, DOCS))
    rows = bestfit.packed_documents(table, public_tokenizer("byte_bpe_50k.json")).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in table.collect()])
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= least * (1.03 if lane_rows > 1000 else 1.35) + 2
    assert bestfit.packed_documents(empty, public_tokenizer("byte_bpe_50k.json")).count() == 0


def test_successor_sweep_is_best_fit():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 10))]
        lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 30))), reverse=True)
        bins, offsets, left, opened = bestfit.successor_sweep(sizes, lengths, 40)
        room, fresh = list(sizes), 0
        for b, o, length in zip(bins, offsets, lengths):
            fits = [r for r in room if r >= length]
            if b == len(room):
                assert not fits
                room.append(40)
                fresh += 1
            else:
                assert room[b] == min(fits)
            assert o == 40 - room[b]
            room[b] -= length
        assert room == left and fresh == len(opened)


def test_license_scan(spark, docs, empty):
    rows = [(i, "Some words of a text.\n" + t + "\nand more words.", "s", "c") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "licensed under the apache license, version 2.0!", "s", "c"), (101, "the terms of the game are in the book", "s", "c"),
             (102, None, "s", "c"), (100, "licensed under the apache license, version 2.0!", "s", "c")]
    got = license_scan.license_paragraphs(docs.unionAll(spark.createDataFrame(rows, DOCS)).where("source = 's'")).collect()
    named = {(r.doc_id, r.paragraph): r.family for r in got}
    assert all(named[i, 1] == f for i, (f, _) in enumerate(license_scan.TEMPLATES))
    assert named[100, 0] == "apache-2.0" and sum(r.doc_id == 100 for r in got) == 2
    assert not any(d == 101 and f != "unknown" for (d, _), f in named.items())
    assert license_scan.license_paragraphs(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_nn_descent(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 60))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.08).astype("f4").tolist(), c % 3))
    rows += [(len(rows) + i, r[1], r[2]) for i, r in enumerate(rows[:5])]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] + [0.0] * 14, 0), (n + 3, [float("nan")] + [1.0] * 15, 0),
           (n + 4, rows[0][1], None), (n + 5, [float("inf")] * 16, 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, n long".replace("n long", "n string"))
    got = {r.vec_id: r for r in nn_descent.near_duplicates(table).collect()}
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (same[:, None] == same[None, :])
    comps = _components(range(n), lambda a, b: linked[a, b])
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum() - 1, comps[i], comps[i] == i)
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in odd)
    assert nn_descent.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("head, mark, tail", [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("<!--\n", "", "\n-->")])
def test_license_scan_wrapped(spark, head, mark, tail):
    import textwrap

    rows, want = [], {}
    for i, (family, text) in enumerate(license_scan.TEMPLATES):
        lines = textwrap.wrap(text, 30)
        notice = head + "\n".join(mark + x for x in lines) + tail
        rows.append((i, f"A text.\n\n{notice}\n\nThe terms of the game\nare in the book.", "s", "c"))
        if len(lines) > 1:
            want[i] = (2 + head.count("\n"), family)
    got = license_scan.license_paragraphs(spark.createDataFrame(rows, DOCS)).collect()
    named = {}
    for r in got:
        if r.family != "unknown":
            named.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert len(want) > 15
    for i, (at, family) in want.items():
        assert {f for _, f in named.get(i, [])} == {family}, (i, named.get(i))
        # a template that one of its lines holds is named there
        assert len(named[i]) == 1 and at <= named[i][0][0]
    assert sum(named[i][0] == w for i, w in want.items()) > 12


def _turned(rng, x, cos):
    """A unit vector at the cosine ``cos`` to ``x``."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


def _near_duplicates_exact(spark, x):
    """Holds near_duplicates of the vectors, of one label, against all pairs."""
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(table).collect()}
    linked = x @ x.T >= 0.98
    comps = _components(range(len(x)), lambda a, b: linked[a, b])
    assert got == {i: (linked[i].sum() - 1, comps[i], comps[i] == i) for i in range(len(x))}


def test_nn_descent_links_two_tight_groups(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=32)
    one /= np.linalg.norm(one)
    rows = []
    for centre in (one, _turned(rng, one, 0.987)):
        rows += [_turned(rng, centre, 0.9999) for _ in range(25)]
    x = np.array([r / np.linalg.norm(r) for r in rows])
    across = x[:25] @ x[25:].T
    assert (x[:25] @ x[:25].T).min() > 0.999 and across.max() >= 0.98 and across.min() > 0.97
    _near_duplicates_exact(spark, x)


def _group_and_pairs(rng):
    """A tight group of a third of the vectors, and pairs of their own at 0.981."""
    one = rng.normal(size=32)
    one /= np.linalg.norm(one)
    rows = [_turned(rng, one, 0.9995) for _ in range(60)]
    for _ in range(60):
        x = rng.normal(size=32)
        x /= np.linalg.norm(x)
        rows += [x, _turned(rng, x, 0.981)]
    return np.array([r / np.linalg.norm(r) for r in rows])


def test_nn_descent_audit_sees_small_groups(spark):
    x = _group_and_pairs(np.random.default_rng(9))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    classes = nn_descent.classes_of(table)
    group = spark.createDataFrame([(i, 59) for i in range(60)], "id long, links long")
    whole = group.unionAll(spark.createDataFrame([(i, 1) for i in range(60, 180)], "id long, links long"))
    # links go by class id; these vectors are classes of their own, named by their vec_id
    of = classes.select("id", "least")
    group, whole = (of.join(t.withColumnRenamed("id", "least"), "least").select("id", "links") for t in (group, whole))
    # 3,540 of 3,660 links are in the group
    assert nn_descent.audit(classes, group) < 0.1
    assert nn_descent.audit(classes, whole) == 1


@pytest.mark.parametrize("size", [32 << 20, 20_000])
def test_nn_descent_is_whole_after_the_last_turn(spark, monkeypatch, size):
    monkeypatch.setattr(nn_descent, "MAX_TURNS", 1)
    monkeypatch.setattr(nn_descent, "PASS_BYTES", size)
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "WINDOW", 1)
    _near_duplicates_exact(spark, _group_and_pairs(np.random.default_rng(10)))


def test_forest_keeps_components():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        a, b = rng.integers(0, n, 40), rng.integers(0, n, 40)
        sim = rng.choice([0.95, 0.99], 40)
        marks = nn_descent._forest(a, b, sim)

        def comps(at):
            links = {(int(u), int(v)) for u, v in zip(a[at], b[at])}
            return _components(range(n), lambda u, v: (u, v) in links or (v, u) in links)

        linked = sim >= 0.98
        assert comps(marks) == comps(linked) and not (marks & ~linked).any()
        assert marks.sum() == n - len(set(comps(linked).values()))


def test_quality_rules(spark, docs, empty):
    boiler = "The same line stands here again and again in this host"
    rows = [(1000 + i, boiler + "\n" + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60 if i % 2 else 3 + 2 * (i % 3))), "h", "c") for i in range(60)]
    rows += [(2000 + i, "\n".join([boiler] * 6) + f"\nown {i}", "h", "c") for i in range(4)]
    table = docs.unionAll(spark.createDataFrame(rows, DOCS))
    got = line_quality.quality_rules(table).collect()
    assert len(got) == table.count()
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 2000 and r.doc_id % 2:
            assert r.kept and r.n_left_words == 60
        if r.doc_id is not None and r.doc_id >= 2000:
            assert r.n_left_words == 2 and not r.kept and r.n_dup_lines == 5
    text = {r.doc_id: r.text or "" for r in table.collect()}
    import re
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0d]+", text[r.doc_id])
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 500 else set(range(len(words)))
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(hit))
    kept = line_quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert line_quality.quality_rules(empty).count() == 0


def test_keep_good_removes_boilerplate_lines(spark):
    boiler = "The same Line 7 stands here"
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [" ".join(letters[i % 26] + letters[i // 26] + letters[j % 26] + letters[j // 26] for j in range(60)) for i in range(60)]
    rows = [(i, f"{boiler}\n\n{t}\n \n  the SAME line 3  stands here ", "h", "c") for i, t in enumerate(own)]
    rows += [(100, f"{boiler}\n{own[0]}", "other", "c"), (101, f"{boiler}\n{own[0]}", None, "c")]
    got = {r.doc_id: r for r in line_quality.keep_good(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.text for i, r in got.items()} == {i: f"\n{t}\n " for i, t in enumerate(own)} | {
        100: rows[-2][1], 101: rows[-1][1]}
    assert got[3].source == "h" and got[3].n_words == "c"


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
