"""The licence scan against a plain Python version of its rules."""
from __future__ import annotations

import math
import random
import textwrap

from pricesieve.llm import license_scan as ls

DOCS = "doc_id long, text string, family string"


def _features(text):
    known = set(ls.vocabulary())
    return {g for g in ls.ngrams(ls.normal_words(text)) if g in known}


def _best(model, grams):
    """(predicted, probability, family, template, overlap) of a paragraph's features."""
    weights = dict(model["weights"])
    z = [(b + sum(weights[g][i] for g in grams)) / model["temperature"] for i, b in enumerate(model["bias"])]
    at = z.index(max(z))
    predicted, probability = model["classes"][at], 1 / sum(math.exp(v - z[at]) for v in z)
    if predicted == ls.UNKNOWN:
        return None
    overlap, minus = max((len(grams & set(ls.ngrams(ls.normal_words(t)))) / len(ls.ngrams(ls.normal_words(t))), -i)
                         for i, (f, t) in enumerate(ls.TEMPLATES) if f == predicted)
    sure = probability >= ls.MIN_PROBABILITY and overlap >= ls.MIN_OVERLAP
    return predicted, probability, predicted if sure else ls.UNKNOWN, -minus, overlap


def _scan(model, doc_id, text):
    lines = [x.lstrip(ls.MARKS_BEFORE).rstrip(ls.MARKS_AFTER) for x in (text or "").split("\n")]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end]:
            end += 1
        if end > at:
            yield from _scan_run(model, doc_id, at, lines[at:end])
        at = end + 1


def _scan_run(model, doc_id, at, lines):
    singles = [(at + i, _best(model, g)) for i, x in enumerate(lines) if (g := _features(x))]
    singles = [(i, b) for i, b in singles if b]
    named = {b[2] for _, b in singles if b[2] != ls.UNKNOWN}
    whole = None
    if len(lines) > 1 and (g := _features("".join(x if x.endswith("-") else x + " " for x in lines))):
        whole = _best(model, g)
        if whole and (whole[2] == ls.UNKNOWN or whole[2] in named):
            whole = None
    for i, b in [(at, whole)] if whole else []:
        yield (doc_id, i, b[2], b[0], round(b[1], 5), b[3], round(b[4], 5))
    for i, b in singles:
        if not whole or b[2] != ls.UNKNOWN:
            yield (doc_id, i, b[2], b[0], round(b[1], 5), b[3], round(b[4], 5))


def _texts(seed):
    rng = random.Random(seed)
    filler = "the terms of this work are in the book you may read by permission of the version".split()
    out = [None, "", "\n\n", "Licensed", "(the) License, \x0b\tVersion\x0c2.0", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."]
    for _, t in ls.TEMPLATES:
        words = t.split()
        cut = rng.randint(1, len(words))
        filled = " ".join(rng.choices(filler, k=12))
        notice = "\n".join(" * " + x for x in textwrap.wrap(t, rng.choice([25, 60])))
        out += [f"{filled}\n{t}\n{filled}", f"{filled}\n\n/*\n{notice}\n */\n{filled}", " ".join(words[:cut]),
                " ".join(w for w in words if rng.random() < 0.8), f"{t} {rng.choice(ls.TEMPLATES)[1]}"]
    out.append(" ".join(rng.choices(filler, k=40_000)) + " " + ls.TEMPLATES[0][1])
    out.append("\n".join(rng.choice(["", ls.TEMPLATES[4][1], "a line of the book", "/* */"]) for _ in range(4_000)))
    return out


def test_scan_equals_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(_texts(8))] + [(None, ls.TEMPLATES[3][1], "clash"), (5, ls.TEMPLATES[9][1], "clash")]
    docs = spark.createDataFrame(rows, DOCS)
    model = ls.train(spark, docs)
    got = sorted((r.doc_id is None, r.doc_id, r.paragraph, r.family, r.predicted, round(r.probability, 5), r.template, round(r.overlap, 5))
                 for r in ls.scan(docs, model).collect())
    want = sorted((i is None, i, *rest) for r in rows for i, *rest in _scan(model, r[0], r[1]))
    assert len(got) == len(want) > 1000
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[6] == w[6] and abs(g[5] - w[5]) < 3e-5 and abs(g[7] - w[7]) < 3e-5


def test_training_lines_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(ls, "TRAIN_DOCS", 3)
    monkeypatch.setattr(ls, "TRAIN_LINES", 4)
    rows = [(i, f"line {i} one\n{'word ' * 3000}of the license {i}\nthe work", "x") for i in range(20)]
    lines = ls._training_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert len(lines) == 4 and any("the license" in r.grams for r in lines)
