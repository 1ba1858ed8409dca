"""Document quality from a linear-chain conditional random field over lines.

Every line that has a word is a node, labelled good or bad.  State features are the line's own
figures and those of the line before and after it; two transition weights couple neighbours.
The field is trained on labelled documents, whose lines carry the document's label.  A
document's raw score is the mean of its lines' forward-backward marginals, weighted by line
length; a two-parameter logistic fit on the training documents turns it into a probability.

Training reads at most TRAIN_DOCS labelled documents (those of least hash), none of the
held-out fifth, and at most TRAIN_LINES lines of each, spread over
the whole text.  Scoring reads whole texts.

Defined results: a null text counts as ''; a text without words is one line without words;
null labels and labels without a document are not used; if no document of one of the classes
is labelled, every score is the share of good labels (0.5 without labels).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import spread

TRAIN_DOCS = 3000
TRAIN_LINES = 200
THRESHOLD = 0.3
STEPS = 150
RIDGE = 1e-3

#: Byte classes that are counted in a line.
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
                             b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}-_/\\@+=~^`"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:192] = 8  # bytes that continue a character
_CLASS[192:] = 9
N_OWN = 17


def line_figures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_OWN) figures of the lines with a word, and the lines' lengths in bytes."""
    lines = [x for x in (text or "").encode("utf-8").split(b"\n") if x.split()] or [b""]
    n = len(lines)
    size = np.array([len(x) for x in lines], dtype=np.float64)
    words = np.empty(n)
    distinct = np.empty(n)
    longest = np.empty(n)
    upper_first = np.empty(n)
    marks_end = np.empty(n)
    for i, x in enumerate(lines):
        w = x.split()
        s = set(w)
        words[i], distinct[i] = len(w), len(s)
        longest[i] = max(map(len, s), default=0)
        upper_first[i] = x[:1].isupper()
        marks_end[i] = x.rstrip()[-1:] in (b".", b"!", b"?")
    # lines stand end to end; class counts of each line from one histogram
    codes = _CLASS[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    row = np.repeat(np.arange(n), size.astype(np.int64))
    count = np.bincount(row * 10 + codes, minlength=10 * n).reshape(n, 10).astype(np.float64)
    chars = np.maximum(size - count[:, 8], 1)
    letters = count[:, 1] + count[:, 2] + count[:, 9]
    seen: set[bytes] = set()
    again = np.zeros(n)
    for i, x in enumerate(lines):
        again[i] = x in seen
        seen.add(x)
    some = np.maximum(words, 1)
    share = count / chars[:, None]
    own = np.stack([
        np.log1p(words), np.log1p(chars), letters / some / 10, longest / 20,
        count[:, 1] / np.maximum(letters, 1), np.sqrt(share[:, 3]), np.sqrt(share[:, 4]), np.sqrt(share[:, 5]),
        np.sqrt(share[:, 6]), np.sqrt(share[:, 7]), share[:, 9], np.minimum(count[:, 4] / some, 2),
        np.minimum(count[:, 5] / some, 2), 1 - distinct / some, np.log1p(words - distinct), again,
        upper_first + marks_end], axis=1)
    return own, size + 1


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own figures, those of the line before and after, and marks of the first and last line."""
    n = len(own)
    edge = np.zeros((n, 2))
    edge[0, 0] = edge[-1, 1] = 1
    before = np.vstack([own[:1], own[:-1]])
    after = np.vstack([own[1:], own[-1:]])
    return np.hstack([own, before - own, after - own, edge, np.ones((n, 1))])


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, coupling: np.ndarray):
    """Chains laid end to end in ``scores`` (good minus bad, per line).  ``coupling``: weight
    of two neighbours being both bad, and both good.  Returns per line the marginal of good,
    and the probabilities (2, lines) that it and the line before it are both bad, or both good.
    All chains advance together, one line a step."""
    n = len(scores)
    trans = np.array([[coupling[0], 0.0], [0.0, coupling[1]]])
    unary = np.stack([np.zeros(n), scores], axis=1)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alpha, beta = unary.copy(), np.zeros((n, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        at = starts[:active[t]] + t
        alpha[at] += np.logaddexp.reduce(alpha[at - 1][:, :, None] + trans[None], axis=1)
    for t in range(longest - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        beta[at] = np.logaddexp.reduce(trans[None] + (unary[at + 1] + beta[at + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(alpha[starts + lengths - 1], axis=1)
    norm = np.empty(n)
    norm[np.concatenate([np.arange(s, s + k) for s, k in zip(starts, lengths)]) if n else []] = np.repeat(total, lengths)
    good = np.exp(alpha[:, 1] + beta[:, 1] - norm)
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    both = np.zeros((2, n))
    for k in (0, 1):
        both[k, i] = np.exp(alpha[i - 1, k] + trans[k, k] + unary[i, k] + beta[i, k] - norm[i])
    return good, both


def _chains(lengths) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(lengths, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths


def train(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """``docs``: (own figures, line lengths, label 0 or 1).  Returns the field's weights."""
    labels = np.array([y for _, _, y in docs])
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5}
    x = np.vstack([with_neighbours(own) for own, _, _ in docs])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    starts, lengths = _chains([len(own) for own, _, _ in docs])
    y = np.repeat(labels, lengths).astype(float)
    # both classes weigh the same, and so does every document
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    per_line = np.repeat(weight / lengths, lengths)
    wide, coupling = np.zeros(x.shape[1]), np.zeros(2)
    moment, square = np.zeros(len(wide) + 2), np.zeros(len(wide) + 2)
    same = np.array([((lengths - 1) * weight / lengths)[labels == k].sum() for k in (0, 1)])
    for step in range(1, STEPS + 1):
        good, both = forward_backward(x @ wide, starts, lengths, coupling)
        grad = np.concatenate([x.T @ (per_line * (good - y)) + RIDGE * wide, both @ per_line - same + RIDGE * coupling])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        wide, coupling = wide - move[:-2], coupling - move[-2:]
    model = {"mean": mean, "scale": scale, "wide": wide, "coupling": np.clip(coupling, -3, 3)}
    raw = raw_scores(model, [(own, size) for own, size, _ in docs])
    return model | dict(zip(("slope", "shift"), _calibrate(raw, labels)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def _calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the raw score's logit, by Newton steps."""
    z = np.stack([_logit(raw), np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, z.T @ (p - labels) + 1e-3 * (w - [1, 0])), -2, 2)
    return float(w[0]), float(w[1])


def raw_scores(model: dict, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length-weighted mean marginal of each document."""
    starts, lengths = _chains([len(own) for own, _ in docs])
    x = np.vstack([with_neighbours(own) for own, _ in docs])
    good, _ = forward_backward(((x - model["mean"]) / model["scale"]) @ model["wide"], starts, lengths, model["coupling"])
    size = np.concatenate([s for _, s in docs])
    return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)


def score_documents(model: dict, texts: list[str | None]) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    out = []
    for i in range(0, len(texts), 256):
        raw = raw_scores(model, [line_figures(t) for t in texts[i:i + 256]])
        out.append(1 / (1 + np.exp(-np.clip(model["slope"] * _logit(raw) + model["shift"], -30, 30))))
    return np.concatenate(out) if out else np.empty(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on labelled documents outside the held-out fifth."""
    chosen = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("_least"))
              .where("quality = _least AND quality IN (0, 1)").select("doc_id", "quality")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS))

    def figures(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for y, t in zip(b.column("quality").to_pylist(), b.column("text").to_pylist()):
                own, size = line_figures(t)
                at = spread(len(size), TRAIN_LINES)
                rows.append((y, own[at].astype("<f8").tobytes(), size[at].astype("<f8").tobytes()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.binary())], names=["y", "own", "size"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most TRAIN_DOCS rows
    rows = sample.select(F.col("quality").cast("int"), "text").mapInArrow(figures, "y int, own binary, size binary").collect()
    rows = sorted((r.y, bytes(r.own), bytes(r.size)) for r in rows)
    return train([(np.frombuffer(own).reshape(-1, N_OWN), np.frombuffer(size), y) for y, own, size in rows])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``score`` (double) and ``predicted`` (int).  Extra columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(score_documents(shared.value, text.tolist()))

    out = docs.withColumn("score", score(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with their own columns."""
    inner = docs.select(F.struct("*").alias("_row"), "text")
    return scored(inner, fit(train_docs, labels)).where("predicted = 1").select("_row.*")
