"""Language-model scoring with a hierarchical Pitman-Yor model.

Every previous word has a restaurant (a text starts after the end token); a customer is a training
token, a dish a word.  All context restaurants share the root as parent: each of their tables is a
customer there.  The root draws from a diffuse base, so a word has one table there, and what the
root keeps for new tables is the probability of the class of unknown words.  Discounts come from
the counts of once and twice seen dishes; the strengths are parameters.

Gibbs sampling: in a sweep all customers of one dish in one restaurant stand up and are seated anew
by the Chinese-restaurant rule; the seating is taken or refused by the Metropolis ratio of its
weights.  The waiting time to the next new table is drawn at once, so a dish costs its tables, not
its customers.  All dishes are resampled in parallel, given the tables and the root of the sweep
before.  Predictive probabilities are averaged over the sampled sweeps, and the perplexity of a text
comes from them.

How the work is laid out: documents are coded once into blocks of about BLOCK_CHARS characters.
Blocks ask for words and word pairs by bucket, with one packed row per (block, bucket) that holds
each distinct key once: a frequent word or pair is one key of a block however often it occurs, and
buckets deal keys by hash, so neither a hot context nor a hot word gathers anywhere.  A bucket sums
the blocks' training counts, keeps the seating of its word pairs as arrays, and asks the buckets of
the words for the restaurants' and the root's totals.  The number of buckets grows with the tokens,
so a bucket's size does not; the number of rows never exceeds that of distinct keys per block or
bucket.  The driver sees totals only.  Word counts are exact (strings); vocabularies of 2^32 words and more are refused.

Defined results: a null text is empty and has the end token only; a null doc_id counts as ''; repeated
rows each count and are each scored; without training documents each probability is one; a very
long text is a block of its own; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import drop_table, staged

FOLDS = 5
HELD_OUT = 1
BLOCK_CHARS = 1 << 23
#: Tokens of the corpus for each bucket of word pairs, and for each bucket of words.
PAIR_BUCKET = 1_000_000
WORD_BUCKET = 2_000_000
STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 3
SEED = 13
#: So few dishes are seated one after another rather than together; the rule is the same.
FEW = 400
MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, data binary, words binary, tokens long"
ASKS = "bucket long, block long, data binary, words binary"
WORDS = "bucket long, block long, data binary, v long, n long"
PAIRS = "bucket long, block long, data binary"
STATES = "bucket long, block long, data binary, once binary, n1 long, n2 long"
TOTALS = "bucket long, source long, data binary, customers long, n1 long, n2 long"
ANSWERS = "block long, bucket long, kind string, data binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, perplexity double")


def _narrow(a: np.ndarray) -> np.ndarray:
    """The array in the least unsigned type that holds it."""
    top = int(a.max()) if len(a) and a.min() >= 0 else None
    kind = next((k for k, end in (("u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32)) if top is not None and top < end), a.dtype)
    return a.astype(kind, copy=False)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one zstandard frame, in narrow types and with their byte planes apart."""
    import zstandard

    small = [_narrow(a) for a in arrays]
    head = json.dumps([(x.dtype.str, a.dtype.str, len(a)) for x, a in zip(small, arrays)]).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in small]
    return zstandard.compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for small, kind, n in json.loads(raw[4:at]):
        size = np.dtype(small).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(small).reshape(n).astype(kind, copy=False))
        at += n * size
    return out


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(n).to_pylist() for n in names))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, ascending positions) of every bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    starts = np.nonzero(np.r_[True, np.diff(bucket[order]) != 0])[0] if len(order) else []
    for part in np.split(order, starts[1:]) if len(order) else ():
        yield int(bucket[part[0]]), part


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % FOLDS


# --- documents to blocks -------------------------------------------------------------------

class _Codes(dict):
    """Word -> code in order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, chars = TaskContext.get().partitionId() << 24, 0
    codes, ids, texts = _Codes({b"": 0}), [], []

    def row():
        lens = np.array([len(t) for t in texts], np.int64)
        seq = np.concatenate(texts)
        known = np.array([0 if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], np.uint8)
        learn = np.repeat(np.array([fold(i) != HELD_OUT for i in ids]), lens)
        train = np.bincount(seq[learn], minlength=len(codes))
        return _table(BLOCKS, [(number, pack(known, null, lens, seq, train), b" ".join(codes), len(seq))])

    for b in batches:
        for doc_id, text in _rows(b, "doc_id", "text"):
            # bytes: lower() and split() know ASCII letters and white space only
            words = (text or b"").lower().split()
            words.append(b"")
            ids.append(doc_id)
            texts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
            chars += len(text or b"") + 1
            if chars > BLOCK_CHARS:
                yield from row().to_batches()
                number, chars, codes, ids, texts = number + 1, 0, _Codes({b"": 0}), [], []
    if ids:
        yield from row().to_batches()


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data, joined in _rows(b, "block", "data", "words"):
                words, train = joined.split(b" "), unpack(data)[4]
                at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                rows = [(k, block, pack(part.astype(np.uint32), train[part]), b" ".join([words[i] for i in part.tolist()]))
                        for k, part in _dealt(at)]
                yield from _table(ASKS, rows).to_batches()
    return run


def _count_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        asked, local = [], _Codes()
        for bucket, block, data, joined in _rows(table, "bucket", "block", "data", "words"):
            words, (codes, train) = joined.split(b" "), unpack(data)
            asked.append((block, codes, train, np.fromiter(map(local.__getitem__, words), np.int64, len(words))))
        c = np.zeros(len(local), np.int64)
        for _, _, train, at in asked:
            c[at] += train
        known = sorted(w for w, n in zip(local, c.tolist()) if n)
        number = np.full(len(local), -1, np.int64)
        number[[local[w] for w in known]] = np.arange(len(known)) * buckets + bucket
        rows = [(bucket, block, pack(codes, number[at], c[at]), None, None) for block, codes, _, at in asked]
        rows.append((bucket, None, None, len(known), int(c.sum())))
        return _table(WORDS, rows)
    return run


# --- word pairs ----------------------------------------------------------------------------

def _pairs(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (previous word, word) keys of known words, ascending; the tokens that have one,
    and the position of their key."""
    word = ids[seq]
    before = np.r_[ids[:1], word[:-1]]
    have = np.nonzero((word >= 0) & (before >= 0))[0]
    keys, place = np.unique((before[have].astype(np.uint64) << np.uint64(32)) | word[have].astype(np.uint64), return_inverse=True)
    return keys, have, place


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * MIX) >> np.uint64(33)).astype(np.int64) % buckets


def _ask_pairs(buckets: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for block, data in _rows(blocks, "block", "data"):
            doc, null, lens, seq, train = unpack(data)
            ids = np.full(len(train), -1, np.int64)
            for (a,) in _rows(answers, "data"):
                codes, number, _ = unpack(a)
                ids[codes] = number
            keys, have, place = _pairs(seq, ids)
            learn = np.array([fold(None if x else d) != HELD_OUT for d, x in zip(doc.tolist(), null.tolist())], bool)
            n = np.bincount(place[np.repeat(learn, lens)[have]], minlength=len(keys))
            rows += [(k, block, pack(np.diff(keys[part], prepend=np.uint64(0)), n[part]))
                     for k, part in _dealt(_bucket_of(keys, buckets))]
        return _table(PAIRS, rows)
    return run


def _count_pairs(table: pa.Table) -> pa.Table:
    """Per block the number of each asked pair (0: not in training, 1: once, from 2 on: place in the
    bucket's list), and the bucket's first state: one table for each dish of several customers.  A
    dish with one customer has one table for good; those go into the totals once."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    parts = [unpack(d) for (d,) in _rows(table, "data")]
    asked = [np.cumsum(k) for k, _ in parts]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    c = np.zeros(len(keys), np.int64)
    np.add.at(c, place, np.concatenate([n for _, n in parts]))
    many, once = c > 1, keys[c == 1]
    number = np.where(many, np.cumsum(many) + 1, c).astype(np.uint32)
    ends = np.cumsum([len(a) for a in asked])
    rows = [(bucket, b, pack(p), None, None, None) for b, p in zip(blocks, np.split(number[place], ends[:-1]))]
    keys, c = keys[many], c[many]
    state = pack(*_halves(keys), c, np.ones(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(0, np.int64))
    rows.append((bucket, None, state, pack(*_halves(once)), len(once), int((c == 2).sum())))
    return _table(STATES, rows)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)


# --- Chinese-restaurant seating ------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after seven steps up)."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7.0
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(low)


def _openings(c: int, n: int, t: int, a: float, p: float, d: float, rng: np.random.Generator) -> Iterator[int]:
    """The rule of :func:`seat` for one dish, from customer ``n`` at ``t`` tables on."""
    while n < c:
        g, shift = (a + d * t) * p, 1 - d * t
        start = math.lgamma(n + shift - 1) - math.lgamma(n + shift - 1 + g)

        def old(upto: int) -> float:
            return math.lgamma(upto + shift) - math.lgamma(upto + shift + g) - start

        u = math.log(1 - rng.random())
        if old(c - 1) >= u:
            return
        # old(m) is close to -g log of the ratio of places; widen around that guess, then halve
        half = shift + (g - 1) / 2
        guess = (n - 1 + half) * math.exp(min(-u / g, 50.0)) - half
        lo = hi = min(max(int(guess), n), c - 1)
        step = 1
        while hi < c - 1 and old(hi) >= u:
            lo, hi, step = hi + 1, min(hi + step, c - 1), 2 * step
        step = 1
        while lo > n and old(lo - 1) < u:
            lo, hi, step = max(lo - step, n), lo - 1, 2 * step
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if old(mid) < u else (mid + 1, hi)
        yield lo
        n, t = lo + 1, t + 1


def seat(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats ``c`` customers of a dish one after another: a new table with weight (a + d t) p, an old
    one with n - d t.  Returns (row, customer) of those that opened a table, but for customer 0."""
    rows, cuts = [], []
    row = np.nonzero(c > 1)[0]
    n, t = np.ones(len(row), np.int64), np.ones(len(row))
    while len(row) > FEW:
        g = (a[row] + d * t) * p[row]
        last = c[row] - 1

        def old(upto, g=g, n=n, t=t):
            """log probability that customers n..upto all sit at old tables."""
            x, y = n - d * t, upto + 1 - d * t
            return log_gamma(y) - log_gamma(x) - log_gamma(y + g) + log_gamma(x + g)

        u = np.log(rng.random(len(row)))
        opens = old(last) < u
        row, n, t, g, u, hi = row[opens], n[opens], t[opens], g[opens], u[opens], last[opens]
        lo = n.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            under = old(mid, g, n, t) < u
            lo, hi = np.where(under, lo, mid + 1), np.where(under, mid, hi)
        rows.append(row)
        cuts.append(lo)
        more = lo + 1 < c[row]
        row, n, t = row[more], lo[more] + 1, t[more] + 1
    for r, start, k in zip(row.tolist(), n.tolist(), t.tolist()):
        own = np.fromiter(_openings(int(c[r]), start, int(k), float(a[r]), float(p[r]), d, rng), np.int64)
        rows.append(np.full(len(own), r))
        cuts.append(own)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    cut = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    order = np.lexsort((cut, row))
    return row[order], cut[order]


def log_weight(c: np.ndarray, row: np.ndarray, cut: np.ndarray, a: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
    """log of the product of the normalisers met while seating as (row, cut) says."""
    t = np.bincount(row, minlength=len(c)) + 1
    of = np.repeat(np.arange(len(c)), t)
    first = np.cumsum(t) - t
    k = np.arange(len(of)) - first[of] + 1
    start, end = np.ones(len(of), np.int64), np.empty(len(of), np.int64)
    start[k > 1] = cut + 1
    end[first + t - 1] = c - 1
    end[k < t[of]] = cut
    z = (a[of] + d * k) * p[of] - d * k
    return np.bincount(of, log_gamma(end + 1 + z) - log_gamma(start + z), minlength=len(c))


def resample(c, t, cuts, tables, parent, d, strength, rng):
    """One blocked Gibbs step for each dish; returns tables and openings.  ``tables``: all tables of
    the dish's restaurant, ``parent``: probability of the dish at the root."""
    a = strength + d * (tables - t)
    # the second of two customers: both seatings have the same weight, so each is taken
    two, many = np.nonzero(c == 2)[0], np.nonzero(c > 2)[0]
    g = (a[two] + d) * parent[two]
    row = np.repeat(np.arange(len(c)), t - 1)
    was, cuts = np.searchsorted(many, row[c[row] > 2]), cuts[c[row] > 2]
    n, a, p = c[many], a[many], parent[many]
    new_row, new_cut = seat(n, a, p, d, rng)
    gain = log_weight(n, new_row, new_cut, a, p, d) - log_weight(n, was, cuts, a, p, d)
    taken = np.log(1 - rng.random(len(many))) < gain
    opened = two[rng.random(len(two)) * (1 - d + g) < g]
    row = np.r_[opened, many[was[~taken[was]]], many[new_row[taken[new_row]]]]
    cuts = np.r_[np.ones(len(opened), np.int64), cuts[~taken[was]], new_cut[taken[new_row]]]
    return 1 + np.bincount(row, minlength=len(c)), cuts[np.lexsort((cuts, row))]


# --- totals of restaurants and root --------------------------------------------------------

def _ask_totals(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, data in _rows(b, "bucket", "data"):
                u, w, *seated = unpack(data)
                c, t = seated[:2] if seated else [np.ones(len(u))] * 2
                (us, ui), (ws, wi) = (np.unique(x, return_inverse=True) for x in (u, w))
                size, tables, customers = np.bincount(ui, c), np.bincount(ui, t), np.bincount(wi, t)
                contexts = dict(_dealt((us % np.uint64(buckets)).astype(np.int64)))
                words = dict(_dealt((ws % np.uint64(buckets)).astype(np.int64)))
                none = np.zeros(0, np.int64)
                for k in sorted(contexts.keys() | words.keys()):
                    i, j = contexts.get(k, none), words.get(k, none)
                    rows.append((k, source, pack(us[i], size[i].astype(np.int64), tables[i].astype(np.int64),
                                                 ws[j], customers[j].astype(np.int64)), None, None, None))
            yield from _table(TOTALS, rows).to_batches()
    return run


def _sum_totals(asked: pa.Table, fixed: pa.Table) -> pa.Table:
    """Answers to the buckets that asked, and the totals themselves, those of the dishes with one
    customer (``fixed``) included."""
    bucket = (asked if asked.num_rows else fixed).column("bucket")[0].as_py()
    parts = [(s, *unpack(d)) for s, d in _rows(asked, "source", "data")] + [(None, *unpack(d)) for (d,) in _rows(fixed, "data")]
    us, ui = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    ws, wi = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)

    def total(at, inverse, n):
        out = np.zeros(n, np.int64)
        np.add.at(out, inverse, np.concatenate([p[at] for p in parts]))
        return out

    size, tables, customers = total(2, ui, len(us)), total(3, ui, len(us)), total(5, wi, len(ws))
    rows, i, j = [], 0, 0
    for p in parts:
        k, m = i + len(p[1]), j + len(p[4])
        if p[0] is not None:
            rows.append((p[0], bucket, pack(tables[ui[i:k]], customers[wi[j:m]]), None, None, None))
        i, j = k, m
    rows.append((bucket, None, pack(us, size, tables, ws, customers), int(customers.sum()),
                 int((customers == 1).sum()), int((customers == 2).sum())))
    return _table(TOTALS, rows)


def _sum_fixed(asked: pa.Table) -> pa.Table:
    return _sum_totals(asked, asked.slice(0, 0))


def _sweep(buckets: int, d: float, root_d: float, root_n: int, strength: float, number: int, kept: bool):
    def run(states: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for bucket, data in _rows(states, "bucket", "data"):
            u, w, c, t, seen, cuts = unpack(data)
            (us, ui), (ws, wi) = (np.unique(x, return_inverse=True) for x in (u, w))
            tables, customers = np.zeros(len(us), np.int64), np.zeros(len(ws), np.int64)
            contexts = dict(_dealt((us % np.uint64(buckets)).astype(np.int64)))
            words = dict(_dealt((ws % np.uint64(buckets)).astype(np.int64)))
            for k, a in _rows(answers, "source", "data"):
                of_u, of_w = unpack(a)
                if len(of_u):
                    tables[contexts[k]] = of_u
                if len(of_w):
                    customers[words[k]] = of_w
            parent = (customers - root_d) / (strength + root_n)
            rng = np.random.default_rng([SEED, number, bucket])
            t, cuts = resample(c, t, cuts, tables[ui], parent[wi], d, strength, rng)
            rows.append((bucket, None, pack(u, w, c, t, seen + t if kept else seen, cuts), None, None, None))
        return _table(STATES, rows)
    return run


# --- scores --------------------------------------------------------------------------------

def _answer_words(samples: int):
    def run(asked: pa.Table, totals: pa.Table) -> pa.Table:
        sampled = [unpack(d) for _, d in sorted(_rows(totals, "sample", "data"))]
        # a bucket without known words has no totals
        sampled = sampled or [[np.zeros(0, np.int64)] * 5] * samples
        us, size, _, ws, _ = sampled[0]  # every sample has the same restaurants and words
        rows = []
        for bucket, block, data in _rows(asked, "bucket", "block", "data"):
            codes, ids, c = unpack(data)
            key = np.maximum(ids, 0).astype(np.uint64)

            def at(keys):
                """(position, there or not) of each word in ``keys``."""
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                return i, (keys[i] == key) & (ids >= 0)

            out = [np.zeros(len(ids), np.int64)] * (1 + 2 * samples)
            if len(us):
                (i, is_u), (j, is_w) = at(us), at(ws)
                out = [np.where(is_u, size[i], 0)]
                for _, _, tables, _, customers in sampled:
                    out += [np.where(is_u, tables[i], 0), np.where(is_w, customers[j], 0)]
            rows.append((block, bucket, "word", pack(codes, ids, c, *out)))
        return _table(ANSWERS, rows)
    return run


def _answer_pairs(samples: int):
    def run(asked: pa.Table, states: pa.Table) -> pa.Table:
        _, _, c, _, seen, _ = unpack(states.column("data")[0].as_py())
        c, seen, rows = np.r_[0, 1, c], np.r_[0, samples, seen], []
        for bucket, block, data in _rows(asked, "bucket", "block", "data"):
            (number,) = unpack(data)
            rows.append((block, bucket, "pair", pack(c[number], seen[number])))
        return _table(ANSWERS, rows)
    return run


def _score(buckets: int, d: float, root_d: float, root_n: list[int], strength: float, v: int, n: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for (data,) in _rows(blocks, "data"):
            doc, null, lens, seq, train = unpack(data)
            size = len(train)
            ids, c = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            back, root = (np.ones((len(root_n), size)) for _ in range(2))
            customers = np.zeros(size, np.int64)
            pairs = {}
            for bucket, kind, a in _rows(answers, "bucket", "kind", "data"):
                a = unpack(a)
                if kind == "pair":
                    pairs[bucket] = a
                    continue
                codes, of = a[0], a[3]
                ids[codes], c[codes], customers[codes] = a[1], a[2], of
                for s, total in enumerate(root_n):
                    tables, at_root = a[4 + 2 * s:6 + 2 * s]
                    back[s, codes] = np.where(of > 0, (strength + d * tables) / (strength + of), 1.0)
                    root[s, codes] = np.where(at_root > 0, at_root - root_d, strength + root_d * v) / (strength + total)
            before = np.r_[np.zeros(1, seq.dtype), seq[:-1]]
            p = sum(b[before] * r[seq] for b, r in zip(back, root)) / len(root_n)
            keys, have, place = _pairs(seq, ids)
            own = np.zeros(len(keys))
            for k, part in _dealt(_bucket_of(keys, buckets)):
                own[part] = pairs[k][0] - d * pairs[k][1] / len(root_n)
            p[have] += own[place] / (strength + customers[before[have]])
            first = np.cumsum(lens) - lens
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[seq]
            columns = zip(doc.tolist(), null.tolist(), lens.tolist(), np.add.reduceat((c > 0)[seq].astype(np.int64), first).tolist(),
                          np.add.reduceat(base, first).tolist(), np.add.reduceat(np.log10(p), first).tolist())
            for i, missing, m, known, b, score in columns:
                i = None if missing else i
                rows.append((i, fold(i) == HELD_OUT, m, known, n, b, score, 10 ** min(-score / m, 300.0)))
        return _table(SCORES, rows)
    return run


def discount(once: int, twice: int) -> float:
    """Discount from the numbers of dishes with one and with two customers."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def scores(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of
    every document, learnt from the documents that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = staged(texts.mapInArrow(_blocks, BLOCKS), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    pair_buckets, buckets = (1 + tokens // n for n in (PAIR_BUCKET, WORD_BUCKET))
    asks = blocks.select("block", "data", "words").mapInArrow(_ask_words(buckets), ASKS)
    words = staged(asks.groupBy("bucket").applyInArrow(_count_words(buckets), WORDS), "words")
    v, n = words.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = words.agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]
    if top * buckets >= 1 << 32:
        raise ValueError("2^32 words or more: word numbers no longer fit half a pair key")
    asked_words = words.where(F.col("block").isNotNull()).select("bucket", "block", "data")

    pairs = blocks.select("block", "data").groupBy("block").cogroup(asked_words.groupBy("block")).applyInArrow(_ask_pairs(pair_buckets), PAIRS)
    counted = staged(pairs.groupBy("bucket").applyInArrow(_count_pairs, STATES), "pairs")
    asked_pairs = counted.where(F.col("block").isNotNull()).select("bucket", "block", "data")
    states = counted.where(F.col("block").isNull())
    n1, n2 = states.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first()
    d, root_d, root_n, sampled = discount(n1, n2), None, [], []
    once = states.select("bucket", F.col("once").alias("data")).mapInArrow(_ask_totals(buckets), TOTALS)
    fixed = once.groupBy("bucket").applyInArrow(_sum_fixed, TOTALS).where(F.col("source").isNull())
    fixed = staged(fixed.select("bucket", "data"), "fixed_totals")
    for sweep in range(burn_in + samples + 1):
        asked = states.select("bucket", "data").mapInArrow(_ask_totals(buckets), TOTALS).select("bucket", "source", "data")
        totals = staged(asked.groupBy("bucket").cogroup(fixed.groupBy("bucket")).applyInArrow(_sum_totals, TOTALS), f"totals{sweep}")
        own = totals.where(F.col("source").isNull())
        customers, n1, n2 = own.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "n1", "n2"))).first()
        root_d = discount(n1, n2) if root_d is None else root_d
        if sweep > burn_in:
            root_n.append(customers)
            sampled.append(own.select("bucket", F.lit(sweep).alias("sample"), "data"))
        if sweep < burn_in + samples:
            step = _sweep(buckets, d, root_d, customers, strength, sweep, sweep >= burn_in)
            answers = totals.where(F.col("source").isNotNull()).select("bucket", "source", "data")
            before, states = states, staged(states.select("bucket", "data").groupBy("bucket").cogroup(answers.groupBy("bucket"))
                                            .applyInArrow(step, STATES), f"states{sweep}")
            if sweep:
                drop_table(before)
        if sweep <= burn_in:
            drop_table(totals)

    every = sampled[0]
    for s in sampled[1:]:
        every = every.unionByName(s)
    found = asked_words.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(_answer_words(samples), ANSWERS)
    final = states.select("bucket", "data")
    found = found.unionByName(asked_pairs.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(_answer_pairs(samples), ANSWERS))
    score = _score(pair_buckets, d, root_d, root_n, strength, v, n)
    return blocks.select("block", "data").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, SCORES)
