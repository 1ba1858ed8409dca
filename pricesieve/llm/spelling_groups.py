"""Spelling variant grouping: words at edit distance one, found with a bit-sliced position index.

Words are counted per task and then summed.  Candidates come from zones: two words that differ by
one inserted, deleted or replaced letter agree before and after the place of the edit, the length
of their common prefix.  For the shorter length m the places 0..m-1 (an edit at the end counts as
place m-1's zone) are cut into halves, and a word joins the group (m, zone, letters before, letters
after) of each zone, for m its own length and one less.  A group above GROUP words is cut again at
the middle of its zone, down to single places, so no group grows with a common beginning, and every
pair meets in exactly one group.

Inside a group the index holds one bitset over the group's words per (position, letter) of the zone
and one per length.  A word runs over it with four bitsets: no error so far, one letter replaced, one
letter of its own skipped, one letter of theirs skipped; the latter two read the index at the position
before and after, and all words of the group advance at once.  Each word carries on only its number
of near words and the best of them, so no pair leaves a group.

Forms lead to words at least twice as frequent, so chains are short (the logarithm of the largest
count) and pointer doubling reaches every root in a few joins.

Defined results: null and empty texts have no words; a null doc_id counts as '' in the hash;
repeated rows count each; ties of a form go to the smaller word in code-point order; extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import staged

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Only A-Z; letters above ASCII keep their case.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
TYPO_EVERY = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 2
#: Words in one index; larger groups are cut again.
GROUP = 16_384
#: Entries of a task's counter before it is sent on.
COUNTED = 500_000

COUNTS = "word string, n long"
NEAR = "word string, n_near long, best struct<m: long, form: string>"


def _with_slips(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text after the seeded deletions."""
    head = b"%d:" % doc_id if doc_id is not None else b":"
    lowered: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        lowered[run.translate(LOWER)] += n
    for word, n in lowered.items():
        if len(word) >= MIN_LENGTH:
            h = zlib.crc32(head + word.encode())
            if h % TYPO_EVERY == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < MIN_LENGTH:
                    continue
            yield word, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out():
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if text:
                for word, n in _with_slips(doc_id, text):
                    counts[word] += n
        if len(counts) > COUNTED:
            yield out()
            counts = Counter()
    yield out()


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of at least MIN_LENGTH letters and ``min_count`` occurrences, with ``n``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.mapInArrow(_count, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counts.where(F.col("n") >= min_count), "vocabulary")


def _zoned(words: DataFrame) -> DataFrame:
    """Adds the letters before and after the zone [lo, hi) of the shorter length m."""
    tail = F.col("m") - F.col("hi")
    return (words.withColumn("before", F.expr("substring(word, 1, lo)"))
            .withColumn("after", F.when(tail > 0, F.expr("right(word, m - hi)")).otherwise("")))


KEY = ["m", "lo", "hi", "before", "after"]


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    zones = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _zoned(rows.withColumn("zone", F.explode(zones)).select("word", "n", "m", "zone.lo", "zone.hi"))


def candidate_groups(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """Rows (word, n, key of a group): groups hold at most ``limit`` words, or one place."""
    length = F.length("word")
    whole = words.withColumn("m", F.explode(F.array(length, length - 1))).select(
        "word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))
    rows, done = _halves(whole), None
    while True:
        # hot groups: few rows (their number is at most rows / limit); Spark chooses the join by size
        hot = rows.where("hi - lo > 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > limit)
        hot = staged(hot.select(*KEY), "hot_groups")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(hot, KEY, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        rows = staged(_halves(rows.join(hot, KEY, "left_semi")), "zones")


class PositionIndex:
    """Bitsets over the slices of one group: per (position, letter), and per length."""

    def __init__(self, slices: list[str]):
        self.at: dict[tuple[int, str], int] = {}
        self.length: dict[int, int] = {}
        self.all = (1 << len(slices)) - 1
        for j, s in enumerate(slices):
            bit = 1 << j
            self.length[len(s)] = self.length.get(len(s), 0) | bit
            for cell in enumerate(s):
                self.at[cell] = self.at.get(cell, 0) | bit

    def near(self, query: str, size: int, at_end: bool) -> int:
        """Words one edit away: replaced and inserted letters for a query of ``size`` letters,
        a deleted letter for one of ``size`` + 1.  ``at_end``: the zone ends where the word
        does, so an extra letter after the last position counts here."""
        at = self.at.get
        if len(query) == size:
            exact, replaced, inserted = self.all, 0, 0
            for i, c in enumerate(query):
                here = at((i, c), 0)
                inserted = (inserted | exact) & at((i + 1, c), 0)
                replaced = replaced & here | exact & ~here
                exact &= here
                if not exact | replaced | inserted:
                    return 0
            inserted = inserted | exact if at_end else inserted & ~exact
            return replaced & self.length.get(size, 0) | inserted & self.length.get(size + 1, 0)
        exact, deleted, whole = self.all, 0, 0
        for i, c in enumerate(query):
            # a word of ``size`` letters that agrees with all but the last of the query
            whole = exact
            deleted = deleted & at((i - 1, c), 0) | exact
            exact &= at((i, c), 0)
            if not exact | deleted:
                return 0
        return (deleted if at_end else deleted & ~whole) & self.length.get(size, 0)


def _near_in_group(words: list[str], counts: list[int], m: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count, its least word) of the words with any."""
    if len(words) < 2:
        return
    size = hi - lo
    slices = [w[lo:len(w) - (m - hi)] for w in words]
    # bits by falling count, ties by code points: the lowest bit is the best form
    order = sorted(range(len(words)), key=lambda j: (-counts[j], words[j]))
    index = PositionIndex([slices[j] for j in order])
    for word, s in zip(words, slices):
        found = index.near(s, size, hi == m)
        if found:
            best = order[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), counts[best], words[best]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of every group; groups come whole and one after another."""
    key, words, counts, out = None, [], [], []

    def flush(rows):
        word, n, m, form = zip(*rows) if rows else ((), (), (), ())
        best = pa.StructArray.from_arrays([pa.array(m, pa.int64()), pa.array(form, pa.string())], ["m", "form"])
        return pa.record_batch([pa.array(word, pa.string()), pa.array(n, pa.int64()), best], ["word", "n_near", "best"])

    def near():
        return _near_in_group(words, counts, *key[:3]) if key else ()

    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in KEY))
        for k, word, n in zip(keys, b.column("word").to_pylist(), b.column("n").to_pylist()):
            if k != key:
                out.extend(near())
                key, words, counts = k, [], []
            words.append(word)
            counts.append(n)
        if len(out) > 10_000:
            yield flush(out)
            out = []
    out.extend(near())
    yield flush(out)


def near_words(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, n_near, best (count and least word) for every word with a near word."""
    groups = candidate_groups(words, limit).select(*KEY, "word", "n")
    found = groups.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_near, NEAR)
    best = F.min(F.struct((-F.col("best.m")).alias("m"), F.col("best.form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form, by pointer doubling."""
    steps = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(nxt, "root", "left")
        steps = staged(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variant_groups(docs: DataFrame, min_count: int = MIN_COUNT, limit: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the vocabulary."""
    words = vocabulary(docs, min_count)
    found = words.join(near_words(words, limit), "word", "left")
    form_n = -F.col("best.m")
    has = form_n >= FORM_RATIO * F.col("n")
    rows = staged(found.select(
        "word", F.when(has, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, form_n).alias("form_n")), "near_words")
    roots = _roots(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
