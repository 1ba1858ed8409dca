"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18 bits.  Every 23-bit
word lies within distance 3 of exactly one codeword of the binary Golay code.  The keys of a
word are the codewords of the word itself and of its 23 one-bit neighbours: six of them, or
one.  Two words that differ in at most two bits have a common midpoint within one bit of
both, so they share a key.

Pigeonhole: of at most two wrong bits in three segments, one segment has none.  So linked
fingerprints agree in one whole segment, and in a Golay key of another: (A, key B),
(B, key A) or (C, key A).  Candidates are joined on those keys and verified by bit distance.

Keys shared by more than MAX_KEY_GROUP fingerprints are not paired.  Their fingerprints are
linked through midpoints: fingerprints within two bits share one of their 65 words within
one bit, and words sharing such a midpoint are within two bits, so linking each to the least
fingerprint of the midpoint is exact and linear.

Defined results: a null text counts as ''; texts without a word have fingerprint zero; equal
rows share a component; rows with a null doc_id get components but never name one; ``keep_one`` goes by
rows, see there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import staged
from pricesieve.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42
#: Largest group of fingerprints with one key that is compared pair by pair.
MAX_KEY_GROUP = 64
#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101

_tables: dict[str, object] = {}


def golay_tables():
    """(syndromes of the three bytes of a word, leader of each syndrome, codewords to add to
    a word's own codeword to get its keys, by syndrome)."""
    import numpy as np

    if not _tables:
        def syndrome(word: int) -> int:
            for i in range(22, 10, -1):
                if word >> i & 1:
                    word ^= GENERATOR << (i - 11)
            return word

        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]),
                  *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        leader = np.zeros(2048, dtype=np.int64)
        for e in errors:
            leader[syndrome(e)] = e
        by_byte = np.array([[syndrome(v << 8 * k & 0x7FFFFF) for v in range(256)] for k in range(3)])
        keys = np.zeros((2048, 6), dtype=np.int64)
        for s in range(2048):
            e = int(leader[s])
            near = sorted({0} | {e ^ b ^ int(leader[syndrome(e ^ b)]) for b in bits})
            keys[s] = near + near[:1] * (6 - len(near))
        _tables.update(by_byte=by_byte, leader=leader, keys=keys)
    return _tables["by_byte"], _tables["leader"], _tables["keys"]


def golay_keys(words):
    """int64 array of 23-bit words -> (n, 6) codeword indices (12 message bits); words with
    one key repeat it."""
    by_byte, leader, keys = golay_tables()
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 127]
    own = words ^ leader[s]
    return (own[:, None] ^ keys[s]) >> 11


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the shingles' XXH64; A-Z lower-cased, ASCII white space separates."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    hashes = np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:])],
                      dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *names: str) -> DataFrame:
    """(doc_id, the long columns ``names``, fp long) of every row."""
    names = ("doc_id", *names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t) for t in b.column("text").to_pylist()]
            fps = pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), fps], names=[*names, "fp"])

    longs = [F.col(n).cast("long").alias(n) for n in names]
    return docs.select(*longs, "text").mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "fp")))


def keyed(distinct: DataFrame) -> DataFrame:
    """(fp) -> (key long, fp): the candidate keys of every fingerprint."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            a, b, c = fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF, fp >> 46 & 0x3FFFF
            ga, gb = golay_keys(a), golay_keys(b)
            key = np.concatenate([a[:, None] << 14 | gb << 2, b[:, None] << 14 | ga << 2 | 1,
                                  c[:, None] << 14 | ga << 2 | 2], axis=1)
            first = np.ones(key.shape, dtype=bool)
            for g in (0, 6, 12):  # a word with one key fills its row with it
                first[:, g + 1:g + 6] = key[:, g + 1:g + 6] != key[:, g:g + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first]), pa.array(np.repeat(fp, first.sum(axis=1)))], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b) links of a staged table of distinct fingerprints ``fp``: every pair within
    MAX_DISTANCE is joined by a path of links, and every link is within it."""
    keys = keyed(distinct)
    groups = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keys.join(groups, "key"), "shared_keys")
    small = shared.where(F.col("n") <= MAX_KEY_GROUP).select("key", "fp")
    other = small.select("key", F.col("fp").alias("b"))
    pairs = (small.withColumnRenamed("fp", "a").join(other, "key")
             .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
             .select("a", "b"))
    crowded = shared.where(F.col("n") > MAX_KEY_GROUP).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = crowded.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    through = near.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionAll(through).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    fps = staged(fingerprints(docs), "fingerprints")
    least = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    comps = connected_components(fingerprint_links(least))
    roots = least.join(comps.withColumnRenamed("node", "fp"), "fp")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (roots.join(ids, "root").select("fp", "component_id")
             .unionAll(least.join(comps, F.col("fp") == F.col("node"), "left_anti")
                       .select("fp", F.col("least").alias("component_id"))))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component with its columns: that of the smallest doc_id, rows without one
    last; which of several rows with that doc_id and a text of the component is not defined.  Rows
    are told apart by a staged number, not by doc_id, so rows that repeat a doc_id with another
    text are judged by their own text.  Decisions are narrow rows; the texts are joined once."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    fps = fingerprints(rows, number)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(number).alias("n")))
    least = staged(fps.groupBy("fp").agg(first.alias("first")), "first_rows")
    comps = connected_components(fingerprint_links(least.select("fp")))
    roots = least.join(comps, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = staged(roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias(number)), "kept_rows")
    # the kept numbers grow with the table, so they are shuffled at every size, never broadcast
    return rows.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)
