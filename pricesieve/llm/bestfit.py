"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Documents become pieces of at most SEQUENCE_TOKENS ids.  Pieces over half a sequence open
one each.  The others are placed in rounds, from large to small.  A round range-sorts its
pieces together with the gaps left in open sequences and deals the sorted rows out by rank,
so that each lane gets an even share of every size and no gap stands in two lanes.  In its lane
a piece takes its successor, the smallest gap that holds it; pieces that want the same gap are
served in rank order, and a filled gap goes back as what is left of it.  A piece without
successor opens a sequence.  The gaps left over enter the next round, dealt anew.

A lane holds about LANE_ROWS rows whatever the input, so lanes grow in number, not in size.

Defined results: a null text counts as '' (its one id is the end id); repeated rows are packed
one by one; null ids stay null; an empty table gives an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import chunk_encoder, staged

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Rows that one lane of a round gets, about.
LANE_ROWS = 100_000
#: Rounds: lower ends of the piece lengths, as shares of a sequence.
ROUNDS = (1 / 4, 1 / 16, 0)

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, room: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text, append the end id and cut: a document over ``room`` ids is
    cut into pieces of ``room``, the first of which may be shorter."""
    def run(batches):
        import struct
        import zlib

        import pyarrow as pa

        encoder, end = chunk_encoder(tokenizer, "byte"), struct.pack("<I", end_id)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                at, to, k = 0, n % room or room, 0
                while at < n:
                    part = (doc, k, at, to - at, zlib.crc32(ids[4 * at:4 * to]))
                    for c, v in zip(cols, part):
                        c.append(v)
                    at, to, k = to, to + room, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def successor_sweep(sizes, lengths, room: int):
    """Best fit of ``lengths`` (descending) into gaps of ``sizes``.  Returns (bin, offset) of
    every length, the gap left in every bin, and the index of each new bin's first length;
    bins are the gaps given, then new ones of ``room``."""
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    left, taken = list(sizes), 0
    for i, size in enumerate(left):
        stacks[size].append(i)
        taken |= 1 << size
    bins, offsets, opened = [], [], []
    for k, length in enumerate(lengths):
        fit = taken >> length
        if fit:
            size = length + (fit & -fit).bit_length() - 1
            stack = stacks[size]
            i = stack.pop()
            if not stack:
                taken ^= 1 << size
        else:
            size, i = room, len(left)
            left.append(room)
            opened.append(k)
        bins.append(i)
        offsets.append(room - size)
        rest = left[i] = size - length
        if rest:
            stacks[rest].append(i)
            taken |= 1 << rest
    return bins, offsets, left, opened


def _lanes(rows: DataFrame, lanes: int) -> DataFrame:
    """Range-sort by size and deal by rank: row r of a sorted partition goes to lane r mod
    ``lanes``."""
    if lanes == 1:
        return rows.withColumn("lane", F.lit(0))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for b in batches:
            lane = (np.arange(at, at + b.num_rows) % lanes).astype(np.int32)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lane)], names=[*b.schema.names, "lane"])

    ordered = rows.repartitionByRange(F.col("size"), F.col("uid")).sortWithinPartitions("size", "uid")
    return ordered.mapInArrow(run, f"{_schema(rows)}, lane int")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _round(todo: DataFrame, gaps: DataFrame, rows: int, room: int) -> DataFrame:
    """One round: rows of ``todo`` with sequence_id and offset, and rows of gaps left, in one
    staged table (kind 1 and 0)."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    none = [F.lit(None).cast(t).alias(n) for n, t in todo.select(*fields).dtypes]
    both = (todo.select(F.lit(1).alias("kind"), F.col("length").alias("size"), "uid", *fields)
            .unionAll(gaps.select(F.lit(0).alias("kind"), F.col("room").alias("size"), F.col("sequence_id").alias("uid"), *none)))
    out = f"{_schema(todo.select(*fields))}, kind int, sequence_id long, offset long, room long"

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by([("kind", "ascending"), ("size", "descending"), ("uid", "ascending")])
        given = table.filter(pc.equal(table["kind"], 0))
        items = table.filter(pc.equal(table["kind"], 1))
        bins, offsets, left, opened = successor_sweep(
            given["size"].to_pylist(), items["size"].to_pylist(), room)
        uid = items["uid"].to_numpy()
        ids = np.concatenate([given["uid"].to_numpy(), uid[np.array(opened, dtype=np.int64)]]).astype(np.int64)
        n, m = items.num_rows, len(left)
        cols = {f: pa.chunked_array([*items[f].chunks, pa.nulls(m, items[f].type)], items[f].type) for f in fields}
        cols["kind"] = pa.array(np.repeat([1, 0], [n, m]).astype(np.int32))
        cols["sequence_id"] = pa.array(np.concatenate([ids[np.array(bins, dtype=np.int64)], ids]))
        cols["offset"] = pa.array([*offsets, *[None] * m], pa.int64())
        cols["room"] = pa.array([*[None] * n, *left], pa.int64())
        return pa.table(cols)

    dealt = _lanes(both, max(1, math.ceil(rows / LANE_ROWS)))
    return staged(dealt.groupBy("lane").applyInArrow(run, out), "round")


def pack(parts: DataFrame, room: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pack rows (doc_id, piece, start, length, ids_crc32); adds sequence_id and offset."""
    parts = staged(parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    large = parts.where(F.col("length") > room // 2)
    placed = large.select(*fields, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps = large.where(F.col("length") < room).select(
        F.col("uid").alias("sequence_id"), (F.lit(room) - F.col("length")).cast("long").alias("room"))
    edges = [room // 2, *(int(room * share) for share in ROUNDS)]
    counts = parts.agg(F.count(F.when((F.col("length") > room // 2) & (F.col("length") < room), 1)), *(
        F.count(F.when((F.col("length") > lo) & (F.col("length") <= hi), 1)) for hi, lo in zip(edges, edges[1:]))).first()
    n_gaps = counts[0]
    for (hi, lo), n in zip(zip(edges, edges[1:]), counts[1:]):
        if not n:
            continue
        done = _round(parts.where((F.col("length") > lo) & (F.col("length") <= hi)), gaps, n + n_gaps, room)
        placed = placed.unionAll(done.where("kind = 1").select(*fields, "sequence_id", "offset"))
        gaps = done.where("kind = 0 AND room > 0").select("sequence_id", "room")
        n_gaps = gaps.count()
    return placed


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents and their places."""
    return pack(pieces(docs, tokenizer))
