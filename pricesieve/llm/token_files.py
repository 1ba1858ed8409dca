"""Token-id files: per-document zstandard frames under one shared dictionary.

A file set is a folder on any file system Spark writes to:

* ``dictionary``  one row: the zstandard dictionary, its SHA-256, the width of a stored id;
* ``tokens``      one row per block, blocks in ascending doc_id order.  A block holds the frames
  of its documents end to end, the index (doc_id, offset and length of the frame, number of
  ids), the SHA-256 of the dictionary it needs, its shard, and the ids that precede it in the
  shard.

Every document is a frame of its own, so a short document is read by one block row (Parquet
statistics on first_doc and last_doc prune the others), one index entry and one small frame.
Blocks are written by Spark's committer: lost executors leave no half-written file.

Defined results: a null text counts as ''; documents with a null doc_id come first; repeated
rows are stored one by one; an empty table gives an empty file set.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricesieve.llm.common import chunk_encoder, shared_folder, staged

END_ID = 1
#: Bytes of frames that one block holds, about.
BLOCK_BYTES = 1 << 20
#: The dictionary is trained on this many documents (those of least hash), on this many
#: characters of each, from a place by hash, and has this many bytes at most.
DICTIONARY_DOCS = 1000
DICTIONARY_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

ENTRY = "array<struct<doc_id:bigint,offset:bigint,length:bigint,n_tokens:bigint>>"
BLOCK = (f"shard int, block int, first_doc long, last_doc long, n_docs long, n_tokens long, "
         f"tokens_before long, dictionary_sha256 string, `index` {ENTRY}, frames binary")


def _width(ids_below: int) -> int:
    return 2 if ids_below <= 1 << 16 else 4


def stored(ids: bytes, end_id: int, width: int) -> bytes:
    """Little-endian 32-bit ids and the end id as stored integers of ``width`` bytes."""
    import numpy as np

    return np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Train on the serialized ids of a bounded sample, in one task.  Too little data to
    train on gives a raw dictionary of the samples' last bytes."""
    over = F.greatest(F.length("text") - DICTIONARY_CHARS, F.lit(0))
    start = (F.pmod(F.xxhash64("doc_id"), over + 1) + 1).cast("int")
    sample = (docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.substring("text", start, F.lit(DICTIONARY_CHARS)).alias("text"))
              .orderBy("h", "doc_id").limit(DICTIONARY_DOCS).coalesce(1))

    def run(batches):
        import pyarrow as pa
        import zstandard as zstd

        encoder = chunk_encoder(tokenizer, "word")
        samples = [stored(encoder.encode(t), end_id, width) for b in batches for t in b.column("text").to_pylist()]
        try:
            data = zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstd.ZstdError:
            data = b"".join(samples)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

    rows = sample.select("text").mapInArrow(run, "data binary").collect()
    return bytes(rows[0][0]) if rows else b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, ids_below: int = 1 << 16) -> None:
    """Encode every whole text of (doc_id, text) and write the file set to ``path``."""
    spark, width = docs.sparkSession, _width(ids_below)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    data = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(bytearray(data), digest, width)], T.StructType([
        T.StructField("data", T.BinaryType()), T.StructField("sha256", T.StringType()),
        T.StructField("width", T.IntegerType())])).coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    def encode(batches):
        import pyarrow as pa

        encoder, press = chunk_encoder(tokenizer, "word"), _compressor(shared.value)
        for b in batches:
            ids = [stored(encoder.encode(t), end_id, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()),
                 pa.array([press(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, before, block, size, held = TaskContext.get().partitionId(), 0, 0, 0, []

        def closed():
            index, at = [], 0
            for doc, n, frame in held:
                index.append({"doc_id": doc, "offset": at, "length": len(frame), "n_tokens": n})
                at += len(frame)
            docs_here = [d for d, _, _ in held if d is not None]
            row = {"shard": shard, "block": block, "first_doc": min(docs_here, default=None),
                   "last_doc": max(docs_here, default=None), "n_docs": len(held), "n_tokens": sum(n for _, n, _ in held),
                   "tokens_before": before, "dictionary_sha256": digest, "index": index,
                   "frames": b"".join(f for _, _, f in held)}
            return pa.RecordBatch.from_pylist([row], schema=_block_schema())

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield closed()
                    before, block, size, held = before + sum(n for _, n, _ in held), block + 1, 0, []
        if held:
            yield closed()

    frames = staged(docs.mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "frames")
    ordered = frames.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "frame")
    ordered.mapInArrow(blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/tokens")


def _block_schema():
    import pyarrow as pa

    entry = pa.struct([(n, pa.int64()) for n in ("doc_id", "offset", "length", "n_tokens")])
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                      ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("tokens_before", pa.int64()),
                      ("dictionary_sha256", pa.string()), ("index", pa.list_(entry)), ("frames", pa.binary())])


def _dictionary(data: bytes):
    import zstandard as zstd

    return zstd.ZstdCompressionDict(data) if data else None


def _compressor(data: bytes):
    import zstandard as zstd

    held = _dictionary(data)
    if held:
        held.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(dict_data=held).compress
    return zstd.ZstdCompressor(level=LEVEL).compress


def _decompressor(data: bytes):
    import zstandard as zstd

    return zstd.ZstdDecompressor(dict_data=_dictionary(data)).decompress


def dictionary_of(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    """(dictionary, SHA-256, id width); raises if the dictionary isn't the one it was."""
    data, digest, width = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(data)
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"dictionary of {path} is damaged")
    return data, digest, width


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): ids as little-endian unsigned 32-bit integers,
    start counts the ids of all documents before it.  ``doc_ids`` reads those documents only,
    from the blocks that may hold them."""
    data, digest, width = dictionary_of(spark, path)
    tokens = spark.read.schema(BLOCK).parquet(f"{path}/tokens")
    # one row per shard: the ids of the shards before it
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, at = {}, 0
    for shard, n in shards:
        before[shard], at = at, at + n
    if doc_ids is not None:
        tokens = tokens.where(" OR ".join(f"(first_doc <= {d} AND last_doc >= {d})" for d in doc_ids) or "false")
    shared, wanted = spark.sparkContext.broadcast((data, before)), None if doc_ids is None else set(doc_ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        data, before = shared.value
        expand = _decompressor(data)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["dictionary_sha256"] != digest:
                    raise ValueError("block needs another dictionary")
                start, frames, out = before[row["shard"]] + row["tokens_before"], row["frames"], []
                for e in row["index"]:
                    if wanted is None or e["doc_id"] in wanted:
                        raw = expand(frames[e["offset"]:e["offset"] + e["length"]])
                        ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        out.append((e["doc_id"], start, len(ids) // 4, ids))
                    start += e["n_tokens"]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                         pa.array(cols[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return (tokens.select("shard", "tokens_before", "dictionary_sha256", "index", "frames")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/token_files"
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
