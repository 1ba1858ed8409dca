"""Helpers shared by the operators: staged tables and the cached chunk tokenizer."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator of the contracts: space and \t..\r.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it gets a scratch folder once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pricesieve-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """Folder of this application's staged tables."""
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: work is done once, the
    lineage is cut, a lost executor loses nothing, and the planner knows the size."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete one staged table that nothing reads any more, such as the state before the last one."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application.  Call it when no result that reads
    them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    """The text, '' where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def spread(n: int, most: int) -> list[int]:
    """At most ``most`` of the places 0 to n - 1, evenly over all of them: a bounded sample of the
    lines or blocks of a training text that is no prefix of it."""
    return list(range(n)) if n <= most else [i * n // most for i in range(most)]


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 letters stand for themselves,
    the other bytes for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, once per distinct chunk.

    A text is cut at white space where no token can cross, each distinct chunk is encoded by
    the library, and a text's ids are the chunks' ids in order.  The result equals encoding
    the whole text.  ``kind`` names the pre-tokenizer:

    * ``word``: white space is dropped, so texts are cut at every space and newline.
    * ``byte``: a space sticks to the word after it and runs of white space follow the
      pre-tokenizer's look-ahead; texts with other white space than space and newline, or
      with a special token's string, are given to the library whole.

    ``limit`` bounds the cache; a full cache is emptied, results don't depend on it.
    """

    #: A run of Latin letters ends a chunk before ASCII marks, digits and white space (not before
    #: an apostrophe): both pre-tokenizers split there too.
    RUN = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?=[!-&(-@\[-`{-~ \n]|\Z)"
    WORD_CHUNKS = re.compile(rf"{RUN}|[^ \n]+")
    BYTE_CHUNKS = re.compile(rf" ?{RUN}| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
    ONE_RUN = re.compile(rf" ?{RUN}")
    ODD_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, kind: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind, self.limit, self.model = kind, limit, self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.cache: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        # a single run of Latin letters is one pre-split word: the library's model alone does
        out = []
        for t in texts:
            if self.ONE_RUN.fullmatch(t):
                low = t.lower() if self.kind == "word" else t
                tokens = self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))
                out.append(np.array([x.id for x in tokens], dtype="<u4").tobytes())
            else:
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
        return out

    def chunks(self, text: str) -> list[str]:
        if self.kind == "word":
            return self.WORD_CHUNKS.findall(text)
        if self.ODD_SPACE.search(text) or any(s in text for s in self.special):
            return [text]
        return self.BYTE_CHUNKS.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        parts, cache = self.chunks(text or ""), self.cache
        try:
            return b"".join([cache[p] for p in parts])
        except KeyError:
            pass
        if len(parts) == 1 and len(parts[0]) > 1000:
            return self._ids(parts)[0]
        if len(cache) > self.limit:
            cache.clear()
        new = list({p for p in parts if p not in cache})
        cache.update(zip(new, self._ids(new)))
        return b"".join([cache[p] for p in parts])


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def chunk_encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder per Python worker."""
    if (path, kind) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]
