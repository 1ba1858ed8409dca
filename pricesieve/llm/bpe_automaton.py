"""BPE encoding by a deterministic tokenization automaton, decoding by its arc labels.

The automaton reads tokens.  It starts as one state with an arc for every byte.  The merges are
applied in their order, each as a gadget: for the merge of u and v into w

* wherever u's arc leads to a state with an arc for v, a new arc for w is added that leads to
  where v led, and
* the state after u is replaced by a copy without the arc for v,

so that the texts' old spelling u v is no longer accepted.  What remains accepts exactly the
tokenizations that the merges produce, one for each text.  Which arcs leave a state depends only
on the token read last, so states are numbered by tokens.  Most arcs are shared: w's outgoing arcs
are v's at the time of the merge, its incoming arcs are u's.  The compiled table keeps, for
every token, where its two arc sets were copied from and when, and for every pair the time its
arc was cut.  An arc that is asked for is resolved through the copies once and then stands in the
transition table.

Encoding a pre-split word steps through its bytes: the arcs that spell a prefix lead to exactly
one state for each prefix, so one state per byte position is kept, and the path is read back.

Defined results: a null text counts as ''; repeated rows are encoded one by one.
"""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import ChunkEncoder, byte_letters

START = -1
#: Distinct chunks that a worker remembers; a full memory is emptied.
CHUNK_LIMIT = 700_000
#: Pre-split of the byte-level tokenizers.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Automaton:
    """``labels``: bytes of each token id; ``merges``: (u, v, w) ids in their order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.labels, self.special = labels, special or {}
        self.cut: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.copied: dict[int, tuple[int, int]] = {}
        for time, (u, v, w) in enumerate(merges, 1):
            self._gadget(time, u, v, w)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.spelled: dict[bytes, int] = {}
        named = set(self.special.values())
        for token, label in labels.items():
            if token not in named:
                for k in range(1, len(label)):
                    self.spelled.setdefault(label[:k], START)
                self.spelled[label] = token

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """From a tokenizer file with a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        merges = []
        for pair in spec["model"]["merges"]:
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels |= {i: text.encode() for text, i in special.items()}
        return cls(labels, merges, special)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault((u, v), time)
        if w not in self.born:
            self.born[w], self.copied[w] = time, (u, v)

    def _open(self, left: int, right: int, time: int) -> bool:
        """Has the state after ``left`` an arc for ``right`` once the merges up to ``time``
        were applied?"""
        while True:
            if self.cut.get((left, right), time + 1) <= time:
                return False
            a, b = self.born.get(left, 0), self.born.get(right, 0)
            if b >= a and b:  # right's incoming arcs were copied from its first half, after the cut
                right, time = self.copied[right][0], min(time, b)
            elif a:  # left's outgoing arcs were copied from its second half, before the cut
                left, time = self.copied[left][1], min(time, a - 1)
            else:
                return True

    def arc(self, state: int, token: int) -> bool:
        """Table-driven transition: may ``token`` be read in ``state``?  The arc leads to the
        state of ``token``."""
        if state == START:
            return True
        known = self.arcs.get((state, token))
        if known is None:
            known = self.arcs[state, token] = self._open(state, token, len(self.cut) + 1)
        return known

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n, spelled, arcs = len(word), self.spelled, self.arcs
        whole = spelled.get(word, START)
        if n == 1:
            return [whole]
        state = [START] * (n + 1)
        for i in range(n):
            here = state[i]
            if i and here == START:
                continue
            for j in range(i + 1, n + 1):
                token = spelled.get(word[i:j])
                if token is None:
                    break
                if token != START:
                    known = arcs.get((here, token))
                    if self.arc(here, token) if known is None else known:
                        state[j] = token
        path = []
        while n:
            path.append(state[n])
            n -= len(self.labels[state[n]])
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of the arc labels along a path; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


class Encoder:
    """Whole texts through the automaton; chunks that no token crosses are encoded once."""

    def __init__(self, path: str):
        import regex

        self.automaton = Automaton.from_file(path)
        self.split = regex.compile(PRE_SPLIT)
        self.special = list(self.automaton.special)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks: dict[str, list[int]] = {}

    def _words(self, text: str) -> list[int]:
        word, out = self.automaton.word, []
        for w in self.split.findall(text):
            out += word(w.encode("utf-8"))
        return out

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if ChunkEncoder.ODD_SPACE.search(text):
            return self._words(text)
        chunks, out = self.chunks, []
        for c in ChunkEncoder.BYTE_CHUNKS.findall(text):
            ids = chunks.get(c)
            if ids is None:
                if len(chunks) > CHUNK_LIMIT:
                    chunks.clear()
                    self.automaton.arcs.clear()
                ids = chunks[c] = self._words(c)
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        text, out, at = text or "", [], 0
        if self.at_special:
            for m in self.at_special.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(self.automaton.special[m.group()])
                at = m.end()
        return out + self._plain(text[at:]) if at or out else self._plain(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One compiled automaton per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    def run(batches):
        import pyarrow as pa

        coder = encoder(tokenizer)
        decimal = {i: str(i) for i in coder.automaton.labels}
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column("text").to_pylist():
                ids = coder.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.automaton.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
