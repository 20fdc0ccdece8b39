"""Byte-level BPE encoding and decoding.

Texts are split at special tokens and into pre-tokens; short pre-tokens are encoded once and
remembered.  Long unsplit pre-tokens are encoded as a tree: their leaves, cut between characters, in threads
(the encoder gives up the interpreter's lock while it works), then pairs of neighbours, level by level.  Each
join is mended by re-encoding a window around it that
grows, on the side that does not agree yet, until its first and last token are what both sides had.  Runs
that repeat themselves are cut where their tokens begin anew, or else a window would often have to grow
over the whole run; the result is the same wherever the cut is.  Any two neighbours in an encoding are the encoding of their own bytes, and a
sequence all of whose neighbours are is the encoding of the whole, so the joined result is exact.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import appended

#: The vocabulary file: a tokenizers JSON with a byte-level BPE model.
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens of more bytes than this are encoded as a tree whose leaves have about as many.
LONG = 4096
#: Threads of a worker that encode leaves (only pre-tokens of ``THREADS`` leaves or more start them).
THREADS = 4
#: Bytes before a cut that are looked at for a repeating run, its longest period, and how many periods leaves are made of.
RUN, PERIOD, PERIODS = 256, 32, 128
#: Tokens on either side of a join in its first window.
FIRST_WINDOW = 4
#: Pre-tokens remembered by a worker before it starts afresh.
REMEMBERED = 100_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes one text at a time with the vocabulary in ``path``."""

    def __init__(self, path: str, long: int = LONG, threads: int = THREADS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.rank = {as_bytes(t): i for t, i in ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (n, ids[a + b])
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.table = {i: t for t, i in self.rank.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=self.rank, special_tokens={})
        self.long, self.threads, self.pool = long, threads, None
        self.known = _Known(self)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.split and any(s in text for s in self.special):
            return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, np.uint32).tolist()))

    def merge(self, piece: bytes) -> list[int]:
        """BPE of one unsplit piece: the merge of lowest rank first, of equals the leftmost."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], self.merges
        todo = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(todo)
        while todo:
            _, i, new, a, b = heapq.heappop(todo)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(todo, (m[0], i, m[1], new, ids[k]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], new))):
                heapq.heappush(todo, (m[0], p, m[1], ids[p], new))
        return [i for i in ids if i >= 0]

    def piece(self, raw: bytes) -> np.ndarray:
        """The encoding of one unsplit piece; what begins or ends inside a character is merged in Python."""
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return np.array(self.merge(raw), np.uint32)
        return np.array(self.whole.encode_ordinary(text), np.uint32)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encoded neighbours' bytes."""
        before = after = FIRST_WINDOW
        while True:
            a, b = left[-before:], right[:after]
            got = self.piece(b"".join(map(self.table.__getitem__, [*a.tolist(), *b.tolist()])))
            agrees_left = before >= len(left) or got[0] == a[0]
            agrees_right = after >= len(right) or got[-1] == b[-1]
            if agrees_left and agrees_right:
                return np.concatenate([left[:-before], got, right[after:]])
            before, after = before * (1 if agrees_left else 2), after * (1 if agrees_right else 2)

    def cuts(self, piece: bytes) -> list[int]:
        """Where the leaves of a long piece begin and the last ends, always between characters."""
        x, out = np.frombuffer(piece, np.uint8), [0]
        while len(x) - out[-1] > self.long:
            begin = out[-1]
            at = begin + self.long
            near = x[max(begin, at - RUN) : at]
            for p in range(1, min(PERIOD, len(near) // 4) + 1):
                if (near[p:] == near[:-p]).all():
                    breaks = np.flatnonzero(x[begin + p : at] != x[begin : at - p])
                    run = begin + int(breaks[-1]) + 1 if len(breaks) else begin
                    at = max(run + (at - run) // (p * PERIODS) * (p * PERIODS), run) if run > begin or at - run >= p * PERIODS else at
                    break
            between = at
            while between > begin and x[between] & 0xC0 == 0x80:
                between -= 1
            if between == begin:  # a leaf of less than a character
                between = at
                while between < len(x) and x[between] & 0xC0 == 0x80:
                    between += 1
            out.append(between)
        return [*out, len(x)] if out[-1] < len(x) or not len(x) else out

    def tree(self, piece: str) -> np.ndarray:
        """The encoding of a long unsplit piece."""
        raw = piece.encode()
        cuts = self.cuts(raw)
        leaves = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        each = map
        if self.threads > 1 and len(leaves) >= self.threads:
            if self.pool is None:
                self.pool = ThreadPoolExecutor(self.threads)
            each = self.pool.map
        parts = list(each(self.piece, leaves))
        while len(parts) > 1:
            joined = list(map(self.join, parts[::2], parts[1::2]))
            parts = [*joined, *parts[len(joined) * 2 :]]
        return parts[0]


class _Known(dict):
    """Pre-token -> its ids as bytes; long ones are not kept."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > self.encoder.long or 4 * len(piece) > self.encoder.long and len(piece.encode()) > self.encoder.long:
            return self.encoder.tree(piece).tobytes()
        self[piece] = out = np.array(self.encoder.whole.encode_ordinary(piece), np.uint32).tobytes()
        return out


@lru_cache(maxsize=4)
def encoder(path: str | None, long: int = LONG) -> Encoder:
    """This process's encoder for a file; None is the public vocabulary wherever this machine has it."""
    return Encoder(path or public_tokenizers.path(VOCABULARY), long)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, long: int = LONG) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), and the names these got.

    Null and empty text has no tokens; all rows and columns stay, repeated rows too, and an empty table gives none.
    A new name that ``docs`` has already gets an underscore.  Very long texts are encoded whole, in one row's memory.
    """

    def each(column: pa.Array) -> list[pa.Array]:
        e = encoder(path, long)
        ids = [e.encode(t or "") for t in column.to_pylist()]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    return appended(docs, text, StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())]), each)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``decoded``, the text of the ids (bytes that are no UTF-8 become U+FFFD); null ids give empty text."""

    def each(column: pa.Array) -> list[pa.Array]:
        e = encoder(path)
        return [pa.array([e.decode(i or b"").decode(errors="replace") for i in column.to_pylist()], pa.string())]

    return appended(docs, ids, StructType([StructField("decoded", StringType())]), each)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, keep_ids: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``): encoded and decoded in one pass.

    Odd rows and tables are treated as by ``encode``: null and empty text has no tokens and the digests of nothing.
    """

    def each(column: pa.Array) -> list[pa.Array]:
        e, sha = encoder(path), hashlib.sha256
        ids = [e.encode(t or "") for t in column.to_pylist()]
        out = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i).hexdigest() for i in ids])]
        out.append(pa.array([sha(e.decode(i).decode(errors="replace").encode()).hexdigest() for i in ids]))
        return [*out, pa.array(ids, pa.binary())] if keep_ids else out

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return appended(docs, text, StructType(fields + [StructField("ids", BinaryType())] * keep_ids), each)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count, and digests of its ids and of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, names = round_trip(docs)
    return out.select("doc_id", *[F.col(c) for c in names])
