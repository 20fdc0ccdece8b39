"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch of texts go into a trie.  The best score of a prefix depends on the
prefix alone, so each trie node is scored once, however many pre-tokens share it: over the vocabulary's
pieces that end there, the best of the node before the piece plus the piece's score.  The node at which
a pre-token ends holds its token count.

Scores come from a unigram model's file of pieces and scores (``load_model``), whose counts are those of its
tokenizer, or by the rule "ranks" from a public vocabulary, by Zipf's law (nothing is trained): a piece of rank r
has ``-log2((r + 1) * H)`` bits, in millionths, H being the harmonic number of the vocabulary's size.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from .common import appended

#: The vocabulary: one base64 piece and its rank a line; every single byte is a piece.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Trie nodes and pre-tokens that a worker holds before it starts afresh.
MOST_NODES, MOST_KNOWN = 1_500_000, 400_000
#: Pre-tokens of more bytes are scored along a path of their own, of which only the last nodes are held.
LONG = 256


def load_scores(path: str) -> dict[bytes, int]:
    """Score of each piece, an integer: higher is better, all are negative."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    harmonic = sum(1 / (r + 1) for r in range(len(ranks)))
    return {p: -round(1e6 * math.log2((r + 1) * harmonic)) for p, r in ranks.items()}


#: Space as unigram models write it, and the pre-tokens of such text: a space sign begins one.
SPACE, SPACED = "\u2581", r"\u2581[^\u2581]*|[^\u2581]+"
#: How much worse than the worst piece an unknown character is scored, as unigram tokenizers do.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    """Pieces with scores (higher is better) and how texts become the pre-tokens that they are looked for in.

    ``unknown`` is the score of a character that no piece covers, None where every byte is a piece.  Such a character
    counts as its bytes with ``bytes_instead``, else unknown characters that follow each other count as one token.
    With ``spaced`` blanks are written as ``SPACE``, and one is put before a text that does not begin with one if ``lead``.
    """

    scores: dict[bytes, float]
    unknown: float | None = None
    bytes_instead: bool = False
    spaced: bool = False
    lead: bool = False


def load_model(path: str) -> Model:
    """A model from a file: ``.tiktoken`` ranks by the rule "ranks"; else a unigram model.

    Unigram models are a tokenizers JSON whose model is Unigram, with a Metaspace pre-tokenizer, or lines of piece, tab
    and score.  Control and byte pieces (``<unk>``, ``<s>``, ``</s>``, ``<pad>``, ``<0x41>``) are not looked for in
    texts.  No normalizer is applied: a JSON that has one, or another model or pre-tokenizer, is refused.
    """
    if path.endswith(".tiktoken"):
        return Model(load_scores(path))
    with open(path, encoding="utf-8", newline="\n") as f:
        whole = f.read()
    lead, control = True, {"<unk>", "<s>", "</s>", "<pad>"}
    if whole.lstrip().startswith("{"):
        spec = json.loads(whole)
        model, before = spec["model"], spec.get("pre_tokenizer")
        if model.get("type") != "Unigram" or spec.get("normalizer") or not before or before.get("type") != "Metaspace" or before.get("split") is False or before.get("replacement", SPACE) != SPACE:
            raise ValueError(f"{path} is no Unigram model with Metaspace pre-tokens and without a normalizer")
        if before.get("prepend_scheme", "always") == "first":
            raise ValueError(f"{path}: prepend_scheme first is not supported")
        lead = before.get("prepend_scheme", "always") == "always"
        pieces, as_bytes = model["vocab"], bool(model.get("byte_fallback"))
        if model.get("unk_id") is not None:
            control.add(pieces[model["unk_id"]][0])
        control |= {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
    else:
        pieces = [(p, float(x)) for p, x in (line.rstrip("\r").split("\t") for line in whole.split("\n") if line)]
        as_bytes = {"<0x00>", "<0xFF>"} <= {p for p, _ in pieces}
    byte = {f"<0x{b:02X}>" for b in range(256)}
    kept = {p.encode(): float(x) for p, x in pieces if p and p not in control and not (as_bytes and p in byte)}
    if not kept:
        raise ValueError(f"{path} has no pieces")
    worst = min(float(x) for _, x in pieces)
    return Model(kept, worst - UNKNOWN_PENALTY, as_bytes, True, lead)


#: The score of what cannot be; the part of a node's count that counts, and its mark that an unknown character is last.
_NEVER, _COUNT, _FUSED = -math.inf, (1 << 40) - 1, 1 << 40


class Trie:
    """Prefixes of pre-tokens with their best score and the tokens of the best segmentation.

    Ties go to fewer tokens.  Node 0 is the empty prefix.  A prefix that ends inside a character has no score unless
    pieces end there.
    """

    def __init__(self, model: dict[bytes, float] | Model):
        model = model if isinstance(model, Model) else Model(model)
        self.scores, self.unknown, self.bytes_instead = model.scores, model.unknown, model.bytes_instead
        scores = model.scores
        self.longest = max(4, *map(len, scores))
        self.single = [scores.get(bytes([b]), _NEVER) for b in range(256)]
        if self.unknown is None and _NEVER in self.single:
            raise ValueError("a model without an unknown score needs every byte as a piece")
        ends: dict[int, set[int]] = {}
        for p in scores:  # lengths of longer pieces by their last two bytes: what can end at a node
            if len(p) > 1:
                ends.setdefault(p[-2] << 8 | p[-1], set()).add(len(p))
        self.ends = {b: sorted(x) for b, x in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0], [0]

    def _best(self, token: bytes, at: int, score: list[int], count: list[int]) -> tuple[int, int]:
        """Best score and count of ``token[:at]``; ``score[i]`` and ``count[i]`` are those of its prefixes."""
        best, fewest = score[at - 1] + self.single[token[at - 1]], count[at - 1] & _COUNT
        if at > 1:
            known = self.scores.get
            for n in self.ends.get(token[at - 2] << 8 | token[at - 1], ()):
                if n > at:
                    break
                s = known(token[at - n : at])
                if s is not None:
                    s += score[at - n]
                    if s > best or s == best and count[at - n] & _COUNT < fewest:
                        best, fewest = s, count[at - n] & _COUNT
        fewest += 1
        if self.unknown is not None:
            n = 1
            while n < 4 and n < at and token[at - n] & 0xC0 == 0x80:
                n += 1
            lead = token[at - n]
            whole = n == (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if whole and self.scores.get(token[at - n : at]) is None:
                before = count[at - n]
                s, c = score[at - n] + self.unknown, (before & _COUNT) + (n if self.bytes_instead else 0 if before & _FUSED else 1)
                if s > best or s == best and c < fewest:
                    return s, c | (0 if self.bytes_instead else _FUSED)
        return best, fewest

    def tokens(self, token: bytes) -> int:
        """Tokens of a pre-token's best segmentation; its prefixes stay for the next."""
        if len(token) > LONG:
            return self._alone(token)
        child, score, count, node = self.child, self.score, self.count, 0
        path, size = [0], len(token)
        for byte in token:  # as far as the trie goes
            found = child.get(node << 8 | byte)
            if found is None:
                break
            path.append(found)
            node = found
        if len(path) <= size:
            scores, counts = [score[i] for i in path], [count[i] for i in path]
            for at in range(len(path), size + 1):
                s, c = self._best(token, at, scores, counts)
                scores.append(s)
                counts.append(c)
                child[node << 8 | token[at - 1]] = node = len(score)
                score.append(s)
                count.append(c)
        return count[node] & _COUNT

    def _alone(self, token: bytes) -> int:
        """The same without nodes: only as many prefixes are held as the longest piece has bytes."""
        scores, counts, base = [0], [0], 0
        for at in range(1, len(token) + 1):
            if len(scores) > 4 * self.longest:
                cut = len(scores) - self.longest
                scores, counts, base = scores[cut:], counts[cut:], base + cut
            s, c = self._best(token[base:at], at - base, scores, counts)
            scores.append(s)
            counts.append(c)
        return counts[-1] & _COUNT


class Counter(dict):
    """Pre-token -> tokens."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.trie = Trie(self.model)
        self.split = regex.compile(SPACED if self.model.spaced else public_tokenizers.PATTERN).findall

    def __missing__(self, token: str) -> int:
        n = self.trie.tokens(token.encode())
        if len(token) <= LONG:
            self[token] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        if len(self) > MOST_KNOWN:
            self.clear()
        if len(self.trie.score) > MOST_NODES:
            self.trie.clear()
        if self.model.spaced:
            text = text.replace(" ", SPACE)
            text = SPACE + text if self.model.lead and text and not text.startswith(SPACE) else text
        parts = self.split(text)
        return len(parts), sum(map(self.__getitem__, parts))


@lru_cache(maxsize=4)
def counter(path: str | None) -> Counter:
    """This process's counter for a file; None is the public vocabulary wherever this machine has it."""
    return Counter(path or public_tokenizers.path(VOCABULARY))


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``n_pretokens`` and ``n_tokens`` of each whole text, and the names these columns got.

    ``path`` is a file that ``load_model`` reads, on every machine; None is the public vocabulary by the rule "ranks".
    Null and empty texts have none; all rows and columns stay, repeated rows too, and an empty table gives none.  A new
    name that ``docs`` has already gets an underscore.  Very long texts are counted whole; of a long pre-token only the
    last prefixes are held.
    """

    def each(column: pa.Array) -> list[pa.Array]:
        c = counter(path)
        got = [c.text(t or "") for t in column.to_pylist()]
        return [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)]

    return appended(docs, text, StructType([StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())]), each)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pre-tokens and unigram tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, names = count_tokens(docs)
    return out.select("doc_id", *names)
