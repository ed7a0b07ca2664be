"""Byte-pair encoding and decoding as bounded-lookahead streaming transducers.

A merge list decides each token boundary from a bounded number of bytes to its right. That bound is computed once
from the list (:func:`sufficient_lookahead`); :class:`Transducer` then holds a window, emits every token that ends at
least that far before the window's end, and goes on from there, so memory stays constant for any input. Decoding
is the reverse machine: token bytes in, text out as soon as a UTF-8 sequence is complete.

Defined results: null and empty texts have no tokens, the id list of no tokens is the empty string and decodes to the
empty string; repeated rows give repeated rows; very long texts, and words in them, are encoded piece by piece; an empty table
gives an empty result; columns of the input besides the named ones are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import table, text_array

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Name of the vocabulary file; names without a folder are looked up where they are read (driver or executor).
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pre-tokens whose result a task remembers; forgotten all at once when full.
MEMO = 1 << 19
MEMO_BYTES = 64
#: Ids handed on at once, characters of a text and of a pre-token above which they are encoded in pieces.
BLOCK, LONG, WINDOW = 1 << 14, 1 << 16, 1 << 12


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name in the folder QUIRE_TOKENIZERS, or where the installed package has it."""
    if "/" in name:
        return name
    if folder := os.environ.get("QUIRE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in shown}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(shown)))
    return out


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {}
        for rank, (a, b) in enumerate(self.merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(PATTERN)


@functools.lru_cache(4)
def vocabulary(path: str = TOKENIZER) -> Vocabulary:
    return Vocabulary(tokenizer_path(path))


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes right of a token boundary that can decide it, for this merge list.

    A merge (x, y) across a boundary needs y built just right of it, and y can be spoilt only by an earlier merge whose
    left part ends y. Following such chains through strictly earlier merges gives the longest reach; merges are taken in
    order, so one pass over the list suffices. Every token's right spine holds the tokens that can end it.
    """
    spine: dict[bytes, tuple[bytes, ...]] = {}
    reach_from: dict[bytes, int] = {}
    most = 0

    def spine_of(t: bytes) -> tuple[bytes, ...]:
        return spine.get(t) or (t,)

    for x, y in merges:
        reach = len(y) + max((reach_from.get(s, 0) for s in spine_of(y)), default=0)
        reach_from[x] = max(reach_from.get(x, 0), reach)
        most = max(most, reach)
        spine.setdefault(x + y, (x + y, *spine_of(y)))
    return most


def merge_all(data: bytes, vocab: Vocabulary) -> list[int]:
    """All merges of one byte string, lowest rank first and leftmost among equals."""
    parts = [vocab.byte_ids[b] for b in data]
    ranks = vocab.ranks
    if len(parts) <= 48:
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = ranks.get((parts[i], parts[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best = (found[0], i, found[1])
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts
    return _merge_heap(parts, ranks)


def _merge_heap(parts: list[int], ranks: dict) -> list[int]:
    import heapq

    n = len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(f[0], i, parts[i], parts[i + 1], f[1]) for i in range(n - 1) if (f := ranks.get((parts[i], parts[i + 1])))]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = new, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if prv[i] >= 0 and (f := ranks.get((parts[prv[i]], new))):
            heapq.heappush(heap, (f[0], prv[i], parts[prv[i]], new, f[1]))
        if nxt[i] < n and (f := ranks.get((new, parts[nxt[i]]))):
            heapq.heappush(heap, (f[0], i, new, parts[nxt[i]], f[1]))
    return [p for p, ok in zip(parts, alive) if ok]


class Transducer:
    """Encodes one pre-token fed in pieces; tokens leave once no later byte can change them."""

    def __init__(self, vocab: Vocabulary, window: int = 4096):
        self.vocab, self.held, self.window = vocab, b"", max(window, 2 * vocab.lookahead)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) > self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        safe = len(self.held) - self.vocab.lookahead
        done = 0
        for token in merge_all(self.held, self.vocab):
            end = done + len(self.vocab.bytes_of[token])
            if end > safe:
                break
            yield token
            done = end
        self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        yield from merge_all(self.held, self.vocab)
        self.held = b""


class Encoder:
    """Text to ids: special tokens cut first, then the pattern, then merges (remembered for short pre-tokens)."""

    def __init__(self, vocab: Vocabulary, special: bool = True):
        self.vocab, self.memo = vocab, {}
        self.cut = vocab.cut if special else None

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        if len(data) > MEMO_BYTES:
            run = Transducer(self.vocab)
            return (*run.feed(data), *run.finish())
        out = tuple(merge_all(data, self.vocab))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[piece] = out
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        get, make = self.memo.get, self._piece
        for piece in self.vocab.split.findall(text):
            out += get(piece) or make(piece)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._plain(text[at : m.start()], out)
            out.append(self.vocab.special[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out


    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of :meth:`encode` in blocks; for a long text no more than a block and a window are held at a time."""
        if len(text) <= LONG:
            ids = self.encode(text)
            if ids:
                yield ids
            return
        out: list[int] = []
        at = 0
        marks = [(m.start(), m.end(), self.vocab.special[m[0]]) for m in self.cut.finditer(text)] if self.cut else []
        for start, end, special in [*marks, (len(text), len(text), None)]:
            for m in self.vocab.split.finditer(text if not marks else text[at:start]):
                piece = m[0]
                if len(piece) > WINDOW:
                    run = Transducer(self.vocab)
                    for i in range(0, len(piece), WINDOW):
                        out += run.feed(piece[i : i + WINDOW].encode("utf-8"))
                        if len(out) >= BLOCK:
                            yield out
                            out = []
                    out += run.finish()
                else:
                    out += self.memo.get(piece) or self._piece(piece)
                if len(out) >= BLOCK:
                    yield out
                    out = []
            if special is not None:
                out.append(special)
            at = end
        if out:
            yield out


class Decoder:
    """Ids to text, incrementally: a byte-to-text state machine holds at most one unfinished character."""

    def __init__(self, vocab: Vocabulary):
        self.bytes_of = vocab.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def encode_text(text: str, encoder: Encoder, decoder_vocab: Vocabulary) -> tuple[int, str, str]:
    """Number of tokens, digest of the comma-joined ids, digest of the text decoded from those ids."""
    back, named, out, n = Decoder(decoder_vocab), hashlib.sha256(), hashlib.sha256(), 0
    for ids in encoder.blocks(text):
        named.update((("," if n else "") + ",".join(map(decoder_vocab.text_of.__getitem__, ids))).encode())
        out.update(back.feed(ids).encode("utf-8"))
        n += len(ids)
    out.update(back.finish().encode("utf-8"))
    return n, named.hexdigest(), out.hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Tokens of every text: ``key``, n_tokens, ids_sha256, decoded_sha256, and the ids themselves (array) if asked.

    One narrow stage; the vocabulary file is read once by each Python worker.
    """
    path = path or TOKENIZER
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            column = text_array(batch.column(1))
            for at in range(0, len(column), 512):
                part = column.slice(at, 512).to_pylist()
                rows = [encode_text(t, encoder, vocab) for t in part]
                cols = [batch.column(0).slice(at, 512), *(pa.array(c) for c in zip(*rows))]
                if ids:
                    cols.append(pa.array([encoder.encode(t) for t in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["k", "n", "i", "d", *["ids"] * ids])

    out = f"k {kind}, n bigint, i string, d string" + ", ids array<int>" * ids
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, out)
    return named.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"), F.col("d").alias("decoded_sha256"), *["ids"] * ids)


def decode_ids(encoded: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Text of every id list (null or empty: the empty text)."""
    path = path or TOKENIZER
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                back = Decoder(vocab)
                texts.append("".join(back.feed((own or [])[at : at + BLOCK]) for at in range(0, len(own or []), BLOCK)) + back.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    named = encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string")
    return named.select(F.col("k").alias(key), F.col("t").alias("text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


__all__ = ["Decoder", "Encoder", "Transducer", "Vocabulary", "decode_ids", "encode_documents", "encode_text", "merge_all", "op10_bpe", "sufficient_lookahead", "vocabulary"]
