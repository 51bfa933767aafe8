"""Byte-level BPE in linear time: Aho-Corasick matches and backtracking over compatible neighbours.

A sequence of tokens is what the merges give if, and only if, every two neighbours are: re-encoding the bytes of the
pair gives the pair again. So a piece is walked from left to right, always with the longest vocabulary entry at the
position; if it does not go with the token before it, the next shorter one is tried, and if none is left the last
token is taken back. Positions that led nowhere are marked, so each is visited once for each token length at most.
Compatibility of a pair is found by undoing merges at the seam and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Entries that a worker remembers: pieces with their ids, and pairs with their verdict. The pieces in either of two generations.
MAX_PIECES, MAX_PAIRS = 150_000, 250_000


@dataclass
class Vocabulary:
    """Tokens by id with the two parts whose merge made them. Pickles small; the automaton is built where it is used."""

    tokens: list[bytes]
    pattern: str
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    digest: str = ""

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Read a rank file (lines of base64 and rank) on the driver."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls.from_ranks(ranks, pattern)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        out = cls([b""] * (max(ranks.values()) + 1), pattern)
        out.left, out.right = [-1] * len(out.tokens), [-1] * len(out.tokens)
        for token, rank in ranks.items():
            out.tokens[rank] = token
            parts = merge(token, ranks, rank)
            if len(parts) == 2:
                out.left[rank], out.right[rank] = ranks[parts[0]], ranks[parts[1]]
            elif len(token) == 1:
                out.left[rank] = out.right[rank] = rank
        out.digest = hashlib.md5(b"|".join([pattern.encode(), *out.tokens])).hexdigest()
        return out


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain BPE, quadratic: merge the neighbours of the lowest rank (under ``below``) until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and (below is None or r < below)), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Coder:
    """Encodes and decodes with one vocabulary; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.tokens, self.left, self.right = vocabulary.tokens, vocabulary.left, vocabulary.right
        # A token without two parts is one that merges never make; it is no candidate.
        usable = self.usable = {t: i for i, t in enumerate(self.tokens) if t and self.left[i] >= 0}
        self.sizes = [len(t) for t in self.tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.tokens)
        for token, i in usable.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((usable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), -1)
        self.automaton.make_automaton()
        self.find = regex.compile(vocabulary.pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay as they are when they stand side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        tokens, left, right = self.tokens, self.left, self.right
        limit = len(tokens)  # merges across the seam from this rank on come too late
        while True:
            joined = self.ids.get(tokens[a] + tokens[b])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges; of a part that is a byte nothing can be undone.
            undo_a = len(tokens[a]) > 1 and (len(tokens[b]) == 1 or a > b)
            if undo_a:
                limit, a = min(limit, a), right[a]
            elif len(tokens[b]) > 1:
                limit, b = min(limit, b + 1), left[b]
            else:
                return True

    def piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.usable.get(piece)
        if whole is not None:
            return (whole,)
        n, sizes, shorter, pairs = len(piece), self.sizes, self.shorter, self.pairs
        longest = [-1] * n
        # Matches of one end come from the longest on, those of one start by rising end: the last one written is the longest.
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[i]] = i
        shut: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            if end not in shut:
                if before < 0:
                    fits = True
                else:
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return tuple(out)
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                shut.add(at)
                last = out.pop()
                at -= sizes[last]
                before = out[-1] if out else -1
                token = shorter[last]

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Pieces are remembered in two generations, so that frequent ones outlive a full memory."""
        pieces, out = self.pieces, []
        for p in self.find(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.older.get(p)
                if ids is None:
                    ids = self.piece(p.encode("utf-8", "replace"))
                if len(p) <= 64:
                    if len(pieces) >= MAX_PIECES:
                        self.older, self.pieces = pieces, {}
                        pieces = self.pieces
                    pieces[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    """The worker's coder for a broadcast vocabulary; it is kept between tasks."""
    key = shared.value.digest
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shared.value)
    return _coders[key]


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[int]]:
    """Values of all lists in a row, and where each list begins and ends; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).tolist()


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of a text as array<int>. A null text is empty. Rows are independent; the vocabulary has a fixed size.

    A column that is named like the new one gives way to it.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in common.sliced(batches):
            ids = [coder.encode(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes. A column that is named like the new one gives way to it."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens  # no automaton and no memory of pieces is needed here
        for b in common.sliced(batches):
            flat, ends = _flat(b.column(b.schema.get_field_index(ids)))
            each = flat.tolist()
            found = [b"".join(map(tokens.__getitem__, each[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "bytes") -> DataFrame:
    """``encode`` and then ``decode`` in one pass, so that a task needs one Python worker. Columns of these names give way."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    df = df.drop(ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in common.sliced(batches, 200):
            coded = [coder.encode(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            found = [coder.decode(x) for x in coded]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(coded, pa.list_(pa.int32())), pa.array(found, pa.binary())], names=[*b.schema.names, ids, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]))


def digests(df: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "bytes") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            flat, ends = _flat(b.column(b.schema.get_field_index(ids)))
            flat = flat.astype("<u4")
            packed = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            whole = [hashlib.sha256(x or b"").hexdigest() for x in b.column(b.schema.get_field_index(decoded)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(key)), pa.array(np.diff(ends), pa.int64()), pa.array(packed), pa.array(whole)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of all documents."""
    vocabulary = default_vocabulary()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs, vocabulary).select("doc_id", "ids", "bytes"))
