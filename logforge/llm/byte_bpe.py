"""Byte-level BPE encoding and decoding in linear time.

The exact merges of a rank table are reproduced without merging: tokens are tried longest match first, and a token is
accepted after another only if the two, merged from their bytes, would stay two. If nothing fits, the last token gives
way to its next shorter prefix. Each position is ruled out at most once, so the work is linear. Bytes are mapped to
Latin-1 characters, which pyahocorasick searches.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logforge.llm.common import once, read_table

#: Pre-tokens that a worker remembers at most, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 250_000, 40
#: Pairs of tokens whose compatibility a worker remembers at most.
REMEMBERED_PAIRS = 300_000
#: Texts whose ids a worker holds at once.
AT_ONCE = 256


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Codec:
    """Encodes bytes by a rank table, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        if max(self.size.values()) > 255:
            raise ValueError("a token is longer than 255 bytes")
        if any(chr(b) not in self.ids for b in range(256)):
            raise ValueError("every byte must be a token")
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ids.items():
            self.search.add_word(token, rank << 8 | len(token))
        self.search.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank, token in self.text.items():
            for cut in range(len(token) - 1, 0, -1):
                if (shorter := self.ids.get(token[:cut])) is not None:
                    self.shorter[rank] = shorter
                    break
        for rank in sorted(self.text):  # in the order of merges: what a token is merged from comes before it
            self.halves[rank] = self._halves(rank)

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice if it is no merge."""
        token = self.text[rank]
        left = self.shorter.get(rank)
        while left is not None:
            right = self.ids.get(token[len(self.text[left]) :])
            if right is not None and left < rank and right < rank and self.compatible(left, right, rank):
                return left, right
            left = self.shorter.get(left)
        return rank, rank

    def compatible(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether the bytes of the two tokens, encoded together with merges below limit, give just these two."""
        if limit == 1 << 62 and (known := self.fits.get((left, right))) is not None:
            return known
        answer, a, b, top = True, left, right, limit
        while True:
            merged = self.ids.get(self.text[a] + self.text[b])
            if merged is not None and merged < top:
                answer = False
                break
            # undo the later of the two merges: up to then these two stood side by side
            if a > b:
                top, (low, high) = a, self.halves[a]
                if low == high == a:
                    top, (low, high) = b + 1, self.halves[b]
                    if low == high == b:
                        break
                    b = low
                else:
                    a = high
            else:
                top, (low, high) = b + 1, self.halves[b]
                if low == high == b:
                    top, (low, high) = a, self.halves[a]
                    if low == high == a:
                        break
                    a = high
                else:
                    b = low
        if limit == 1 << 62:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            self.fits[left, right] = answer
        return answer

    def encode_piece(self, data: bytes) -> list[int]:
        piece = data.decode("latin-1")
        whole = self.ids.get(piece)
        if whole is not None:  # as the library: a pre-token that is a token stays one
            return [whole]
        best: dict[int, int] = {}
        for end, found in self.search.iter(piece):
            # ends come in order, so a later match at a start is a longer one
            best[end + 1 - (found & 255)] = found >> 8
        size, shorter, fits = self.size, self.shorter, self.fits
        shut: set[int] = set()  # places at which no token can start
        out: list[int] = []
        at, length, last = 0, len(piece), -1
        token: int | None = best[0]
        while token is not None:
            end = at + size[token]
            if end not in shut:
                if last < 0:
                    fit = True
                elif (fit := fits.get((last, token))) is None:
                    fit = self.compatible(last, token)
                if fit:
                    out.append(token)
                    at, last = end, token
                    token = best[at] if at < length else None
                    continue
            token = shorter.get(token)
            if token is None:  # nothing fits here: the last token gives way
                shut.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Encoded(dict):
    """The ids of a pre-token as little-endian unsigned 32-bit integers: looked up, or encoded once and remembered."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.room = codec, REMEMBERED

    def __missing__(self, piece: str) -> bytes:
        ids = _pack(self.codec.encode_piece(piece.encode()))
        if len(piece) <= REMEMBERED_CHARS:
            if self.room <= 0:
                self.clear()
                self.room = REMEMBERED
            self[piece] = ids
            self.room -= 1
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.codec, self.split = Codec(ranks), regex.compile(pattern).findall
        self.pieces = _Encoded(self.codec)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with columns ids (array of int) and decoded (binary): what the ids decode to. They replace columns of
    those names. keep: the columns of docs that stay, all by default. A null or empty text has no ids. Rows are taken each
    by itself, whole, so repeated rows, null ids and an empty table need no care."""
    return _encoded(docs, path, pattern, text_col, keep, {"ids": _IDS, "decoded": ("binary", pa.binary())}, lambda ids, back: (_ids(ids), back))


def encode_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """As encode(), but with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and bytes themselves."""
    return _encoded(docs, path, pattern, text_col, keep, _DIGESTS, _digests)


def encode_checked(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """As encode_digests(), with the ids too: what a training run reads, and what shows that it is whole."""
    return _encoded(docs, path, pattern, text_col, keep, {**_DIGESTS, "ids": _IDS}, lambda ids, back: (*_digests(ids, back), _ids(ids)))


_IDS = "array<int>", pa.list_(pa.int32())
_DIGESTS = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4").astype("int32")


def _digests(ids: bytes, back: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


def _encoded(docs: DataFrame, path: str, pattern: str, text_col: str, keep: Sequence[str] | None, new: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """docs' columns and the new ones (Spark's and Arrow's type of each). Batches pass through as Arrow, so columns keep
    their types, and are encoded a slice at a time, so a worker never holds a whole batch's ids."""
    with open(path, "rb") as f:
        lines = f.read()
    key = ("byte bpe", pattern, hashlib.sha256(lines).hexdigest())
    lines = docs.sparkSession.sparkContext.broadcast(lines)  # bounded by the vocabulary
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    read = docs.select(*[F.col(f"`{c}`") for c in kept if c != text_col], F.col(f"`{text_col}`"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = once(key, lambda: Encoder(read_ranks(lines.value), pattern))
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = map(encoder.encode, part.column(text_col).to_pylist())
                rows = [row(ids, encoder.codec.decode(np.frombuffer(ids, "<u4").tolist())) for ids in found]
                own = [pa.array(values, type_) for values, (_, type_) in zip(zip(*rows), new.values())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + own, names=[*kept, *new])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, _SPARK[t]) for n, (t, _) in new.items()])
    return read.mapInArrow(encoded, schema)


_SPARK = {"array<int>": T.ArrayType(T.IntegerType()), "binary": T.BinaryType(), "long": T.LongType(), "string": T.StringType()}


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_digests(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
