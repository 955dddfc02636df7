"""Alignment of two tokenizers' tokens of the same bytes.

Each text is cut at spaces at which both vocabularies are proved to cut, so a unit's tokens do not depend on what stands
around it, and each distinct unit of a batch is encoded once. Within units, the B tokens' byte ranges form a static
interval index; a bisection for each A token finds the B tokens that it overlaps. A gap between bytes that no token of
either side spans ends a group. What pairs of ids are linked how often is then counted over the corpus by Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from logforge.llm.common import materialise, once, read_table

#: Characters of texts that are aligned at once, and units that are encoded at once.
SLICE_CHARS, UNITS_AT_ONCE = 4_000_000, 5_000
#: A pair is hot with more than one in so many of all links, so there are fewer hot pairs than that.
MOST_HOT = 1 << 17
#: The only pre-tokenizer that the cuts are proved for: no match of its pattern goes from another character to a space.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_CUT = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 characters stand for themselves, the
    others for those from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers, what their ids stand for, and whether texts may be cut before a space that follows another
    character than white space: for B, if no piece has a space after anything but spaces."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec, letters = json.loads(a_json), byte_letters()
        a_bytes = {i: bytes(letters.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [b"" if self.b.is_control(i) else piece_bytes(p) for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        known = spec["pre_tokenizer"] or {}
        self.cuts = (all(known.get(k) == v for k, v in _BYTE_LEVEL.items()) and not spec.get("normalizer")
                     and not any("▁" in p.lstrip("▁") for p in pieces))

    def units(self, text: str) -> list[str]:
        """What stands between the cuts; space and unit together are aligned, as space and text are."""
        return _CUT.split(text) if self.cuts else [text]

    def ids(self, unit: str, first: bool = False) -> tuple[list[int], list[int]]:
        a = self.a.encode(" " + unit, add_special_tokens=False).ids
        if first or not self.cuts:
            return a, self.b.encode(unit)
        # B gives an empty text no space, and one at a text's end stands for itself
        before = self.b.encode("a")
        return a, self.b.encode("a " + unit)[len(before):]

    def same(self, a: list[int], b: list[int], data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data


class Aligned:
    """The alignment of distinct units: for each, whether both sides' bytes are the unit's, the number of tokens and
    groups, the groups in writing, and the linked pairs of ids."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.sizes: list[tuple[bool, int, int]] = []
        self.written: list[str] = []
        self.links: list[np.ndarray] = []

    def add(self, units: list[str]) -> None:
        for at in range(0, len(units), UNITS_AT_ONCE):
            part = units[at : at + UNITS_AT_ONCE]
            if self.pair.cuts and all(u and not u[-1].isspace() for u in part):
                data = "".join(" " + u for u in part).encode()
                a, b = self.pair.ids("".join(" " + u for u in part)[1:], first=True)
                if self.pair.same(a, b, data):
                    self._align(a, b, np.cumsum([len(u.encode()) + 1 for u in part]))
                    continue
            for u in part:
                self._alone(*self.pair.ids(u), u)

    def _alone(self, a: list[int], b: list[int], unit: str) -> None:
        data = (" " + unit).encode()
        if self.pair.same(a, b, data):
            self._align(a, b, np.array([len(data)]))
        else:
            self.sizes.append((False, 0, 0))
            self.written.append("")
            self.links.append(np.empty(0, np.int64))

    def _align(self, a: list[int], b: list[int], unit_ends: np.ndarray) -> None:
        a_ids, b_ids = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.pair.a_size[a_ids]), np.cumsum(self.pair.b_size[b_ids])
        # the index over B's ranges, which lie in order: starts and ends are each sorted
        b_starts = b_ends - self.pair.b_size[b_ids]
        last = np.searchsorted(b_starts, a_ends, "left") - 1  # the last B token that an A token overlaps
        shut = np.flatnonzero(b_ends[last] == a_ends)  # no B token reaches over the end of these A tokens
        codes = a_ids[shut] << 32 | b_ids[last[shut]]
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups, low_a, low_b = [], 0, 0
        for i, j in zip((shut + 1).tolist(), (last[shut] + 1).tolist()):
            groups.append(f"{','.join(a_text[low_a:i])}|{','.join(b_text[low_b:j])}")
            low_a, low_b = i, j
        ends_a = np.searchsorted(a_ends, unit_ends, "right")
        ends_b = np.searchsorted(b_ends, unit_ends, "right")
        ends_g = np.searchsorted(a_ends[shut], unit_ends, "right")
        n_a, n_b, start = np.diff(ends_a, prepend=0).tolist(), np.diff(ends_b, prepend=0).tolist(), 0
        for k, end in enumerate(ends_g.tolist()):
            self.sizes.append((True, n_a[k], n_b[k]))
            self.written.append(";".join(groups[start:end]))
            self.links.append(codes[start:end])
            start = end


class _Row:
    """What is known of a text while its units are met."""

    def __init__(self):
        self.same, self.n_a, self.n_b, self.started, self.hash = True, 0, 0, False, hashlib.sha256()
        self.codes = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def add(self, units: list[int], found: Aligned) -> None:
        sizes = [found.sizes[u] for u in units]
        self.same = self.same and all(s[0] for s in sizes)
        if not self.same:
            return
        self.n_a += sum(s[1] for s in sizes)
        self.n_b += sum(s[2] for s in sizes)
        self.hash.update((";" * self.started + ";".join([found.written[u] for u in units])).encode())
        self.started = True
        new, n = np.unique(np.concatenate([found.links[u] for u in units]), return_counts=True)
        if len(self.codes):  # a text in several parts
            new, at = np.unique(np.concatenate((self.codes, new)), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate((self.counts, n))).astype(np.int64)
        self.codes, self.counts = new, n

    def result(self) -> tuple:
        if not self.same or not self.started:
            none = np.empty(0, np.int32)
            return 0, 0, 0, "", none, none, none
        pairs = (self.codes >> 32).astype(np.int32), (self.codes & 0xFFFFFFFF).astype(np.int32), self.counts.astype(np.int32)
        return self.n_a, self.n_b, int(self.counts.sum()), self.hash.hexdigest(), *pairs


def _parts(pair: Pair, text: str, most: int) -> Iterator[list[str]]:
    """The units of a text, not many more than `most` characters at a time where there are cuts."""
    at = 0
    while pair.cuts and len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield pair.units(text[at : cut.start()])
        at = cut.end()
    yield pair.units(text[at:])


def align_batch(pair: Pair, texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple]:
    """(n_a, n_b, n_links, groups_sha256, a, b, k) of each text, in order: a, b, k are the distinct linked pairs of ids
    and how often the text links them. About `most` characters are held at a time."""
    rows: list[_Row] = []
    held: list[tuple[_Row, list[str]]] = []
    size = 0

    def settle() -> None:
        number: dict[str, int] = {}
        asked = [(row, [number.setdefault(u, len(number)) for u in units]) for row, units in held]
        found = Aligned(pair)
        # units that end in white space are met alone
        order = sorted(number, key=lambda u: not u or u[-1].isspace())
        found.add(order[: (plain := sum(1 for u in order if u and not u[-1].isspace()))])
        found.add(order[plain:])
        place = {number[u]: k for k, u in enumerate(order)}
        for row, units in asked:
            row.add([place[u] for u in units], found)

    for text in texts:
        row = _Row()
        rows.append(row)
        if not text:
            continue
        if not pair.cuts:
            found = Aligned(pair)
            found._alone(*pair.ids(text, first=True), text)
            row.add([0], found)
            continue
        for units in _parts(pair, text, most):
            held.append((row, units))
            size += sum(map(len, units)) + len(units)
            if size >= most:
                settle()
                held, size = [], 0
    settle()
    for row in rows:
        yield row.result()


_PARTS = {"n_a": (T.LongType(), pa.int64()), "n_b": (T.LongType(), pa.int64()), "n_links": (T.LongType(), pa.int64()), "groups_sha256": (T.StringType(), pa.string()),
          **{n: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())) for n in "abk"}}


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: the id, a number of the row (__row), n_a, n_b, n_links, groups_sha256, and a, b, k: the
    distinct linked pairs of ids and how often. Null and empty texts, and those whose bytes one side does not keep, have
    no tokens: zeros and an empty digest."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    key = ("token alignment", hashlib.sha256(files[0]).hexdigest(), hashlib.sha256(files[1]).hexdigest())
    files = docs.sparkSession.sparkContext.broadcast(files)  # bounded by the vocabularies

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = once(key, lambda: Pair(*files.value), alone=True)
            found = zip(*align_batch(pair, batch.column("text").to_pylist()))
            own = [pa.array(list(values), kind) for values, (_, kind) in zip(found, _PARTS.values())]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *own], names=["__row", id_col, *_PARTS])

    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, t) for n, (t, _) in _PARTS.items()]])
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of the whole corpus hold each pair of ids, and whether no pair of the same b has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b", "k")).alias("p")).select("p.*")
    counts = materialise(pairs.groupBy("a", "b").agg(F.sum(F.col("k").cast("long")).alias("n")))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    met = counts.join(F.broadcast(most), "b")  # a row for each id of B's vocabulary at most
    return materialise(met.select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_hot: int = MOST_HOT) -> DataFrame:
    """For each row of docs: the id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that end together), n_best (links
    whose pair is linked as often in the corpus as any of its b), count_sum (the sum over links of their pair's count in
    the corpus), all long, and groups_sha256: the digest of the groups, written as `a1,a2|b1;a3|b2,b3`.

    Null and empty texts have no tokens, nor do those whose tokens' bytes, joined, are not a space and the text: zeros and
    an empty groups_sha256. Repeated rows and null ids each have their row, and their links count; very long texts are
    aligned a part at a time; an empty table gives an empty table.

    Pairs with more than one in most_hot of all links are looked up where the rows are; there are fewer than most_hot
    of them. The other pairs, none of which is common, meet their counts by a shuffle."""
    rows = materialise(align_texts(docs, a_path, b_path, id_col, text_col))
    counts = pair_counts(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") > total / most_hot))  # fewer than most_hot rows
    rare = counts.where(F.col("n") <= total / most_hot)
    pairs = rows.select("__row", F.explode(F.arrays_zip("a", "b", "k")).alias("p")).select("__row", "p.*")
    sums = F.sum(F.col("k") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0).cast("long")).alias("n_best")
    parts = [pairs.join(hot, ["a", "b"]).groupBy("__row").agg(*sums),
             pairs.join(hot, ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("__row").agg(*sums)]
    both = parts[0].unionByName(parts[1]).groupBy("__row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # tokens are not empty, so each group has one link: its last token of either side
    return rows.drop("a", "b", "k").join(both, "__row", "left").select(
        id_col, "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
