"""Benchmark decontamination by the q-gram lemma.

A text within k edits of a benchmark item of n characters shares at least n - q + 1 - k q of its q-grams, and the
shared ones lie on diagonals (place in the text less place in the item) at most k apart. Shared q-grams are counted in
diagonal bands of twice that width that overlap by half, so one band holds them all; bands that reach the bound are
verified by an alignment that stays in the band.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import materialise, once, read_table

#: Length of the q-grams, and edits as a share of an item's characters.
Q, EDIT_SHARE = 8, 0.08
#: Bytes of items that the driver and a worker hold, and that are sought in one pass; larger benchmarks are taken in as
#: many passes, one after another, as they need.
PASS_BYTES = 4 << 20
_HITS = 1 << 20  # pairs of equal q-grams that are held at once


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q characters."""
    base, size = 0x9E3779B97F4A7C15, 1
    out = codes.astype(np.uint64) + np.uint64(0x517CC1)
    while size < q:  # doubling: a run's hash is that of its first part, shifted, and that of the rest
        step = min(size, q - size)
        out = out[:-step] * np.uint64(pow(base, step, 1 << 64)) + out[step:]
        size += step
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, anywhere: bool = True) -> tuple[int, int]:
    """(edits, end): the fewest edits between the whole item and a part of the text, on alignments that stay on the
    diagonals low..high, and the first end of such a part. Unless anywhere, the part begins at the text's first character."""
    width, n = high - low + 1, len(item)
    steps = np.arange(width)
    padded = np.full(n + width + 1, 0xFFFFFFFF, dtype=np.int64)
    a, b = max(0, low), min(len(text), n + high + 1)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    never = n + width + 1
    start = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, never) if anywhere else np.where(steps + low >= 0, steps + low, never)
    cost = start.astype(np.int64)
    for i in range(n):
        other = cost + (padded[i : i + width] != item[i])
        other[:-1] = np.minimum(other[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(other - steps) + steps
    ends = steps + low + n
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, never)
    best = int(cost.argmin())
    return int(cost[best]), int(ends[best])


class Searcher:
    """Finds the items of one pass in texts."""

    def __init__(self, items: list[tuple], q: int, share: float):
        self.q = q
        self.items = [(i, normalise(t)) for i, t in items]
        self.short = [(i, t) for i, t in self.items if t and len(t) < q]  # shorter than a q-gram: found as they are
        self.items = [(i, t) for i, t in self.items if len(t) >= q]
        self.codes = [_codes(t) for _, t in self.items]
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        # so many edits that the lemma still asks for a shared q-gram
        self.edits = np.minimum((sizes * share + 1e-9).astype(np.int64), (sizes - q) // q)
        self.bound = sizes - q + 1 - self.edits * q
        grams = [_grams(c, q) for c in self.codes] or [np.zeros(0, np.uint64)]
        all_grams = np.concatenate(grams)
        item = np.repeat(np.arange(len(self.codes)), [len(g) for g in grams][: len(self.codes)])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.grams >> self.shift).astype(np.int64)] = True

    def _expand(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the q-grams of these slots stand in the items: index of each place, and its item."""
        n = self.count[slot]
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slot], n)
        return index, self.item[index]

    def _bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) of the bands that reach the item's bound; band b starts at diagonal b (edits + 1)."""
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[(grams >> self.shift).astype(np.int64)])
        if not len(at):
            return []
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        true = self.grams[slot] == grams[at]
        at, slot = at[true], slot[true]
        # an item with fewer shared q-grams in the whole text than its bound has no such band
        counts, total = self.count[slot], np.zeros(len(self.codes), dtype=np.int64)
        for one in range(0, len(at), _HITS >> 4):
            total += np.bincount(self._expand(slot[one : one + (_HITS >> 4)])[1], minlength=len(total))
        enough = total >= self.bound
        if not enough.any():
            return []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.cumsum(counts)
        cut = 0
        while cut < len(at):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + _HITS, side="right")))
            index, item = self._expand(slot[cut:to])
            open_ = enough[item]
            item = item[open_]
            band = (np.repeat(at[cut:to], counts[cut:to])[open_] - self.place[index[open_]]) // (self.edits[item] + 1)
            for b in (band, band - 1):
                found.append(np.unique(item * (1 << 40) + (b + (1 << 39)), return_counts=True))
            cut = to
        if not found:
            return []
        keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([c for _, c in found]))
        item = keys >> 40
        good = total >= self.bound[item]
        return [(int(k >> 40), int((k & ((1 << 40) - 1)) - (1 << 39))) for k in keys[good]]

    def __call__(self, text: str | None) -> list[tuple]:
        """(item_id, edits, start, end) of each item found, at its best place; places in the normalised text."""
        plain = normalise(text)
        best: dict = {}
        for i, t in self.short:
            if (at := plain.find(t)) >= 0:
                best[i] = (0, at, at + len(t))
        if len(plain) >= self.q and self.items:
            codes = _codes(plain)
            for k, band in self._bands(codes):
                (i, t), item, edits = self.items[k], self.codes[k], int(self.edits[k])
                if i in best and best[i][0] == 0:
                    continue
                low, high = band * (edits + 1), (band + 2) * (edits + 1) - 1
                at = plain.find(t, max(0, low), high + len(t) + 1)
                if at >= 0:
                    best[i] = (0, at, at + len(t))
                    continue
                cost, end = align(item, codes, low - edits, high + edits)
                if cost <= edits and (i not in best or cost < best[i][0]):
                    _, back = align(item[::-1], codes[max(0, end - len(item) - edits) : end][::-1], -edits, edits, anywhere=False)
                    best[i] = (cost, end - back, end)
        return sorted((i, *found) for i, found in best.items())


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               q: int = Q, share: float = EDIT_SHARE, out_col: str = "leaks") -> DataFrame:
    """docs with a column leaks (or out_col), which replaces one of that name: an array of (item_id, edits, start, end), one for each
    benchmark item that stands in the text, lower-cased and with runs of white space as one space, with edits of at most
    `share` of its characters; start and end are character places in that form of the text.

    Null and empty texts have no leaks; items of null or empty text, or with a null id, are never found. Item ids are
    numbers or strings. Of several places of an item the one of fewest edits is given, of those the first found. Items
    that repeat an id count as one. Rows are taken each by itself, whole, so repeated rows and null ids need no care;
    empty tables give empty results. A benchmark of over PASS_BYTES is sought slice by slice: the texts are written
    once with a row number, each slice's finds are written before the next slice is read, and its searcher is dropped.
    """
    kind = dict(benchmark.dtypes)[item_col]
    schema = f"array<struct<item_id: {kind}, edits: int, start: int, end: int>>"
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    passes = max(1, -(-int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PASS_BYTES))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    if passes == 1:
        return base.withColumn(out_col, _finder(items, schema, q, share)(F.col(text_col)))
    base = materialise(base.withColumn("__lf_row", F.monotonically_increasing_id()))
    finds = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        found = base.select("__lf_row", _finder(part, schema, q, share)(F.col(text_col)).alias("f")).where(F.size("f") > 0)
        finds.append(materialise(found))
    leaks = reduce(DataFrame.unionByName, finds).groupBy("__lf_row").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("f"))
    # texts of one item id may have stood in different slices
    best = F.filter("f", lambda x, k: (k == 0) | (F.get("f", k - 1)["item_id"] != x["item_id"]))
    leaks = leaks.select("__lf_row", best.alias(out_col))
    none = F.array().cast(schema)
    return base.join(leaks, "__lf_row", "left").withColumn(out_col, F.coalesce(out_col, none)).drop("__lf_row")


def _finder(items: DataFrame, schema: str, q: int, share: float):
    """A function of texts that gives the items found. items (i, t) are collected: they are one slice of a benchmark."""
    rows = [(r.i, r.t) for r in items.orderBy("i", "t").collect()]  # about PASS_BYTES
    key = ("leaks", hashlib.sha256(repr(rows).encode()).hexdigest(), q, share)
    held = items.sparkSession.sparkContext.broadcast(rows)
    names = ("item_id", "edits", "start", "end")

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.Series:
        search = once(key, lambda: Searcher(held.value, q, share), alone=True)
        return pd.Series([[dict(zip(names, row)) for row in search(t)] for t in texts], dtype=object)

    return found


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
