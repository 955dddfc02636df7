"""License scans: exact phrases, and short notices with a few errors.

A notice of k allowed edits is cut into k + 1 pieces; a text within k edits of it holds at least one piece unchanged
(the pigeonhole principle). An Aho-Corasick automaton finds the pieces; around each, the regex library's bounded-error
matching verifies the edits and reports the span. A match begins and ends with a word of the text, and the words that
tell one licence from another must stand as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import once, read_table

#: Phrase and label of the base; every place of the phrase's words counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notice (words in lower case), label and allowed edits. Words in brackets allow none: they tell licences apart.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("released under the [mit] license", "mit", 2),
    ("licensed under the [apache] license version 2 0", "apache", 3),
    ("licensed under the gnu [general public] license", "gpl", 3),
    ("under the terms of the gnu [general public] license", "gpl", 3),
    ("licensed under the gnu [lesser general public] license", "lgpl", 3),
    ("under the terms of the gnu [lesser general public] license", "lgpl", 3),
    ("licensed under the gnu [affero general public] license", "agpl", 3),
    ("under the terms of the gnu [affero general public] license", "agpl", 3),
    ("licensed under [cc by] 4 0", "cc-by", 1),
    ("licensed under [cc by sa] 4 0", "cc-by-sa", 1),
    ("licensed under [cc by nd] 4 0", "cc-by-nd", 1),
    ("licensed under [cc by nc] 4 0", "cc-by-nc", 1),
    ("licensed under [cc by nc sa] 4 0", "cc-by-nc-sa", 1),
    ("licensed under [cc by nc nd] 4 0", "cc-by-nc-nd", 1),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 4),
    ("subject to the terms of the [mozilla] public license", "mpl", 3),
    ("this is free and unencumbered software released into the [public domain]", "unlicense", 4),
    ("[all] rights reserved", "all-rights-reserved", 1),
)
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label string, start int, end int, edits int>>"
)


def _parts(notice: str) -> list[tuple[str, bool]]:
    """The notice's parts that may have errors (False) and those that may not (True), which have the spaces beside them."""
    cut = [(p, k % 2 == 1) for k, p in enumerate(regex.split(r"( ?\[[^]]*\] ?)", notice))]
    return [(p.replace("[", "").replace("]", ""), fixed) for p, fixed in cut if p]


def _shares(edits: int, n: int) -> list[tuple[int, ...]]:
    """The ways to deal all of the edits to n parts."""
    return [c for c in product(range(edits + 1), repeat=n) if sum(c) == edits]


def pattern(notice: str, edits: int) -> str:
    """A regular expression for the notice, from word to word, with at most so many edits in the parts that may have them."""
    parts, ways = _parts(notice), []
    for share in _shares(edits, sum(not fixed for _, fixed in parts)):
        left = iter(share)
        ways.append("".join(regex.escape(p, literal_spaces=True) if fixed else f"(?:{regex.escape(p, literal_spaces=True)}){{e<={next(left)}}}" for p, fixed in parts))
    return f"(?b)(?<![^ ])(?:{'|'.join(ways)})(?![^ ])"


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str, int]]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.last = [p.split()[-1].encode() for p, _ in phrases]
        self.notices = [("".join(p for p, _ in _parts(n)), label, edits, regex.compile(pattern(n, edits))) for n, label, edits in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, edits, _) in enumerate(self.notices):
            cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def _base(self, joined: bytes) -> tuple[int, int | None, int | None, set[str]]:
        padded, n, first, last, labels = b" " + joined + b" ", 0, None, None, set()
        for (phrase, label), word in zip(self.phrases, self.last):
            if word not in joined:
                continue
            at, before, words = padded.find(phrase), 0, 0
            while at >= 0:
                words += padded.count(b" ", before, at)  # spaces before a word: its index
                before = at
                n, first, last = n + 1, words if first is None else min(first, words), words if last is None else max(last, words)
                labels.add(label)
                at = padded.find(phrase, at + 1)
        return n, first, last, labels

    def _fuzzy(self, joined: str) -> list[tuple[str, int, int, int]]:
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            for k, offset in places:
                text, _, edits, _ = self.notices[k]
                start = end + 1 - size - offset
                low, high = max(0, start - edits), start + len(text) + edits
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = set()
        for k, own in windows.items():
            _, label, _, pattern = self.notices[k]
            for low, high in own:
                # the best match comes first; others may stand on either side of it
                open_ = [(low, min(high, len(joined)))]
                while open_:
                    low, high = open_.pop()
                    if high < len(joined) and joined[high] != " ":
                        high = joined.rfind(" ", low, high)  # to the end of a word, as the pattern takes it for the text's
                    if high > low and (m := pattern.search(joined, low, high)):
                        found.add((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                        open_ += [(low, m.start()), (m.end(), high)]
        return sorted(found, key=lambda x: (x[1], x[2], x[0], x[3]))

    def __call__(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(_WORDS).split()
        joined = b" ".join(words)
        n, first, last, base = self._base(joined)
        spans = self._fuzzy(joined.decode())
        near = max((1 - edits / (end - start) for _, start, end, edits in spans), default=0.0)
        return (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
                1.0 if n else max(0.0, near), spans)


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """docs with the columns of SCHEMA, which replace columns of those names; spans are character places in the words
    of the text joined by single spaces. score is 1 with a base phrase, else 1 less the edits' share of the best span.

    A null or empty text has no words and no labels. Each whole text is scanned by itself, so repeated rows, null ids
    and empty tables need no care.
    """
    names = [part.split()[0] for part in SCHEMA.split(", spans")[0].split(", ")] + ["spans"]
    phrases, notices = tuple(phrases), tuple(notices)

    @F.pandas_udf(SCHEMA)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        scan = once(("licenses", phrases, notices), lambda: Scanner(phrases, notices))
        out = pd.DataFrame([scan(t) for t in texts], columns=names)
        out["spans"] = [[dict(zip(("label", "start", "end", "edits"), s)) for s in spans] for spans in out["spans"]]
        for name in ("first_word", "last_word"):
            out[name] = out[name].astype("Int64")
        return out

    own = "__lf_scanned"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.withColumn(own, scanned(F.col(text_col))).select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "spans")
