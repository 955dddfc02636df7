"""Token counts of whole texts, with a whole-token shortcut.

Most words of running text are one token each. For every string of the vocabulary it is proved once, on the driver,
whether the merges turn it into exactly one token; a pre-token in that set counts one without any merging, and only
the rest goes through the merges.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logforge.llm.common import once, read_table

#: The pre-token pattern of the tokenizer file, which tests compare with the file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens that a worker remembers at most, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 60
_CANDIDATES = [*range(0x0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), *range(0x20A0, 0x20C0)]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass(frozen=True)
class WholeTokens:
    """What the driver proves about a tokenizer: bounded by the size of its vocabulary."""

    json: str
    whole: frozenset[str]  #: pre-tokens that the merges turn into one token
    added: tuple[str, ...]  #: strings that the library cuts out of a text as one token each
    plain: str  #: characters on which str.lower and SPLIT agree with the library's normaliser and splitter


def prove(path: str) -> WholeTokens:
    """Runs every vocabulary string through the merges, and every candidate character through the normaliser."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    tok = Tokenizer.from_str(text)
    alphabet = byte_alphabet()
    to_byte = {c: b for b, c in alphabet.items()}
    whole = set()
    for entry in tok.get_vocab(with_added_tokens=False):
        if not entry.endswith("</w>"):
            continue
        mapped = entry[: -len("</w>")]
        if not mapped or any(c not in to_byte for c in mapped):
            continue
        try:
            word = bytes(to_byte[c] for c in mapped).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(tok.model.tokenize(mapped)) == 1:
            whole.add(word)
    split = regex.compile(SPLIT)
    plain = []
    for code in _CANDIDATES:
        c = chr(code)
        same = unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c)
        for probe in (c, f"a{c}a", f"1{c}{c}!", f"'{c}"):
            lower = tok.normalizer.normalize_str(probe)
            pieces = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(lower)]
            mine = ["".join(map(alphabet.__getitem__, w.encode())) for w in split.findall(probe.lower())]
            same = same and pieces == mine
        if same:
            plain.append(c)
    added = tuple(a.content for a in tok.get_added_tokens_decoder().values())
    return WholeTokens(text, frozenset(whole), added, "".join(plain))


class _Counts(dict):
    """Tokens of a pre-token: looked up, or merged once and remembered."""

    def __init__(self, table: WholeTokens, model, mapped: bool):
        self.model, self.mapped, self.alphabet, self.room = model, mapped, byte_alphabet(), REMEMBERED
        self.whole = () if mapped else table.whole
        super().__init__(dict.fromkeys(self.whole, 1))

    def __missing__(self, word: str) -> int:
        piece = word if self.mapped else "".join(map(self.alphabet.__getitem__, word.encode()))
        n = len(self.model.tokenize(piece))
        if len(word) <= REMEMBERED_CHARS:
            if self.room <= 0:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.room = REMEMBERED
            self[word] = n
            self.room -= 1
        return n


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, table: WholeTokens):
        self.tok = Tokenizer.from_str(table.json)
        self.split = regex.compile(SPLIT).findall
        self.other = re.compile(f"[^{re.escape(table.plain)}]").search
        self.cut = re.compile("|".join(map(re.escape, table.added))) if table.added else None
        self.words, self.mapped = _Counts(table, self.tok.model, False), _Counts(table, self.tok.model, True)

    def _piece(self, text: str) -> int:
        if text.isascii() or not self.other(text):
            return sum(map(self.words.__getitem__, self.split(text.lower())))
        lower = self.tok.normalizer.normalize_str(text)
        return sum(self.mapped[p] for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(lower))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self._piece(text)
        pieces = self.cut.split(text)
        return len(pieces) - 1 + sum(self._piece(p) for p in pieces if p)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with a column n_tokens (long), which replaces one of that name.

    A null or empty text has 0 tokens. A text is counted whole, however long; rows are counted each by itself, so
    repeated rows and ids, null ids and an empty table need no care.
    """
    table = docs.sparkSession.sparkContext.broadcast(prove(path))
    key = ("token counts", path, len(table.value.json))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = once(key, lambda: Counter(table.value))
        return pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", n_tokens(F.col(text_col)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )
