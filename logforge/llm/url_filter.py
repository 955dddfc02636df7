"""URL filters: host and path rules, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the whole url; a term counts only where neither neighbour is
an ASCII letter or digit. One strict term rejects a url, and so do several distinct soft ones whose weights add up to
as much.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib.resources import files

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logforge.llm.common import once, read_table

#: Rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The weight at which a term is strict, and distinct soft terms together reject a url.
STRICT_WEIGHT = 4


def read_vocabulary(text: str) -> tuple[tuple[str, int], ...]:
    """Terms and weights of a vocabulary: lines of term, tab, weight; lines that begin with # say what it is."""
    rows = [line.split("\t") for line in text.splitlines() if line and not line.startswith("#")]
    return tuple((term.lower(), int(weight)) for term, weight in rows)


#: The vocabulary that comes with this package, which any other may replace.
VOCABULARY = read_vocabulary(files(__package__).joinpath("vocabulary/urls.tsv").read_text("utf-8"))
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"


class Judge:
    def __init__(self, rules: Sequence[tuple[str, str, str]], vocabulary: Sequence[tuple[str, int]] = VOCABULARY, strict: int = STRICT_WEIGHT):
        self.strict = strict
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.terms = ahocorasick.Automaton()
        for term, weight in vocabulary:
            self.terms.add_word(term, (term, weight))
        self.any = bool(vocabulary)
        self.terms.make_automaton()

    @staticmethod
    def split(url: str) -> tuple[str, str]:
        _, found, rest = url.partition("://")
        if not found:
            return "", ""
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        path = rest[end:]
        stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
        return rest[:end].translate(_AZ), path[:stop]

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict; block goes before allow among equals."""
        best, at = None, 0
        while host and at >= 0:
            suffix = host[at:]
            for start, verdict in self.rules.get(suffix, ()):
                key = (len(suffix) + len(start), verdict == "block")
                if path.startswith(start) and (best is None or key > best[0]):
                    best = key, suffix + start, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best and best[1:]

    def hits(self, url: str) -> tuple[int, dict[str, int]]:
        """Strict terms' places, and distinct soft terms with their weights."""
        text, strict, soft = url.translate(_AZ), 0, {}
        if not self.any:
            return 0, {}
        for end, (term, weight) in self.terms.iter(text):
            start = end + 1 - len(term)
            if (start and text[start - 1] in _WORD) or (end + 1 < len(text) and text[end + 1] in _WORD):
                continue
            if weight >= self.strict:
                strict += 1
            else:
                soft[term] = weight
        return strict, soft

    def __call__(self, url: str | None) -> tuple:
        host, path = self.split(url or "")
        strict, soft = self.hits(url or "")
        rule, weight = self.rule(host, path), sum(soft.values())
        verdict = rule[1] if rule else "block" if strict or weight >= self.strict else "allow"
        return host, path, rule and rule[0], verdict, strict, len(soft), weight


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, vocabulary=VOCABULARY, strict: int = STRICT_WEIGHT) -> DataFrame:
    """pages with the columns of SCHEMA, which replace columns of those names. vocabulary: (term in lower case, weight);
    terms of weight `strict` and over are strict, the others soft.

    A null url, or one without `://`, has an empty host and path, which no rule fits; the vocabulary judges the whole
    url, however long, and null has no terms. Of two rules that are equally long, block goes first. Each row is judged
    by itself, so repeated rows, null ids and empty tables need no care.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rules, vocabulary = tuple(rules), tuple(vocabulary)

    @F.pandas_udf(SCHEMA)
    def judged(urls: pd.Series) -> pd.DataFrame:
        judge = once(("urls", rules, vocabulary, strict), lambda: Judge(rules, vocabulary, strict))
        return pd.DataFrame([judge(u) for u in urls], columns=names)

    own = "__lf_judged"
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    return pages.withColumn(own, judged(F.col(url_col))).select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_sql() -> str:
    """The same in DuckDB, term by term with regular expressions."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    strict = [t for t, w in VOCABULARY if w >= STRICT_WEIGHT]
    soft = [(t, w) for t, w in VOCABULARY if w < STRICT_WEIGHT]
    count = " + ".join(f"len(regexp_extract_all(regexp_replace(low, '[^a-z0-9-]', '  ', 'g'), '{word.format(t)}'))" for t in strict)
    hits = " + ".join(f"regexp_matches(low, '{word.format(t)}')::int" for t, _ in soft)
    weight = " + ".join(f"{w} * regexp_matches(low, '{word.format(t)}')::int" for t, w in soft)
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")))
    blocked = ", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")
    return f"""
        WITH a AS (SELECT page_id, coalesce({lower.format('url')}, '') AS low, coalesce(url, '') AS url,
                          CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
             b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
             c AS (SELECT *, {lower.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
             d AS (SELECT *, CASE {fits} END AS rule, ({count})::bigint AS strict_hits, ({hits})::bigint AS soft_hits, ({weight})::bigint AS soft_weight FROM c)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN strict_hits > 0 OR soft_weight >= {STRICT_WEIGHT} THEN 'block' ELSE 'allow' END AS verdict,
               strict_hits, soft_hits, soft_weight
        FROM d"""
