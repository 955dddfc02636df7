"""Token counts, byte-level BPE, URL filters, license scans and decontamination against libraries and brute force."""

import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logforge.llm import byte_bpe, decontaminate, license_scan, token_counts, url_filter

ODD = [None, "", " ", "\n\n", "áb ñ Σ ΑΣ İstanbul ǅ", "<|endoftext|>Hi <|startoftext|> x<|endoftext|><|endoftext|>", "日本語 漢字", "it's we'll I'M 'S",
       "½ ② x y", "🙂🙂 a🙂b", "a" * 3000, "\x00\x01 \x85 x", "ﬁ K Å é", "٣٤ 𝔘𝔫𝔦", "ab" * 2000, " " * 2000, "word " * 3000]


def _random(n, seed=1):
    rng = random.Random(seed)
    alphabet = "abcdefghij ,.XYZ01é日🙂\n '"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(n)]


#: Hundreds of thousands of characters: of many words, and of few places where a text may be cut.
LONG = [" ".join(f"w{k % 997}é it's\n" for k in range(60_000)), "x" * 200_000 + " " * 200_000, "<|endoftext|>" * 20_000]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def _without_ids(spark, texts):
    return _docs(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))


def test_token_counts_are_the_librarys(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = ODD + _random(100) + ["x"] * 3
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(_docs(spark, texts), path).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    rows = token_counts.count_tokens(_without_ids(spark, LONG + ["a b"]), path).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, len(lib.encode(t, add_special_tokens=False).ids)) for t in LONG + ["a b"]]


def test_whole_tokens_are_proved():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, table = Tokenizer.from_file(path), token_counts.prove(path)
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)["pre_tokenizer"]["pretokenizers"]
    assert [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"] == [token_counts.SPLIT]
    assert len(table.plain) > 500
    for word in random.Random(2).sample(sorted(table.whole), 500):
        assert len(lib.encode(word, add_special_tokens=False).ids) == 1


def test_token_counts_of_an_empty_table(spark):
    out = token_counts.count_tokens(_docs(spark, []), public_tokenizers.path("word_bpe_49k.json"))
    assert out.count() == 0 and dict(out.dtypes)["n_tokens"] == "bigint"


def test_bpe_is_tiktokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + _random(200, 3)
    rows = byte_bpe.encode_checked(_docs(spark, texts), path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    rows = byte_bpe.encode_checked(_without_ids(spark, LONG + ["a b"]), path, public_tokenizers.PATTERN).collect()
    assert [(r.doc_id, r.ids) for r in rows] == [(None, lib.encode_ordinary(t)) for t in LONG + ["a b"]]
    # other columns keep their types, and slices of a batch their order
    odd = _docs(spark, ["a b"] * 1000).selectExpr("doc_id", "text", "timestamp'2024-01-02 03:04:05' as t", "array(named_struct('x', doc_id)) as s", "cast(null as decimal(5,2)) as d", "'old' as ids")
    out = byte_bpe.encode(odd, path, public_tokenizers.PATTERN)
    assert dict(out.drop("ids", "decoded").dtypes) == dict(odd.drop("ids").dtypes) and out.where("s[0].x = doc_id and d is null and size(ids) = 2").count() == 1000
    assert byte_bpe.encode_digests(odd.limit(0), path, public_tokenizers.PATTERN, keep=["doc_id"]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    decoded = byte_bpe.encode(_docs(spark, texts), path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in decoded)


def test_every_token_encodes_as_itself():
    ranks = byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    codec = byte_bpe.Codec(ranks)
    assert all(codec.encode_piece(t) == [r] for t, r in ranks.items())
    assert not [r for t, r in ranks.items() if len(t) > 1 and codec.halves[r] == (r, r)]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Net/x?y", "a.net", "/x", "net/", "block"),
    ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://www.example.net/en", "www.example.net", "/en", "net/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("https://m.example.com/de/casino", "m.example.com", "/de/casino", "example.com/de/", "block"),
    ("https://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
    ("https://x.com/casino-win", "x.com", "/casino-win", None, "block"),
    ("https://x.com/casinox", "x.com", "/casinox", None, "allow"), ("https://x.com/best-shop", "x.com", "/best-shop", None, "allow"),
    ("https://x.com/best-shop/now?vip=1", "x.com", "/best-shop/now", None, "block"), ("https://x.com/" + "a/" * 200_000 + "poker?x=win", "x.com", "/" + "a/" * 200_000 + "poker", None, "block"),
    ("https://x.com/cheap-cheap", "x.com", "/cheap-cheap", None, "allow"),
    ("https://x.com/cheap_PILLS#a", "x.com", "/cheap_PILLS", None, "block"),
    ("http://a.net", "a.net", "", None, "allow"), ("http://a.net?x=://b", "a.net", "", None, "allow"),
    ("a.net/x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
])
def test_urls(url, host, path, rule, verdict):
    got = url_filter.Judge(url_filter.RULES)(url)
    assert got[:4] == (host, path, rule, verdict)


def test_url_columns_replace_clashing_ones(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "old"), (1, None, "old")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(pages).orderBy(F.col("url").isNull()).collect()
    assert [r.host for r in rows] == ["a.net", ""] and [r.verdict for r in rows] == ["block", "allow"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    own = url_filter.read_vocabulary("# version: 7\nZebra\t1\ngnu\t1\n")
    judge = lambda url: url_filter.Judge((), own, 2)(url)[3]
    assert [judge(f"http://a.com/{p}") for p in ("zebra", "zebra-zebra", "zebra/gnu", "zebras/gnu")] == ["allow", "allow", "block", "allow"]
    again = url_filter.judge_urls(pages.union(pages).withColumn("soft_weight", F.lit("x")))
    assert sorted(r.host for r in again.collect()) == ["", "", "a.net", "a.net"]


def _license_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_places(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["mit ", "license ", "MIT-License,", "apache\n", "general public ", "é ", "license-mit ", "x"]) for _ in range(40)) for _ in range(60)]
    for r in license_scan.scan_licenses(_docs(spark, texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _license_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def _notice(text):
    """A notice's characters, and whether each may have errors."""
    out, loose = [], True
    for c in text:
        if c in "[]":
            loose = c == "]"
        else:
            out.append((c, loose))
    chars = [c for c, _ in out]
    # spaces beside words that allow no errors allow none either
    loose = [x and not (c == " " and ((k and not out[k - 1][1]) or (k + 1 < len(out) and not out[k + 1][1]))) for k, (c, x) in enumerate(out)]
    return chars, loose


def _notice_edits(chars, loose, text):
    """The fewest errors of the notice in any part of the text from word to word."""
    n, never = len(chars), 99
    extra = lambda i: (i > 0 and loose[i - 1]) or (i < n and loose[i])
    row = [0 if j == 0 or text[j - 1] == " " else never for j in range(len(text) + 1)]
    if extra(0):
        for j in range(1, len(text) + 1):
            row[j] = min(row[j], row[j - 1] + 1)
    for i in range(1, n + 1):
        new = [row[0] + 1 if loose[i - 1] else never]
        for j in range(1, len(text) + 1):
            same = chars[i - 1] == text[j - 1]
            cost = row[j - 1] if same else row[j - 1] + 1 if loose[i - 1] else never
            if loose[i - 1]:
                cost = min(cost, row[j] + 1)
            if extra(i):
                cost = min(cost, new[j - 1] + 1)
            new.append(cost)
        row = new
    return min((c for j, c in enumerate(row) if j == len(text) or text[j] == " "), default=never)


def test_license_notices_are_those_of_brute_force():
    rng = random.Random(6)
    notices = [(*_notice(n), label, k) for n, label, k in license_scan.NOTICES]
    scan = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    texts = ["licensed under cc by nd 4 0", "licensed under cc by nc nd 4 0", "small rights reserved", "ball rights reserved", "all rights reserve", "a ll rights reserved",
             "released under the mpl license", "released under the smit license", "released under the isc license", "nothing to see", "reserved",
             "released under the mit licensexyzabc", "all rights reservedabc", "all rights reservedabc all rights reserved", "released under the mit licens e"]
    for chars, loose, _, k in notices * 14:
        spoilt = list(chars)
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randrange(len(spoilt))
            spoilt[at : at + 1] = rng.choice([[], ["q"], [spoilt[at], "z"], [" "]])
        texts.append(" ".join((rng.choice(["", "zz", "x the"]) + " " + "".join(spoilt) + rng.choice(["", "s", " y", "xyzabcdefgh", "xyz abc", "x" * 40 + " all"])).split()))
    right = wrong = 0
    for text in texts:
        found = {label for label, *_ in scan(text)[7]}
        want = {label for chars, loose, label, k in notices if _notice_edits(chars, loose, text) <= k}
        assert found == want, (text, found, want)
        for _, start, end, _ in scan(text)[7]:  # from the beginning of a word to the end of one
            assert (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ") and text[start] != " " != text[end - 1], (text, start, end)
        right, wrong = right + bool(want), wrong + (not want)
    assert right > 60 and wrong > 20
    assert scan("licensed under CC BY-ND 4.0")[5] == "cc-by-nd" and scan("small rights reserved")[5] == ""
    assert scan("nothing to see")[5] == "" and scan(None)[0] == 0


def test_license_scan_of_odd_tables(spark):
    """Null, empty and very long texts, repeated rows, an empty table, and columns that clash with those of the result."""
    long = "word " * 200_000 + "Licensed under the Apache License, Version 2.0. " + "licensed under the " * 20_000
    rows = [(1, None, "old"), (1, None, "old"), (2, "", "old"), (None, "MIT License", "old"), (3, long, "old"), (3, long, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").withColumns({"spans": F.lit(1), "score": F.lit("x")})
    got = license_scan.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in got) == [(0, 2, "mit"), (1, 0, ""), (1, 0, ""), (2, 0, ""), (3, 260_008, "apache"), (3, 260_008, "apache")]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_weaker_notice_before_the_best():
    scan = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    text = "x released undr the mit licence y z released under the mit license w"
    spans = scan(text)[-1]
    assert [e for *_, e in spans] == [2, 0], spans
    assert spans[0][1] < text.index(" y z ") and text[spans[1][1] : spans[1][2]] == "released under the mit license"


def _edits(item, text):
    prev = np.zeros(len(text) + 1, int)
    other = np.array([ord(c) for c in text])
    for i, c in enumerate(item):
        step = np.concatenate(([i + 1], np.minimum(prev[:-1] + (other != ord(c)), prev[1:] + 1)))
        k = np.arange(len(step))
        prev = np.minimum.accumulate(step - k) + k
    return int(prev.min())


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(15, 40))) for i in range(12)] + [(90, None), (91, ""), (None, "some text"), (92, "short")]
    docs = [None, "", "short", prose(2000)]
    for _ in range(40):
        spoilt = list(items[rng.randrange(12)][1])
        for _ in range(rng.randint(0, int(0.11 * len(spoilt)))):
            at = rng.randrange(len(spoilt))
            spoilt[at : at + 1] = rng.choice([[], ["z"], [spoilt[at], "z"]])
        docs.append(prose(rng.randint(0, 60)) + "\n " + "".join(spoilt).upper() + " " + prose(rng.randint(0, 60)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(_docs(spark, docs).withColumn("leaks", F.lit(1)), bench).collect()
    for r in rows:
        text = decontaminate.normalise(docs[r.doc_id])
        got = {x.item_id: x for x in r.leaks}
        for i, t in items:
            if not t or i is None:
                assert i not in got
                continue
            item = decontaminate.normalise(t)
            k = min(int(decontaminate.EDIT_SHARE * len(item) + 1e-9), (len(item) - decontaminate.Q) // decontaminate.Q) if len(item) >= decontaminate.Q else 0
            cost = _edits(item, text)
            assert (i in got) == (cost <= k), (i, cost, k)
            if i in got:
                assert got[i].edits == cost and _edits(item, text[got[i].start : got[i].end]) == cost
    # an item at the end of a very long text
    far = decontaminate.find_leaks(_without_ids(spark, [prose(80_000) + " " + items[3][1], prose(80_000)]), bench).collect()
    assert [[(x.item_id, x.edits) for x in r.leaks] for r in far] == [[(3, 0)], []] and all(r.doc_id is None for r in far)
    # slice by slice, with string ids, gives the same; and a worker keeps one slice's searcher only
    small = decontaminate.find_leaks(_docs(spark, docs), bench)
    want = sorted((r.doc_id, sorted((x.item_id, x.edits, x.start, x.end) for x in r.leaks)) for r in small.collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 400)
    sliced = decontaminate.find_leaks(_docs(spark, docs + docs[4:5]), bench.union(bench.limit(2)).withColumn("item_id", F.col("item_id").cast("string")))
    assert "ArrowEvalPython" not in sliced._jdf.queryExecution().executedPlan().toString()
    got = [(r.doc_id, sorted((int(x.item_id), x.edits, x.start, x.end) for x in r.leaks)) for r in sliced.collect()]
    assert sorted(got) == sorted([*want, (len(docs), want[4][1])])
    assert decontaminate.find_leaks(_docs(spark, docs), bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontaminate.find_leaks(_docs(spark, []), bench).count() == 0
