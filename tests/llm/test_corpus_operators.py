"""Spelling variants, language identification and token alignment against brute force, SQL and libraries, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logforge.llm import language_id, spelling, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k + (len(a) == len(b)) :] == long[k + 1 :]


def _spellings(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if _one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def _letters(rng, k):
    return "".join(rng.choice("abcdeéÿ×") for _ in range(k))


def test_spellings_are_those_of_brute_force_and_sql(spark):
    rng = random.Random(3)
    stems = [_letters(rng, rng.randint(4, 9)) for _ in range(60)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + int(60 * rng.random() ** 2)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", w[at] + "b"]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, "".join(w + rng.choice([" ", ", ", "7", "\n", "ā"]) for w in words)))
    long = "q" * 30_000
    docs += [(500 + k, f"{long} {long[:-1]}x {long}x") for k in range(3)] + [(600, None), (601, ""), (602, "ab abc 123")]
    # a chain of forms: each has twice the occurrences of the one before
    docs.append((700, " ".join(w for k, w in enumerate(["zzzzaaaa", "zzzzaaab", "zzzzaabb", "zzzzabbb", "zzzzbbbb"]) for _ in range(3 * 2**k))))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    out = spelling.group_spellings(spelling.words(df))
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out.collect())
    assert got == _spellings(docs)
    assert any(r[1] and r[2] != r[1] for r in got) and sum(len(r[0]) >= 30_000 - 1 for r in got) >= 1
    small = [d for d in docs if d[0] < 500 or d[0] >= 600]
    documents = pd.DataFrame(small, columns=["doc_id", "text"])  # noqa: F841
    want = sorted((r[0], r[1] or "", r[2], r[3], r[4], r[5] or 0) for r in duckdb.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.op11_sql()})").fetchall())
    assert want == _spellings(small)


def test_spellings_of_odd_tables(spark):
    rows = [(1, "hello hello hello hallo"), (1, "hello hello hello hallo"), (None, "hallo hellos"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.word, r.form, r.n, r.n_near) for r in spelling.group_spellings(spelling.words(df, slips=None)).collect())
    assert got == [("hallo", "hello", 3, 1), ("hello", None, 6, 1)]
    empty = spelling.group_spellings(spelling.words(df.limit(0)))
    assert empty.count() == 0 and dict(empty.dtypes)["form_n"] == "bigint"
    assert sorted((r.word, r.n) for r in spelling.group_spellings(spelling.words(df)).collect()) == [(w, n) for w, _, _, n, _, _ in _spellings(rows)]
    with pytest.raises(ValueError):
        spelling.group_spellings(spelling.words(df), ratio=1)
    # many words of one root, which joins are to deal out
    hub = [("centre", 5_000)] + [(f"centre{c}", 100) for c in "abcdefghijklmnopqrstuvwxyz"] + [(f"centre{c}{d}", 3) for c in "abcdefghij" for d in "klmnopqrst"]
    words = spark.createDataFrame(hub, "word string, n int").select(F.explode(F.array_repeat("word", F.col("n"))).alias("word"))
    roots = spelling.group_spellings(words).collect()
    assert len(roots) == 127 and {r.root for r in roots} == {"centre"}


def test_deletion_keys():
    rng = random.Random(4)
    for _ in range(300):
        w = _letters(rng, rng.randint(1, 12))
        strings = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        keys = spelling.deletion_keys(w)
        assert len(keys) == len(strings) and set(keys) == {k for s in strings for k in [spelling.deletion_keys(s)] for k in k} & set(keys)
        shorter = w[1:]
        if shorter:
            assert len(set(keys) & set(spelling.deletion_keys(shorter))) >= 1


VOWELS = {"xx": "aeiou", "yy": "äöüaei", "zz": "ñáéíoa"}


def _speech(rng, lang, n):
    own = {"xx": "thsrn", "yy": "chknd", "zz": "lrsdc"}[lang]
    return " ".join("".join(rng.choice(own) + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    return [(i, _speech(rng, lang, rng.randint(3, 60)), lang) for i in range(400) for lang in [rng.choice(list(VOWELS))]]


def test_languages_held_out(spark, spoken):
    rng = random.Random(6)
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !! \n", None), (None, _speech(rng, "yy", 30), "yy"), (1003, "дом и лес стоят у реки где поле", None), (1003, spoken[0][1], None),
           (1004, _speech(rng, "zz", 30) * 9_000, "zz")]
    df = spark.createDataFrame([(*d, "old") for d in spoken + odd], "doc_id long, text string, lang string, score string")
    learned = df.where(F.col("doc_id").isNotNull() & ~language_id.held_out_ids("doc_id"))
    model = language_id.fit(learned.select("text", F.col("lang").alias("language")), rounds=3)
    assert sorted(set(model.owners)) == ["xx", "yy", "zz"] and len(model.owners) == 12
    rows = language_id.identify(df.withColumn("language", F.lit(1)), model).collect()
    assert len(rows) == len(spoken) + len(odd)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and sum(r.language.nearest == r.lang for r in held) >= len(held) - 1
    by_id = {r.doc_id: r.language for r in rows}
    for i in (1000, 1001, 1002):
        assert tuple(by_id[i]) == ("und", "und", 0.0, 0.0, True)
    foreign = next(r.language for r in rows if r.doc_id == 1003 and "дом" in r.text)
    assert foreign.rejected and foreign.lang == "und" and foreign.nearest in VOWELS
    assert by_id[None].lang == "yy" and by_id[1004].nearest == "zz"
    assert all(0 <= r.language.score <= 1 for r in rows)
    # no rows to learn from, none to judge
    none = language_id.fit(learned.limit(0).select("text", F.col("lang").alias("language")))
    assert {r.language.nearest for r in language_id.identify(df.limit(3), none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def _dense(texts, width):
    """Counts by a plain loop over words."""
    out = np.zeros((len(texts), width), int)
    for i, text in enumerate(texts):
        low, word, words = text.lower(), "", []
        for c in low + " ":
            if c.isalpha():
                word += c
            elif word:
                words.append(word)
                word = ""
        line = [0] + [x for w in words for x in [*map(ord, w), 0]]
        for n in (1, 2, 3):
            for at in range(len(line) - n + 1):
                part = line[at : at + n]
                if part == [0]:
                    continue
                h = 0
                for k, c in enumerate(part, 1):
                    h = (h + c + k) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                out[i, h % width] += 1
    return out


def test_languages_are_those_of_a_dense_twin(spark, spoken, monkeypatch):
    """Counts, document frequencies, clustering and the nearest centroid, all by plain numpy."""
    width, texts, langs = 512, [t for _, t, _ in spoken[:150]], np.array([x for *_, x in spoken[:150]])
    counts = _dense(texts, width)
    assert (np.stack([language_id.grams(t, width) for t in texts]) == counts).all()
    monkeypatch.setattr(language_id, "_SLICE", 20)  # parts cut at spaces count nearly all of it
    part = language_id.grams(texts[0], width)
    monkeypatch.undo()
    assert abs(part.sum() - counts[0].sum()) < 0.25 * counts[0].sum()
    df = spark.createDataFrame([(t, x) for t, x in zip(texts, langs.tolist())] * 2, "text string, language string").repartition(5)
    model = language_id.fit(df, centroids=2, rounds=4, width=width)
    idf = np.log((1 + 300) / (1 + 2 * (counts > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf)
    x = np.log1p(counts) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    drawn = language_id._drawn(df, 1000).collect()
    assert sorted(r.text for r in drawn) == sorted(set(texts))
    order = {(r.language, r.rank): texts.index(r.text) for r in drawn}
    centroids, owners = [], []
    for lang in sorted(VOWELS):
        own = np.flatnonzero(langs == lang)
        c = x[[order[lang, 1], order[lang, 2]]]
        for _ in range(4):
            near = (x[own] @ c.T).argmax(axis=1)
            c = np.stack([x[own][near == k].sum(axis=0) for k in range(2)])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        far = 1 - (x[own] @ c.T).max(axis=1)
        assert np.allclose(model.radii[[k for k, o in enumerate(model.owners) if o == lang]], far.mean() + language_id.DEVIATIONS * far.std(), atol=1e-4)
        centroids += list(c)
        owners += [lang] * 2
    assert model.owners == owners and np.allclose(model.centroids, centroids, atol=1e-4)
    best = (x @ np.array(centroids).T)
    got = model.predict(texts)
    assert [g[0] for g in got] == [owners[k] for k in best.argmax(axis=1)] and np.allclose([g[1] for g in got], best.max(axis=1), atol=1e-4)


def test_languages_draw_distinct_texts(spark):
    """A text that is most rows of a language is drawn once, and no more than asked for of any language."""
    rows = [("same text", "xx")] * 3000 + [(f"text {k}", "xx") for k in range(500)] + [(f"other {k}", "yy") for k in range(7)]
    drawn = language_id._drawn(spark.createDataFrame(rows, "text string, language string"), 100).collect()
    n = collections.Counter(r.language for r in drawn)
    assert n == {"xx": 100, "yy": 7} and len({r.text for r in drawn}) == 107


ODD = [None, "", " ", "  ", "\n", "a ", "a  ", "a \n", " \n b", "a\n\n", "a\n  b", "a  b", "  a", "a▁b", "good words a▁b and more", "x<|endoftext|> y <s> </s> <unk> <0x41>", "日本語 漢字", "🙂🙂 a🙂b",
       "\x00\x01 \x85 x", "a b 　 c", "ab" * 5000, " " * 500, "tab\tx \t y", "\r\n a;\r b", "é à ﬁ ①", "word of words " * 5000]


def _aligned(docs):
    """Alignment by a plain walk over both lists of ends, from the libraries' own tokens."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    name = {i: t for t, i in a.get_vocab().items()}
    rows, counts = [], collections.Counter()
    for i, text in docs:
        groups, links, ia, ib = [], [], [], []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            wa = [bytes(letters[c] for c in name[k]) for k in ia]
            wb = [token_alignment.piece_bytes(b.id_to_piece(k)) for k in ib]
            if not b"".join(wa) == b"".join(wb) == (" " + text).encode():
                ia, ib = [], []
        x = y = at_a = at_b = low_a = low_b = 0
        while x < len(ia):
            at_a, x = at_a + len(wa[x]), x + 1
            while y < len(ib) and at_b < at_a:
                at_b, y = at_b + len(wb[y]), y + 1
            if at_a == at_b:
                groups.append(",".join(map(str, ia[low_a:x])) + "|" + ",".join(map(str, ib[low_b:y])))
                links.append((ia[x - 1], ib[y - 1]))
                low_a, low_b = x, y
        counts.update(links)
        rows.append((i, len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""))
    most = collections.Counter()
    for (p, q), n in counts.items():
        most[q] = max(most[q], n)
    return sorted((-1 if i is None else i, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, na, nb, g, links, sha in rows)


def test_alignment_is_the_libraries(spark):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("abc  \n\té🙂.,'▁" if k % 3 == 0 else "abcdefgh   \n.,'s\té🙂") for _ in range(rng.randint(0, 80))) for k in range(400)]
    texts += [" ".join(rng.choice(["the", "of", "And", "hither,", "éclair"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(7, "a b"), (7, "a b"), (None, "the of and")]
    df = spark.createDataFrame([(*d, "old", 3) for d in docs], "doc_id long, text string, n_a string, k int")
    want = _aligned(docs)
    for most_hot in (token_alignment.MOST_HOT, 5, 200):  # all pairs hot, most rare, some of either
        out = token_alignment.align_tokens(df, A_PATH, B_PATH, most_hot=most_hot)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())
        assert got == want
    assert sum(w[1] > 0 for w in want) > 250 and sum(w[5] < w[4] for w in want) > 20
    assert all(t == "bigint" for c, t in out.dtypes if c != "groups_sha256")
    assert token_alignment.align_tokens(df.limit(0), A_PATH, B_PATH).count() == 0


def test_alignment_in_parts():
    pair = token_alignment.Pair(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    assert pair.cuts
    plain = lambda found: [(*f[:4], *(x.tolist() for x in f[4:])) for f in found]
    whole = plain(token_alignment.align_batch(pair, ODD))
    assert plain(token_alignment.align_batch(pair, ODD, most=30)) == whole
    pair.cuts = False  # without the proof nothing is cut, and the result is the same
    assert plain(token_alignment.align_batch(pair, ODD)) == whole
