"""Near-duplicates, line dedup and the learned scores against brute force, and on odd rows."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logforge.llm import common, embedding_dedup, line_dedup, quality, simhash, spelling, toxicity


def _components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(links)
    edges = spark.createDataFrame(links + links[:5] + [(None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    want = _components(links, {x for e in links for x in e if e[0] != e[1]})
    assert got == want
    assert common.connected_components(edges.limit(0)).count() == 0


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for bits in itertools.combinations(range(64), 2):
        assert any(not m & (1 << bits[0] | 1 << bits[1]) for m in masks)
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    rng = random.Random(2)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & apart for m in masks)


def test_simhash_links(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [None, "", " \n", "one", "One", "two words", "x " * 5000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 2
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[9], 1), (3, "one", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    prints = {i: _fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = _components(links, prints)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id == want[9]


def test_large_buckets_in_blocks(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 40)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, block=64)
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    want = _components(links, {x for e in links for x in e})
    assert got == want


def test_simhash_of_odd_tables(spark):
    """An empty table, a very long text, and a large group of copies whose rows are dealt over tasks."""
    rng = random.Random(16)
    long = " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(300_000))
    rows = [(1, long), (2, long), (3, None), (4, "")] + [(10 + i, "the same short text again") for i in range(500)] + [(None, "the same short text again")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is None or r.doc_id >= 10} == {10}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert int(next(r.fingerprint for r in got if r.doc_id == 1), 16) == _fingerprint(long)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df.where("doc_id < 20")).collect()) == [1, 3, 10]


def test_hot_keys_are_spread(spark):
    """A hub of a graph, and a join in which one key has most rows."""
    edges = spark.range(5000).selectExpr("0L as a", "id + 1 as b").union(spark.range(300).selectExpr("10000 + id as a", "10001 + id as b"))
    got = common.connected_components(edges)
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 5001), (10000, 301)]
    rows = spark.range(4000).selectExpr("id", "if(id < 3000, 7, id) as k", "if(id % 50 = 0, null, 'x') as other")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, ["k"], 4000)
    assert [tuple(r) for r in hot.collect()] == [(7, 47)]
    out = common.spread_join(rows, counts, ["k"], hot, ["id"], "left")
    assert out.count() == 4000 and out.where("n <> if(k = 7, 3000, 1)").count() == 0 and set(out.columns) == {"id", "k", "other", "n"}


def _joins(df):
    """Of the joins as planned: broadcast ones, and merged ones."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_what_grows_is_merged(spark):
    """Files that Spark takes for small, of which an explode makes 31 times as many rows: only hot keys are broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    distinct = common.materialise(spark.range(500).select(F.xxhash64("id").alias("fp")))
    assert _joins(simhash.link_fingerprints(distinct)) == (2, 1)
    rows = common.materialise(spark.range(100).selectExpr("id", "id % 7 as k"))
    hot = common.hot_keys(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], 100)
    assert _joins(common.spread_join(rows, rows.selectExpr("id as k", "id as v"), ["k"], hot, ["id"], "left")) == (2, 1)


def test_near_duplicates_stage_is_merged(spark):
    """Two joins with hot keys, both sides of each; the others are merged."""
    docs = common.materialise(spark.range(300).selectExpr("id as doc_id", "concat('some words of text ', id div 2) as text"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert _joins(out)[0] == 4
    assert out.count() == 150


def test_keys_of_words_are_merged(spark):
    counts = common.materialise(spark.createDataFrame([("spelling", 9), ("speling", 4)], "word string, n long"))
    near = spelling.near_words(counts)
    assert _joins(near) == (0, 1)
    assert sorted((r.word, r.near, r.near_n) for r in near.collect()) == [("speling", "spelling", 9), ("spelling", "speling", 4)]


def test_drop_near_duplicates_keeps_one(spark):
    rows = [(1, "a b c d e f", "m"), (2, "a b c d e f", "n"), (3, "something else that is long enough", "o"), (2, "a b c d e f", "n"), (3, "something else that is long enough", "o"), (None, "a b c d e f", "p")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((r.doc_id or 0, r.component_id) for r in out.collect()) == [(0, "p"), (1, "m"), (3, "o")]


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            centre = rng.normal(size=12)
            for _ in range(rng.integers(1, 5)):
                rows.append((len(rows), (centre + rng.normal(scale=rng.choice([0.0, 0.2, 0.35]), size=12)).astype("float32").tolist(), label))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 12, 0), (n + 2, [], 0), (n + 3, [float("nan")] * 12, 0), (n + 4, [float("inf")] + [1.0] * 11, 0), (n + 5, [None] + [1.0] * 11, 1),
             (n + 6, rows[0][1], None), (n + 7, [2 * v for v in rows[0][1]], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, interval=16, leaf=4).collect()}

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not a or any(v is None or not math.isfinite(v) for v in (*a, *b)):
            return -1
        x, y = np.array(a), np.array(b)
        size = np.linalg.norm(x) * np.linalg.norm(y)
        return x @ y / size if size else -1

    clean = [(i, None if v is None else [None if x is None else float(x) for x in v], c) for i, v, c in rows]
    links = [(a[0], b[0]) for a, b in itertools.combinations(clean, 2) if a[2] is not None and a[2] == b[2] and cosine(a[1], b[1]) >= 0.93]
    want = _components(links, range(len(rows)))
    for i in range(len(rows)):
        assert got[i].n_links == sum(i in e for e in links), i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    whole = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()}
    assert whole == got
    # repeated ids: one node of the components, while each row counts its own vector's links
    twice = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 2.0, 0.1], 0), (3, [0.0, 0.0, 1.0], 1), (3, [0.0, 0.0, 1.0], 1), (None, [1.0, 0.0, 0.0], 0)]
    rows = embedding_dedup.near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("embedding is null")).count() == 1


def test_line_dedup_is_sql(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    passage = [f"passage line {k}" for k in range(12)]
    docs = [(i, "\n".join([rng.choice(lines) for _ in range(rng.randint(0, 12))] + (passage if i % 3 == 0 else []) + [rng.choice(lines) for _ in range(rng.randint(0, 5))])) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, docs[3][1]), (104, "one")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_lines int")
    docs += [(105, "same\nsame\nsame\nsame"), (106, "x\nx\ny\ny\nx\nx"), (107, "\n\nx\n\ny\n"), (108, "x\n\ny\n\n\nx\n\ny")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_lines int")
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    for reach in (line_dedup.REACH, 1):
        got = line_dedup.dedup_lines(df, reach=reach).select("doc_id", "text", "n_lines", "n_removed").toPandas().sort_values("doc_id", ignore_index=True)
        want = duckdb.sql(line_dedup.op6_sql(reach=reach)).df().sort_values("doc_id", ignore_index=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
        assert got.n_removed.sum() > 100
    again = line_dedup.dedup_lines(df.union(df.where("doc_id = 3")).unionByName(df.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))))
    rows = again.collect()
    assert len({r.text for r in rows if r.doc_id == 3}) == 1 and len(rows) == len(docs) + 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_keeps_blank_lines(spark):
    """Blank lines of documents that end lines with a carriage return, as of others, stay: the same lines go from both."""
    rng = random.Random(21)
    lines = ["".join(rng.choice("abcdef") for _ in range(12)) for _ in range(40)]
    plain = [(i, "\n".join(x for _ in range(12) for x in (rng.choice(lines), "", " "))) for i in range(12)]
    plain += [(i + 12, t) for i, t in plain[:6]]
    for end in ("\r", "\t", " ", "\x0b", ""):
        docs = [(i, t.replace("\n", end + "\n")) for i, t in plain]
        got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").toPandas()
        documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
        pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), duckdb.sql(line_dedup.op6_sql()).df().sort_values("doc_id", ignore_index=True), check_dtype=False)
        assert got.n_removed.sum() > 60
    heads = [(i, f"head {i}\r\n\r\n\r\n\r\ntail {i}\r") for i in range(6)]
    got = line_dedup.dedup_lines(spark.createDataFrame(heads, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == dict(heads)


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a hash on which most chunks collide, the result is the same."""
    rng = random.Random(22)
    words = [f"{c}{k}" for c in "ab" for k in range(10, 13)]
    docs = [(i, "\n".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(60, "long\n" * 20_000), (61, "long\n" * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup_lines(df).collect()))
    assert sum(r[3] for r in want) > 0
    monkeypatch.setattr(line_dedup, "_hash", lambda h, at: h % 2)
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == want


def test_line_dedup_loses_nothing(spark):
    """Every chunk of every document still stands somewhere, whole, whatever overlaps what."""
    one = lambda rows: {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    chain = [(1, "a\nX\nY\nb"), (2, "c\nX\nY\nZ\nd"), (3, "e\nY\nZ\nf"), (4, "P\nQ"), (5, "P\nQ\nR"), (6, "Q\nR\nS"), (7, "R\nS")]
    left = one(chain).values()
    for pair in ("X\nY", "Y\nZ", "P\nQ", "Q\nR", "R\nS"):
        assert any(pair in t for t in left), pair
    rng = random.Random(30)
    source = [f"line {k}" for k in range(120)]
    docs = []
    for i in range(150):  # overlapping stretches of one source, among lines of their own
        parts = [source[at : at + rng.randint(2, 30)] for at in (rng.randrange(100), rng.randrange(100))]
        docs.append((i, "\n".join([f"own {i}", *parts[0], f"mine {i}", "", *parts[1], f"end {i}"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.dedup_lines(df).collect()
    text, left = dict(docs), [f"\n{r.text}\n" for r in rows]
    ident = F.struct(F.lit(False).alias("no_id"), F.col("doc_id").alias("id"), F.lit(0).alias("hash"))
    chunks = line_dedup._chunks(df, ident, F.col("text"), line_dedup.REACH).collect()
    assert len(chunks) > 300 and sum(r.n_removed for r in rows) > 300
    for c in chunks:
        chunk = "\n".join(text[c.doc.id].split("\n")[c.first_line : c.last_line + 1])
        assert any(f"\n{chunk}\n" in t for t in left), chunk
    taken = {(c.doc.id, i) for c in chunks for i in range(c.first_line, c.last_line + 1)}
    assert len(taken) == sum(c.last_line + 1 - c.first_line for c in chunks)  # chunks are disjoint


def test_line_dedup_takes_whole_runs(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    docs, want = [], {}
    for n in (2, 3, 4, 5):
        for _ in range(20):
            passage = "\n\n".join(prose(60 // n + 1) for _ in range(n))
            for copy in range(2):
                i, before, after = len(docs), prose(12), prose(12)
                docs.append((i, f"{before}\n{passage}\n{after}"))
                want[i] = f"{before}\n{after}" if copy else docs[-1][1]
    odd = {1000: "same\nsame\nsame", 1001: "one\r\n\r\ntwo\r", 1002: "one\r\n\r\nthree\r", 1003: "x\nx\ny\ny\nx\nx", 1004: "single", 1005: "single", 1006: "\n\n"}
    want |= odd | {1003: "x\nx\ny\ny"}
    rows = spark.createDataFrame(docs + list(odd.items()), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, rows, "").collect()}
    whole = sum(got[i] == want[i] for i in want if i < 1000 and i % 2)
    assert whole == 80, whole
    assert got == want



def test_isotonic():
    rng = np.random.default_rng(7)
    y, w = rng.normal(size=60), rng.uniform(1, 3, 60)
    fit = quality.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    best = min(((w * (np.maximum.accumulate(y + s) - s - y) ** 2).sum() for s in np.linspace(-1, 1, 21)))
    assert (w * (fit - y) ** 2).sum() <= best + 1e-9


def test_quality_scores_hold_out(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "of", "house", "river", "and", "walks", "slowly"]) for _ in range(rng.randint(20, 80))).capitalize() + "."
    bad = lambda: "!! ".join(["BUY NOW"] * rng.randint(5, 40))
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, good()), (5, good())]
    labels = [(i, int(i % 4 != 0)) for i in range(400)] + [(900, None), (None, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.score_quality(df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert all(r.score == 0.5 for r in quality.score_quality(df, lab.limit(0)).collect())
    assert quality.score_quality(df.limit(0), lab).count() == 0


def test_quality_is_ridge(spark):
    """Summed normal equations, and those that leave a fold out, against direct solutions; the cosines against the kernel."""
    rng = np.random.default_rng(13)
    n = len(quality.STATISTICS)
    stats = rng.normal(size=(300, n)) * rng.uniform(0.1, 5, n) + rng.normal(size=n)
    y = (stats[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x], int(t)) for i, (x, t) in enumerate(zip(stats, y))], "id long, stats array<double>, y int").repartition(5)
    model = quality.fit(df)
    fold = {r.id: r.f for r in df.select("id", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(quality.FOLDS)).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(300)])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, stats.std(axis=0))
    z = model.map(stats)

    def ridge(use):
        # the penalty as rows of their own
        penalty = np.sqrt(np.r_[1e-9, np.full(z.shape[1] - 1, quality.RIDGE * use.sum())])
        return np.linalg.lstsq(np.vstack([z[use], np.diag(penalty)]), np.r_[y[use], np.zeros(z.shape[1])], rcond=None)[0]

    assert np.allclose(z @ model.weights, z @ ridge(np.ones(300, bool)), atol=1e-5)
    for k, weights in enumerate(model.left_out):
        assert np.allclose(z @ weights, z @ ridge(fold != k), atol=1e-5)
    raw = np.array([z[i] @ model.left_out[fold[i]] for i in range(300)])
    bins = np.floor(np.clip(raw, -1, 2) * quality.BINS)
    means = [(raw[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    steps = quality.isotonic(np.array([m[1] for m in means]), np.array([m[2] for m in means], dtype=float))
    assert np.allclose(model.score(stats), np.clip(np.interp(z @ model.weights, [m[0] for m in means], steps), 0, 1), atol=1e-6)

    wide = quality.Model(np.zeros(n), np.ones(n), 20_000)
    x = rng.normal(size=(20, n))
    waves = wide.map(x)[:, n + 1 :]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * n))
    assert np.abs(waves @ waves.T - kernel).max() < 0.05


def test_learned_scores_of_odd_tables(spark):
    """Very long texts, repeated rows and columns of the results' names, for both learned scores."""
    long = "stupid words and more words " * 40_000
    rows = [(i, f"some words of text number {i} idiot" if i % 3 == 0 else f"some words of text number {i}", "x") for i in range(60)] + [(70, long, "x"), (70, long, "x"), (71, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"toxicity": F.lit(1), "held_out": F.lit("y"), "stats": F.lit(2), "y": F.lit(3)})
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0), "z") for i in range(60)] * 2, "doc_id long, toxic int, quality int, text string")
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 70}) == 1
    got = toxicity.score_toxicity(docs, toxicity.fit_chain(docs, labels))
    assert got.columns == [*[c for c in docs.columns if c != "toxicity"], "toxicity"] or set(got.columns) == set(docs.columns)
    rows_ = got.collect()
    assert len(rows_) == len(rows) and len({tuple(r.toxicity) for r in rows_ if r.doc_id == 70}) == 1
    assert all((r.toxicity.toxic >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in rows_ if r.doc_id < 60)


def test_toxicity_terms_are_those_of_brute_force(spark):
    rng = random.Random(14)
    words = ["apple", "applesauce", "bad", "badly", "house", "houses", "stone"]
    rows = [(i, int(i % 4 == 0), sorted(toxicity.terms(" ".join(rng.choice(words) for _ in range(3)) + (" badly" if i % 4 == 0 and i % 8 else "")))) for i in range(120)]
    got = toxicity.choose_terms(spark.createDataFrame(rows, "id long, y int, terms array<string>"), 10)
    pos, neg = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    want = {}
    for t in {t for *_, own in rows for t in own}:
        table = [[sum(t in own for _, y, own in rows if y == v) for v in (1, 0)]]
        table.append([pos - table[0][0], neg - table[0][1]])
        gain = sum(x * math.log(x * (pos + neg) / (sum(line) * of)) for line in table for x, of in zip(line, (pos, neg)) if x)
        if sum(table[0]) >= 3 and gain >= toxicity.LEAST_GAIN:
            want[t] = gain
    want = dict(sorted(want.items(), key=lambda e: (-round(e[1], 6), e[0]))[:10])
    assert list(got) == list(want) and all(abs(got[t] - want[t]) < 1e-5 for t in want) and "badly" in got


def test_toxicity_chain_is_that_of_a_dense_twin():
    """Later models of the chain see predictions of models that did not see the row: against plain dense numpy."""
    rng = np.random.default_rng(15)
    n, width, folds = 90, 12, 3
    x = rng.random((n, width)) < 0.3
    labels = np.stack([x[:, 0], x[:, 1] | x[:, 0], x[:, 0] | x[:, 2]], axis=1).astype(int)
    labels[::7] ^= 1
    fold = np.arange(n) % folds
    gains = {f"t{k}": float(30 - k) for k in range(width)}
    chain = toxicity.Chain(["a", "b", "toxic"], gains).fit(toxicity._Rows([np.flatnonzero(r) for r in x], width), labels, fold, folds)

    z = x / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
    decay = toxicity.DECAY * np.minimum(10, toxicity.SURE_GAIN / np.array(list(gains.values())))

    def fitted(dense, y, use):
        m, w = np.hstack([z, dense, np.ones((n, 1))]), use / use.sum()
        share = (y * w).sum()
        params = np.r_[np.zeros(width + dense.shape[1]), np.log(share / (1 - share))]
        first, second = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, 201):
            grad = m.T @ ((1 / (1 + np.exp(-(m @ params))) - y) * w)
            grad[:-1] += np.r_[decay, np.full(dense.shape[1], toxicity.DECAY)] * params[:-1]
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            params = params - 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return np.where(x.any(axis=1), 1 / (1 + np.exp(-(m @ params))), share), params

    dense = np.zeros((n, 0))
    for k, model in enumerate(chain.models):
        _, params = fitted(dense, labels[:, k], np.ones(n))
        assert np.allclose(np.r_[model.weights, model.extra, model.bias], params, atol=1e-6)
        own = np.zeros(n)
        for f in range(folds):
            own[fold == f] = fitted(dense, labels[:, k], (fold != f).astype(float))[0][fold == f]
        dense = np.hstack([dense, own[:, None]])


def test_toxicity_chain(spark):
    rng = random.Random(9)
    plain = ["river", "house", "walk", "green", "table", "window", "seven", "paper"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "pathetic", "grumblik" + rng.choice("abc")]))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "idiot scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(900, 1), (None, 1), (300, None)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    got = toxicity.score_toxicity(docs, chain).collect()
    unseen = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    hit = [r.toxicity.toxic >= toxicity.THRESHOLD for r in unseen]
    assert sum(h == (r.doc_id % 5 == 0) for h, r in zip(hit, unseen)) / len(hit) > 0.97
    assert all(0 <= v <= 1 for r in got for v in r.toxicity)
    assert [r.toxicity.toxic < toxicity.THRESHOLD for r in got if r.doc_id in (900, 901)] == [True, True]
    empty = toxicity.fit_chain(docs, labels.limit(0))
    assert all(r.toxicity.toxic < toxicity.THRESHOLD for r in toxicity.score_toxicity(docs, empty).collect())
    assert toxicity.score_toxicity(docs.limit(0), chain).count() == 0
