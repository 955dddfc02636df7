"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A hash rolls over the line hashes of a document, two neighbouring lines at a time (those that are not blank, with the
blank ones between them). It chooses the boundaries, from nearby lines and their windows alone, so text put in or taken
out elsewhere shifts none:

* where a window recurs less often in the corpus than one beside it: there a passage that many documents share begins
  or ends, and whole short passages become chunks;
* inside a passage, where the hash is the least of its neighbours': there long shared passages are cut alike, whatever
  each document has around them.

Chunks are disjoint. A chunk of two lines or more that occurs again is removed but for its first occurrence, which stays
whole: nothing that is removed is lost. Chunks are found equal by a hash, and their bytes are compared before any goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logforge.llm.common import hot_keys, materialise, read_table, spread_join

#: A boundary inside a passage is the least hash among so many windows on either side, so chunks there have over REACH lines.
REACH = 3
#: What a line has that is not blank, in Spark's and SQL engines' expressions alike.
_MARK = r"[^\x09-\x0D\x20]"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column) -> Column:
    """array<struct<k, first_line, last_line, h>>: the k-th two neighbouring lines that are not blank, and the first 60
    bits of the MD5 of the line hashes from the one to the other, which SQL engines agree on."""

    def windows(hashes: Column) -> Column:
        def one(full: Column) -> Column:
            def window(i: Column, k: Column) -> Column:
                last = F.get(full, k + 1)
                rolled = F.md5(F.array_join(F.slice(hashes, i + 1, last - i + 1), ""))
                return F.struct(k.alias("k"), i.alias("first_line"), last.alias("last_line"), F.conv(F.substring(rolled, 1, 15), 16, 10).cast("long").alias("h"))

            return F.transform(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), window)

        return _let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_MARK)), one)

    return _let(F.transform(lines, F.md5), windows)


def _hash(*window: Column) -> Column:
    """What a chunk's hash is summed up from, for each window and its place in the chunk; a collision costs a comparison of
    bytes, no more."""
    return F.xxhash64(*window)


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first_line"] + 1, chunk["last_line"] - chunk["first_line"] + 1), "\n")


def _chunks(base: DataFrame, ident: Column, text: Column, reach: int) -> DataFrame:
    """(doc, first_line, last_line, key) of all chunks of two lines or more that may occur again."""
    found = materialise(  # three numbers and a hash for each line
        base.where(text.isNotNull()).select(ident.alias("doc"), F.explode(_let(_split(text), _windows)).alias("w")).select("doc", "w.*"))
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a very common window's places are dealt over many tasks; rows that agree in id and text are one document
    met = spread_join(found, counts, ["h"], hot_keys(counts, ["h"], found.count()), ["doc", "k"]).dropDuplicates(["doc", "k"])

    place = Window.partitionBy("doc").orderBy("k")
    beside = lambda c, step: F.when(F.lag("k", step).over(place) == F.col("k") - step, F.lag(c, step).over(place))
    rarer = (F.col("n") < F.coalesce(beside("n", 1), F.lit(0))) | (F.col("n") < F.coalesce(beside("n", -1), F.lit(0)))
    met = met.select("*", rarer.alias("rarer"))
    # whether all windows up to so many steps away are of one passage with this one, and have higher hashes
    least = ~F.col("rarer")
    for step in [s for s in range(-reach, reach + 1) if s]:
        least = least & F.coalesce((beside("n", step) == F.col("n")) & ~beside("rarer", step) & (beside("h", step) > F.col("h")), F.lit(False))
    met = met.select("doc", "k", "first_line", "last_line", "h", (F.col("rarer") | least).alias("cut"))
    # a chunk is a run of windows that follow each other and are no cuts
    runs = met.where(~F.col("cut")).withColumn("run", F.col("k") - F.row_number().over(place))
    inside = Window.partitionBy("doc", "run").orderBy("k")
    runs = runs.withColumn("at", F.row_number().over(inside))
    return runs.groupBy("doc", "run").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.bit_xor(_hash(F.col("h"), F.col("at"))).alias("key")).drop("run")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """docs with the repeated chunks of two lines or more cut from the text, and n_lines and n_removed (long): the lines of
    the text as it was, and those removed. They replace columns of those names. Lines end at a line feed; a line of
    nothing but spaces, tabs, carriage returns and the like is blank.

    The occurrence of the smallest (id, place) stays, whole; a null id comes last. Chunks don't overlap, so a chunk that
    is removed still stands where it occurs first. Rows that agree in id and text are one document: they keep and lose
    the same lines. A null text stays null with 0 lines; an empty text has one (empty) line. Single lines and blank ones
    are never removed by themselves; those between two lines of a chunk go with it. An empty table gives an empty table.

    reach: on how many windows on either side a boundary inside a shared passage depends.
    """
    names = {"n_lines", "n_removed"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    text = F.col(f"`{text_col}`")
    ident = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"))
    base = base.withColumn("__lf_doc", ident)
    chunks = materialise(_chunks(base, F.col("__lf_doc"), text, reach))
    where = F.struct("doc", "first_line", "last_line")
    first = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first")).where("n > 1")
    # a very common chunk's places are dealt over many tasks, as are the rows of a document that is there many times
    again = spread_join(chunks, first.drop("n"), ["key"], hot_keys(first, ["key"], chunks.count()), ["doc", "first_line"])
    asked = again.groupBy(F.col("doc").alias("__lf_doc")).agg(F.collect_list(F.struct("first_line", "last_line", (where == F.col("first")).alias("stays"), "key")).alias("__lf_asked"))
    sizes = base.groupBy("__lf_doc").agg(F.count(F.lit(1)).alias("n"))
    met = spread_join(base.withColumn("__lf_row", F.monotonically_increasing_id()), asked, ["__lf_doc"], hot_keys(sizes, ["__lf_doc"], base.count()), ["__lf_row"], "left")
    met = materialise(met.drop("__lf_row"))  # one shuffle of the texts: each document meets the list of its chunks that occur again

    # byte comparison: of chunks with one hash, those of other bytes than the first have a first occurrence of their own
    def asked_bytes(lines: Column) -> Column:
        return F.transform("__lf_asked", lambda a: F.struct(
            a["first_line"].alias("first_line"), a["last_line"].alias("last_line"), a["stays"].alias("stays"), a["key"].alias("key"), _chunk_text(lines, a).alias("bytes")))

    cut = (
        met.where(F.col("__lf_asked").isNotNull())
        .select(F.col("__lf_doc").alias("doc"), F.explode(_let(_split(text), asked_bytes)).alias("ask"))
        .select("doc", "ask.*")
    )
    other = cut.groupBy("key", "bytes").agg(F.min(where).alias("own"), F.max("stays").alias("has_first")).where(~F.col("has_first"))
    spared = materialise(other.groupBy(F.col("own.doc").alias("__lf_doc")).agg(F.collect_set("own.first_line").alias("__lf_spared")))

    # collisions are rare: elsewhere nothing is spared
    none = F.array().cast("array<int>")
    gone = F.filter("__lf_asked", lambda a: ~a["stays"] & ~F.array_contains(F.coalesce("__lf_spared", none), a["first_line"]))

    def left(lines: Column) -> Column:
        numbers = F.flatten(F.transform("__lf_gone", lambda c: F.sequence(c["first_line"], c["last_line"])))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
        return F.transform(kept, lambda i: F.get(lines, i))

    out = (
        met.join(spared, "__lf_doc", "left")
        .withColumn("__lf_gone", F.when(F.col("__lf_asked").isNotNull(), gone))
        .withColumn("__lf_left", F.when(F.size("__lf_gone") > 0, _let(_split(text), left)))
        .withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(_split(text))).cast("long"))
        .withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size("__lf_left"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__lf_left").isNotNull(), F.array_join("__lf_left", "\n")).otherwise(text))
    )
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c != "__lf_doc"], "n_lines", "n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op6_sql(source: str = "documents", columns: str = "doc_id, text, n_lines, n_removed", reach: int = REACH) -> str:
    """The same in DuckDB, for unique ids."""
    steps = [s for s in range(-reach, reach + 1) if s]
    beside = "\n".join(
        f"            AND coalesce(lead(n, {s}) OVER w = n AND NOT lead(rarer, {s}) OVER w AND lead(h, {s}) OVER w > h, false)" if s > 0 else
        f"            AND coalesce(lag(n, {-s}) OVER w = n AND NOT lag(rarer, {-s}) OVER w AND lag(h, {-s}) OVER w > h, false)" for s in steps)
    return f"""
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {source} WHERE text IS NOT NULL),
        lines AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
        spans AS (
            SELECT doc_id, lines, i, lead(i) OVER w AS j, row_number() OVER w AS k
            FROM lines WHERE regexp_matches(line, '{_MARK}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        windows AS (
            SELECT doc_id, i, j, k, ('0x' || substr(md5(array_to_string(list_transform(lines[i : j], lambda x: md5(x)), '')), 1, 15))::bigint AS h
            FROM spans WHERE j IS NOT NULL),
        counted AS (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows),
        judged AS (
            SELECT *, n < coalesce(lag(n) OVER w, 0) OR n < coalesce(lead(n) OVER w, 0) AS rarer
            FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        cuts AS (
            SELECT *, n = 1 OR rarer OR (true
{beside}) AS cut
            FROM judged WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        runs AS (SELECT doc_id, i, j, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM cuts WHERE NOT cut),
        chunks AS (SELECT doc_id, min(i) AS i, max(j) AS j FROM runs GROUP BY doc_id, run),
        firsts AS (
            SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(lines[i : j], chr(10)) ORDER BY doc_id, i) AS place
            FROM chunks JOIN split USING (doc_id)),
        gone AS (SELECT doc_id, unnest(range(i, j + 1)) AS i FROM firsts WHERE place > 1),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (g.i IS NULL) AS left_text, count(*) AS n_lines, count(g.i) AS n_removed
            FROM lines LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT {columns} FROM (
            SELECT d.* EXCLUDE (text), CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_text, '') END AS text,
                   coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
            FROM {source} d LEFT JOIN kept k USING (doc_id))"""
