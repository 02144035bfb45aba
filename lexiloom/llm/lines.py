"""Line dedup by overlapping windows of three lines.

Only lines with a word take part; others stay where they are. Every three
consecutive such lines of a text are a window, so texts with fewer have none
and never change. Of each window's occurrences the first, by document id and
position, stays; the lines of all later ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table, row_key, stage

WIDTH = 3
SALTS = 16
_WORDED = "l rlike '[^ \\\\t-\\\\r]'"
#: The lines with a word, and the hashes of all windows over them: 128 bits each.
_LINES = f"filter(split(text, '\\n'), l -> {_WORDED})"
_HASHED = "transform(ls, l -> struct(xxhash64(l) AS a, xxhash64(1, l) AS b))"
_SPOTS = (
    f"transform(sequence(0, size(hs) - {WIDTH}), i -> struct("
    "xxhash64(hs[i].a, hs[i + 1].a, hs[i + 2].a) AS h, xxhash64(hs[i].b, hs[i + 1].b, hs[i + 2].b) AS g, i AS spot))"
)


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spot, h, g) for each window; ``spot`` counts the lines with a word."""
    lined = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.expr(_LINES).alias("ls")).where(f"size(ls) >= {WIDTH}")
    return lined.selectExpr("doc_id", "key", f"{_HASHED} AS hs").selectExpr("doc_id", "key", f"inline({_SPOTS})")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, spots): the lines with a word that later occurrences cover, for each text that has any."""
    windows = stage(_windows(docs.select("doc_id", "text")))
    place = F.struct("doc_id", "key", "spot")
    firsts = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # One window may be in a third of all texts, so the answer for each is there in several copies.
    spread = firsts.select("h", "g", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = windows.withColumn("salt", F.pmod("key.a", F.lit(SALTS)).cast("int"))
    later = salted.join(spread, ["h", "g", "salt"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("key").agg(F.collect_set("spot").alias("starts"))
    return starts.selectExpr("key", f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {WIDTH - 1})))) AS spots")


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with the lines of later occurrences taken out of ``text``, and, with ``counts``, ``n_lines`` and ``n_removed``.

    Every row and every other column stays, whatever its name; only the two counts replace columns of their names. Null and empty texts stay as they
    are; a text all of whose lines go becomes empty. Rows with equal id and text count as one document;
    null ids come first.
    """
    key, spots, parts, worded, gone = (fresh(docs, name) for name in ("line_key", "line_spots", "line_parts", "lines_worded", "lines_gone"))
    found = repeated_lines(docs).select(F.col("key").alias(key), F.col("spots").alias(spots))
    joined = docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left").withColumn(parts, F.split("text", "\n"))
    joined = joined.withColumn(worded, F.expr(f"filter(transform({parts}, (l, i) -> IF({_WORDED}, i, NULL)), i -> i IS NOT NULL)"))
    marked = joined.withColumn(gone, F.expr(f"transform({spots}, s -> {worded}[s])"))
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({parts}) - 1), {gone}), i -> {parts}[i]), '\n')")
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    if counts:
        marked = marked.withColumns({"n_lines": size(parts), "n_removed": size(gone)})
    return marked.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).drop(key, spots, parts, worded, gone)


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH l AS (
    SELECT doc_id, i, line, count(*) FILTER (WHERE regexp_matches(line, '[^ \t-\r]')) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS spot, regexp_matches(line, '[^ \t-\r]') AS worded
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), w AS (
    SELECT doc_id, spot, line || chr(10) || lead(line, 1) OVER s || chr(10) || lead(line, 2) OVER s AS win FROM l WHERE worded WINDOW s AS (PARTITION BY doc_id ORDER BY i)
), later AS (
    SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY win ORDER BY doc_id, spot) AS nth FROM w WHERE win IS NOT NULL) WHERE nth > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest([spot, spot + 1, spot + 2]) AS spot FROM later
), marked AS (
    SELECT l.*, g.spot IS NOT NULL AS removed FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.spot = g.spot AND l.worded
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE removed) AS BIGINT) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS text
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
