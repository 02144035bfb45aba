"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

Every item gives windows of ``width`` consecutive words; a shorter item is one
window. A document holds a window only if it holds all of the window's
shingles, so the rarest one is the prefix that has to be joined: shingles are
ordered by their count over all documents, ties by their hash. A joined
position fixes where the window would start; bounds on that start and on the
length go before the exact comparison of all words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, plain_columns, read_table, row_key, stage

#: Words that one shingle has, fewer only in items of fewer words.
SHINGLE = 3
#: Up to so many rows (about 500 bytes each) the shingles of the items are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Characters between words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> F.Column:
    """The words of a text; null and empty texts have none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # lower() also changes letters beyond A-Z, so it serves ASCII texts only; translate() is right for all, but slow.
    lowered = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def word_count(text) -> F.Column:
    """The number of words, for which no letter has to be lower-cased."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def _shingle(words: str, at: str, n: int) -> str:
    """SQL for the hash of ``n`` words of array ``words`` from position ``at``, which counts from 0."""
    return f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(n))})"


def _window_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, words, n, at, shingle): each window of each item with all its shingles."""
    starts = f"sequence(0, greatest(size(ws) - {width}, 0))"
    windows = items.select("item_id", words_of("text").alias("ws")).where("size(ws) > 0")
    windows = windows.select("item_id", F.expr(f"explode(transform({starts}, s -> slice(ws, s + 1, {width})))").alias("words"))
    windows = windows.select("item_id", "words", F.size("words").alias("n")).distinct()
    of = lambda n: f"transform(sequence(0, size(words) - {n}), p -> struct(p AS at, {_shingle('words', 'p', n)} AS shingle))"
    parts = F.expr(f"CASE size(words) {' '.join(f'WHEN {n} THEN {of(n)}' for n in range(1, SHINGLE))} ELSE {of(SHINGLE)} END")
    return windows.select("item_id", "words", "n", F.inline(parts))


def _document_shingles(docs: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """Each shingle of each document, as ``pos`` and ``shingle``, for every shingle length that the items have.

    The words are zipped with themselves shifted, so that all of it is generated code.
    """
    longest = max(lengths)
    shifted = ", ".join(["ws", *(f"slice(ws, {k + 1}, size(ws))" for k in range(1, longest))])
    names = [f"w{k}" for k in range(longest)]
    zipped = docs.where(f"size(ws) >= {min(lengths)}").select(*keep, F.posexplode(F.expr(f"arrays_zip({shifted})")).alias("pos", "z"))
    each = zipped.select(*keep, "pos", *[F.col("z").getField(str(k) if k else "ws").alias(n) for k, n in enumerate(names)])
    if len(lengths) == 1:
        return each.where(f"{names[-1]} IS NOT NULL").select(*keep, "pos", F.xxhash64(*names).alias("shingle"))
    hashes = F.array(*[F.when(F.col(names[n - 1]).isNotNull(), F.xxhash64(*names[:n])) for n in lengths])
    return each.select(*keep, "pos", F.explode(hashes).alias("shingle")).where("shingle IS NOT NULL")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def window_matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(key, start, n, item_id): all places where ``docs(key, ws)`` holds a window of ``items(item_id, text)``."""
    parts = stage(_window_shingles(items, width))
    known = parts.select(F.least(F.col("n"), F.lit(SHINGLE)).alias("length"), "shingle").distinct()
    sizes = {r["length"]: r["count"] for r in known.groupBy("length").count().collect()}  # at most SHINGLE rows
    if not sizes:
        return docs.select("key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).where("false")
    lengths, rows = sorted(sizes), sum(sizes.values())
    found = _document_shingles(docs, lengths, []).join(_small(known.select("shingle").distinct(), rows), "shingle")
    counts = stage(found.groupBy("shingle").agg(F.count("*").alias("times")))
    # A window with a shingle that no document has can't occur.
    ordered = parts.join(counts, "shingle", "left").groupBy("item_id", "words", "n").agg(
        F.min(F.struct("times", "shingle", "at")).alias("prefix"), F.count("times").alias("seen"), F.count("*").alias("shingles")
    )
    prefixes = stage(ordered.where("seen = shingles").select("item_id", "words", "n", "prefix.shingle", "prefix.at"))
    kept = prefixes.count()
    if kept <= BROADCAST_ROWS:
        places = _document_shingles(docs, lengths, ["key", "ws"])
        near = places.join(F.broadcast(prefixes), "shingle").where("pos >= at AND pos - at + n <= size(ws)")
        exact = near.where("slice(ws, pos - at + 1, n) = words")
        return exact.select("key", F.expr("pos - at").alias("start"), "n", "item_id")
    places = _document_shingles(docs, lengths, ["key"]).join(prefixes, "shingle").where("pos >= at")
    starts = places.select("key", F.expr("pos - at").alias("start"), "n", "item_id", "words")
    joined = starts.join(docs, "key").where("start + n <= size(ws) AND slice(ws, start + 1, n) = words")
    return joined.select("key", "start", "n", "item_id")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, item_ids.

    ``n_hit`` counts the document's words inside any occurrence of a window of
    ``items(item_id, text)``; ``item_ids`` are the items with an occurring
    window, as strings in order. Null and empty texts have no words and no
    hits; items without words match nothing; null item ids are left out of
    ``item_ids`` but their windows count as hits. Repeated rows get a row each.
    """
    docs, items = plain_columns(docs, "doc_id", "text"), plain_columns(items, "item_id", "text")
    key = row_key("doc_id", "text").alias("key")
    worded = docs.select(key, words_of("text").alias("ws"))
    found = window_matches(worded, items, width)
    hits = found.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", F.expr("start + n").alias("stop")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    covered = F.expr(
        "aggregate(spans, struct(0 AS hit, 0 AS upto),"
        " (a, x) -> struct(a.hit + greatest(x.stop - greatest(x.start, a.upto), 0) AS hit, greatest(a.upto, x.stop) AS upto), a -> a.hit)"
    )
    hits = hits.select("key", covered.cast("long").alias("n_hit"), "item_ids")
    sized = docs.select("doc_id", key, word_count("text").alias("n_words"))
    joined = sized.join(hits, "key", "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``items``; every column stays."""
    key = row_key("doc_id", "text")
    worded = plain_columns(docs, "doc_id", "text").select(key.alias("key"), words_of("text").alias("ws"))
    found = window_matches(worded, plain_columns(items, "item_id", "text"), width)
    name = fresh(docs, "hit")
    return docs.join(found.select(F.col("key").alias(name)).distinct(), key == F.col(name), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, hash(doc_id, text) AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), w AS (
    SELECT DISTINCT item_id, list_slice(ws, s, s + 9) AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), n AS (SELECT DISTINCT len(win) AS n FROM w
), p AS (
    SELECT k, n, s, list_slice(ws, s, s + n - 1) AS win FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT DISTINCT k, ws FROM d), n WHERE len(ws) >= n)
), m AS (SELECT k, s, n, item_id FROM p JOIN w USING (win)
), h AS (
    SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS pos FROM m) GROUP BY k
), i AS (
    SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY k
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN i USING (k)
"""
