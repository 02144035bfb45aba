"""Importance resampling towards a target, in DataFrame operations only.

Hashed n-grams of all raw and of all target texts are counted in buckets. A
bucket's gain is the logarithm of its share in the target over its share in
the raw texts; a document's weight is the sum of its features' gains. Gumbel
noise drawn from the document's id turns the highest scores into a draw
without replacement. The draw is one distributed sort: a row's rank is its
place in its range partition after the sizes of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, plain_columns, read_table, row_key, stage
from .decontaminate import words_of

#: Buckets of features; the gain table has no more rows than this, so it may be broadcast.
BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
_PLACE_BITS = 33


def _n_features(words: str) -> F.Column:
    """The number of runs of 1 to LONGEST words in an array of words."""
    return F.expr(" + ".join(f"greatest(size({words}) - {k}, 0)" for k in range(LONGEST))).cast("long")


def _buckets(rows: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """``keep`` and one ``bucket`` for each feature of the array ``ws``; one null bucket for a row without words.

    The words are zipped with themselves shifted, so that each position brings its runs in generated code.
    """
    shifted = ", ".join(["ws", *(f"slice(ws, {k + 1}, size(ws))" for k in range(1, LONGEST))])
    each = rows.select(*keep, F.explode_outer(F.expr(f"arrays_zip({shifted})")).alias("z"))
    names = [f"w{k}" for k in range(LONGEST)]
    each = each.select(*keep, *[F.col("z").getField(str(k) if k else "ws").alias(n) for k, n in enumerate(names)])
    # A word's bucket is null only where the row has no words, and such a row stays as one null bucket.
    runs = [F.crc32(F.concat_ws(" ", *names[: k + 1])) % buckets for k in range(LONGEST)]
    held = F.array(*[F.when(F.col(names[k]).isNotNull(), run) for k, run in enumerate(runs)])
    return each.select(*keep, F.col(names[0]).isNull().alias("none"), F.posexplode(held).alias("k", "bucket")).where("bucket IS NOT NULL OR (none AND k = 0)").drop("none", "k")


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each bucket that a feature of ``raw(text)`` falls in; at most ``buckets`` rows."""
    sides = [
        _buckets(df.select(words_of("text").alias("ws")), [], buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
        for df, name in ((raw, "s"), (target, "t"))
    ]
    counts = stage(sides[0].join(sides[1], "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()  # two numbers
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets)))
    return counts.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _noise(seed: int) -> F.Column:
    """Gumbel noise in thousandths from the document's id alone, so that a rerun draws the same; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, key, n_words, n_features, weight, score.

    ``key`` is a 128-bit hash of id and text. A null text has no words; a row without words weighs 0 and its score
    is its noise. A null id has the noise of an empty one. Rows equal in both columns get a row each, all with the
    same score. An empty target still gives gains: every bucket then counts as seen once more than never.
    """
    plain = plain_columns(docs, "doc_id", "text")
    gains = bucket_gains(plain, plain_columns(target, "text"), buckets)
    worded = plain.select("doc_id", row_key("doc_id", "text").alias("key"), words_of("text").alias("ws"))
    worded = worded.select("doc_id", "key", "ws", F.size("ws").cast("long").alias("n_words"), _n_features("ws").alias("n_features"))
    own = ["doc_id", "key", "n_words", "n_features"]
    found = _buckets(worded, own, buckets).join(F.broadcast(gains), "bucket", "left")
    # Rows equal in id and text are summed together; as each brings n_features rows, their number is known.
    summed = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_features").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"), F.count("*").alias("rows"))
    copies = F.expr("rows div greatest(n_features, 1)")
    each = summed.withColumn("copies", copies).select(*own, F.expr("gains div copies").alias("weight"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return each.select(*own, "weight", (F.col("weight") + _noise(seed)).alias("score"))


def ranked(rows: DataFrame, order: list[F.Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3... in ``order``, without bringing all rows to one task.

    The rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the
    partitions before, one number for each. The sorted table is written once, so that a lost task finds the same
    places again; ``order`` should tell apart all rows that differ.
    """
    at, part, before = (fresh(rows, n) for n in ("at", "part", "before"))
    placed = stage(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, _PLACE_BITS))
    sizes = placed.groupBy(part).agg(F.count("*").alias(before))  # one row for each partition
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    place = F.col(at).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(sizes), part).select(*rows.columns, (place + F.col(before) + 1).cast("long").alias(name))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_features, weight, score, rank.

    Of the N rows of ``least_words`` words or more the floor(percent * N / 100) of the highest scores have a rank;
    ties go to the smaller id, null ids first, then to fewer features. All other rows have a null rank.
    """
    scored = stage(importance_scores(docs, target, buckets, seed))
    long_enough = F.col("n_words") >= least_words
    eligible = scored.where(long_enough)
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("key")]
    rows = ranked(eligible, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return rows.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH crc_table AS MATERIALIZED (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM (SELECT unnest(range(256)) AS b))
), d AS (
    SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), u AS (
    SELECT k, false AS target, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ws) >= n
    UNION ALL SELECT NULL, true, ws, n, unnest(range(1, len(ws) - n + 2)) FROM b, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ws) >= n
), f AS MATERIALIZED (
    SELECT k, target, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS feature FROM u
), x AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, [CAST(concat('0x', h) AS BIGINT) FOR h IN regexp_extract_all(hex(encode(feature)), '..')]),
        lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM f), crc_table
), c AS (
    SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN x USING (feature) GROUP BY bucket
), g AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM c) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM c) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c
), w AS (
    SELECT k, count(*) AS n_features, sum(gain) AS weight FROM f JOIN x USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY k
), r AS (
    SELECT d.doc_id, len(ws) >= 20 AS long_enough, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM d LEFT JOIN w USING (k)
), o AS (
    SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY long_enough) AS n FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= 5 * n // 100 THEN place END AS rank FROM o
"""
