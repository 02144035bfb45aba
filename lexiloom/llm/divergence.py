"""How far each source's choice of words is from its language's and from other sources'.

One pass over the texts counts terms within each task; a single shuffle by
(language, term) makes postings: a term's counts in all sources that have it.
Shares are whole numbers of billionths, and all later arithmetic is exact.

The terms that speak most for a group come from an upper-bound search: the
group's terms lie in buckets by their count, and a bucket's greatest count
with its least share in the language bounds every divergence in it. Buckets
are evaluated best bound first, until all that are left are strictly below the
last of the wanted ranks. Pairs of sources come from the postings: terms that
both have are paired there, terms that only one has come from the histogram of
its shares, and terms that neither has are all alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_columns, read_table, release_memory, stage

LEAST_DOCUMENTS, TOP = 3, 200
SCALE = 1_000_000_000
#: Terms that a task counts before it hands them on.
COUNTED_AT_ONCE = 600_000
#: Buckets for each doubling of a count.
STEPS = 8
#: How many times as many terms a group without enough results evaluates in the next round.
WIDER = 4
#: Bytes between terms become spaces, A-Z lower-case; all bytes of other characters stay.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTED = "lang string, term string, docs long, sources array<string>, times array<long>"
_POSTINGS = "lang string, term string, n long, entries array<struct<source: string, n: long>>"


def terms(text: str) -> list[bytes]:
    """The terms of a whole text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each (lang, term) of what a task holds at once: the documents that have it, and its counts by source.

    A row with a null term names the sources that occur.
    """
    times: dict[str, dict[str, Counter]] = {}
    docs: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, sources in times.items():
            found = docs[lang]
            spot = {w: k for k, w in enumerate(found, 1)}
            spots = np.concatenate([np.fromiter(map(spot.__getitem__, c), np.int64, len(c)) for c in sources.values()])
            counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources.values()])
            origin = np.repeat(np.arange(len(sources)), [len(c) for c in sources.values()])
            order = np.argsort(spots, kind="stable")
            # The row in front, whose term is null, has all sources.
            origin = np.concatenate([np.arange(len(sources)), origin[order]])
            counts = np.concatenate([np.zeros(len(sources), np.int64), counts[order]])
            ends = np.cumsum(np.concatenate([[0, len(sources)], np.bincount(spots, minlength=len(found) + 1)[1:]])).astype(np.int32)
            rows = len(found) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * rows, pa.string()),
                    pa.array([None, *found], pa.binary()).cast(pa.string()),
                    pa.array([0, *found.values()], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(list(sources), pa.string()).take(pa.array(origin))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(counts)),
                ],
                names=["lang", "term", "docs", "sources", "times"],
            )
        times.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = terms(text)
            counted, found = times.setdefault(lang, {}).setdefault(source, Counter()), docs.setdefault(lang, Counter())
            held -= len(counted)
            counted.update(words)
            found.update(set(words))
            held += len(counted) + 1
            if held >= COUNTED_AT_ONCE:
                yield from flush()
                held = 0
    yield from flush()
    release_memory()


def _merge(least: int):
    """From rows of ``_COUNTED`` sorted by (lang, term): the postings of each term that ``least`` documents have."""

    def merged(table: pa.Table) -> pa.RecordBatch:
        lang, term = (table.column(k).combine_chunks() for k in ("lang", "term"))
        new = np.ones(len(lang), bool)
        if len(lang) > 1:
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        kept = np.add.reduceat(table.column("docs").to_numpy(), first) >= least
        lists = table.column("sources").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        posting = np.repeat(np.cumsum(new) - 1, sizes)
        coded = lists.flatten().dictionary_encode()
        source = coded.indices.to_numpy().astype(np.int64)
        n = table.column("times").combine_chunks().flatten().to_numpy()
        chosen = kept[posting]
        # A source's counts from several tasks come together; a term's sources follow each other.
        codes, at = np.unique(posting[chosen] * len(coded.dictionary) + source[chosen], return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, at, n[chosen])
        owner = np.cumsum(kept)[codes // max(len(coded.dictionary), 1)] - 1
        count = int(kept.sum())
        totals = np.zeros(count, np.int64)
        np.add.at(totals, owner, sums)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int32)
        names = coded.dictionary.take(pa.array(codes % max(len(coded.dictionary), 1)))
        entries = pa.StructArray.from_arrays([names, pa.array(sums)], names=["source", "n"])
        rows = pa.array(first[kept])
        return pa.RecordBatch.from_arrays([lang.take(rows), term.take(rows), pa.array(totals), pa.ListArray.from_arrays(pa.array(ends), entries)], names=["lang", "term", "n", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            # The last term may go on in the next batch.
            lang, term = (table.column(k).combine_chunks() for k in ("lang", "term"))
            last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy(zero_copy_only=False)
            whole = int(len(last) - last[::-1].argmin()) if not last.all() else 0
            if whole:
                yield merged(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield merged(held)
        release_memory()

    return run


def _share(n: F.Column | str, total: F.Column | str, v: F.Column | str) -> F.Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), in decimals, which no count overflows."""
    return F.expr(f"1 + (CAST({SCALE} AS decimal(10, 0)) * CAST({n} + 1 AS decimal(20, 0))) div CAST({total} + {v} AS decimal(20, 0))").cast("long")


def _f(p: str, q: str) -> str:
    """SQL for floor((p - q)^2 / q); shares are at most a billion and one, so a long holds the square."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


class Counts:
    """The staged tables of one corpus: postings of kept terms, groups with their sizes, languages with theirs."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        partial = stage(rows.mapInArrow(_count, _COUNTED))
        occurring = partial.where("term IS NULL").select("lang", F.explode("sources").alias("source")).distinct()
        # A task has few rows for a term, so a common term has about as many rows as there are tasks.
        dealt = partial.where("term IS NOT NULL").repartition("lang", "term").sortWithinPartitions("lang", "term")
        self.postings = stage(dealt.mapInArrow(_merge(least), _POSTINGS))
        kept = self.postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
        held = self.entries().groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = occurring.join(held, ["lang", "source"], "left").join(kept.select("lang", "v"), "lang", "left")
        # A row for each (lang, source); Spark broadcasts it only where its own size check allows.
        self.groups = stage(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")))
        self.languages = stage(kept)

    def entries(self) -> DataFrame:
        """(lang, term, lang_n, source, n) for each count above zero."""
        return self.postings.select("lang", "term", F.col("n").alias("lang_n"), F.explode("entries").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")

    def shares(self) -> DataFrame:
        """``entries`` with the group's share ``p``, the language's ``q`` and the ``bucket`` of the count."""
        sized = self.entries().join(self.groups, ["lang", "source"]).join(self.languages.select("lang", F.col("total").alias("lang_total")), "lang")
        bucket = F.floor(F.log2("n") * STEPS).cast("int").alias("bucket")
        return sized.select("lang", "source", "term", bucket, _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"))


def top_terms(counts: Counts, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms of each group whose share there is above the language's."""
    shares = stage(counts.shares())
    group = ["lang", "source"]
    buckets = shares.groupBy(*group, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("n")).where("p > q")
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounded = buckets.select(*group, "bucket", "n", F.expr(_f("p", "q")).alias("bound"))
    # before: how many terms lie in better buckets of the group; a group has some hundreds of buckets.
    bounded = stage(bounded.withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))))
    ranks = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best, state, wanted = None, bounded.select(*group).distinct().withColumn("least", F.lit(None).cast("long")).withColumn("done", F.lit(0).cast("long")), top
    while True:
        # Next come the unseen buckets that may still hold a result: all that reach the value at the last rank, or, where
        # there is none yet, the best ones up to the wanted number of further terms.
        chosen = bounded.join(state, group).where(F.col("before") >= F.col("done")).where(F.when(F.col("least").isNull(), F.col("before") < F.col("done") + wanted).otherwise(F.col("bound") >= F.col("least")))
        chosen = stage(chosen.select(*group, "bucket", "n", "before"))
        if chosen.isEmpty():
            break
        found = shares.join(chosen.select(*group, "bucket"), [*group, "bucket"]).where("p > q").select(*group, F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        both = found if best is None else best.select(*group, "item", "value").unionByName(found)
        best = stage(both.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top))
        seen = chosen.groupBy(*group).agg(F.max(F.expr("before + n")).alias("seen"))
        reached = best.groupBy(*group).agg(F.max(F.when(F.col("rank") == top, F.col("value"))).alias("reached"))
        after = state.join(seen, group, "left").join(reached, group, "left")
        state = stage(after.select(*group, F.col("reached").alias("least"), F.greatest("done", F.coalesce("seen", F.lit(0))).alias("done")))
        wanted *= WIDER
    if best is None:
        return shares.select(*group, F.col("term").alias("item"), F.col("p").alias("value"), F.lit(0).alias("rank")).where("false")
    return best


def pair_sums(counts: Counts) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language.

    With f00 for a term that neither has, the sum over all kept terms is V * f00, plus f - f00 for each term that
    one of them has as if the other had not, plus what terms that both have differ from that.
    """
    sized = counts.groups.select("lang", "source", "total", "v", _share("0", "total", "greatest(v, 1)").alias("zero"))
    ends = sized.alias("a").join(sized.alias("b"), F.expr("a.lang = b.lang AND a.source <> b.source"))
    pairs = ends.select("a.lang", "a.source", F.col("b.source").alias("item"), "a.v", F.col("a.zero").alias("p0"), F.col("b.zero").alias("q0"))

    own = counts.entries().join(counts.groups, ["lang", "source"]).select("lang", "term", "source", _share("n", "total", "v").alias("p"), _share("0", "total", "v").alias("zero"))
    own = stage(own)
    # How often each group has each share; distinct shares are as few as distinct counts.
    shape = own.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    shape = stage(shape.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shape")))

    listed = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("e")).where("size(e) > 1")
    first = listed.select("lang", "e", F.posexplode("e").alias("k", "a"))
    met = first.select("lang", "a", F.explode(F.expr("slice(e, k + 2, size(e))")).alias("b"))
    extra = lambda p, p0, q, q0: f"{_f(p, q)} - {_f(p, q0)} - {_f(p0, q)} + {_f(p0, q0)}"
    met = met.select("lang", F.col("a.source").alias("s"), F.col("b.source").alias("t"), F.expr(extra("a.p", "a.zero", "b.p", "b.zero")).alias("st"), F.expr(extra("b.p", "b.zero", "a.p", "a.zero")).alias("ts"))
    met = stage(met.groupBy("lang", "s", "t").agg(F.sum("st").alias("st"), F.sum("ts").alias("ts")))
    both = met.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("both")).unionByName(
        met.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("both"))
    )

    here = shape.select("lang", "source", F.col("shape").alias("mine"))
    there = shape.select("lang", F.col("source").alias("item"), F.col("shape").alias("theirs"))
    told = pairs.join(here, ["lang", "source"], "left").join(there, ["lang", "item"], "left").join(both, ["lang", "source", "item"], "left")
    one = lambda shape, p, q: f"coalesce(aggregate({shape}, 0L, (s, x) -> s + x.n * ({_f(p, q)} - {_f('p0', 'q0')})), 0L)"
    value = F.expr(f"v * {_f('p0', 'q0')} + {one('mine', 'x.p', 'q0')} + {one('theirs', 'p0', 'x.p')} + coalesce(both, 0L)")
    return told.select("lang", "source", "item", value.alias("value"))


def source_audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs(text, lang, source)``; see the parts above.

    Null text, language and source count as empty. Part ``pair`` has a row for each other source of the language,
    with value 0 where no term is kept; part ``term`` has up to ``top`` terms. Repeated rows count as often as they
    occur; equal values are ranked by the item's UTF-8. An empty table gives no rows.
    """
    counts = Counts(plain_columns(docs, "text", "lang", "source"), least)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(counts).withColumn("rank", F.row_number().over(ranks))
    parts = [("pair", pairs), ("term", top_terms(counts, top))]
    both = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in parts]
    return both[0].unionByName(both[1])


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents
), w AS (
    SELECT k, lang, source, unnest(ws) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), s AS (
    SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total, (SELECT count(*) FROM kept WHERE kept.lang = g.lang) AS v FROM g
), l AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM kept
), p AS (
    SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p
    FROM s JOIN kept USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term
), f AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT p.lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
