"""Pairs of texts by the exact similarity of their word shingles, by prefix filtering.

If two sets have a Jaccard similarity of at least ``t``, then in any fixed
order of all shingles the first ``n - ceil(t n) + 1`` of each, its prefix, have one in common.
The order puts shingles that a sample shows often last, then goes by hash, so what
the sample shows changes the work and never the result. Texts that
share a shingle of their prefixes are candidates. What they share in the prefixes bounds what they can
share in all, and so do parity bitmaps of the sets; the sets of the pairs that are left are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import SALTS, _spread
from .common import BROADCAST_ROWS, few, stage
from .components import connected_components

SEED = 43
#: One text in so many is sampled for frequent shingles; those in so many sampled texts, up to a number of them, come last.
SAMPLED, OFTEN, MOST_OFTEN = 16, 4, 100_000
#: Bits of a set's parity bitmap.
BITMAP = 1024
#: Bits of the folded bitmap that goes with each text of a crowded key; pairs that it lets by are held against the whole ones.
FOLDED = 512
#: From so many texts on, the texts of a key are compared with so many of them before any other pairs are made.
CROWD, CENTRES = 8, 3


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles; fewer words than a shingle are one, no words are none."""
    words = normal_words(text)
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    width = min(words_per_shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64).view(np.int64))


def _ceil(n, percent: int):
    """The least whole number that is ``percent`` of ``n`` or more."""
    if isinstance(n, F.Column):
        return F.floor((n * percent + 99) / 100)
    return -(-n * percent // 100)


def _often(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that many texts of a sample hold."""

    @F.pandas_udf("array<long>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield pd.Series([shingle_set(t, words) for t in some], dtype=object)

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.explode(shingles("text")).alias("key"))
    counted = sample.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {OFTEN}")
    rows = counted.orderBy(F.desc("n"), "key").limit(MOST_OFTEN).select("key").toArrow()
    return np.sort(rows.column("key").to_numpy())


def _bitmap(own: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of the hashes fall on it. Two bitmaps differ in no more bits than the sets in members."""
    return np.packbits(np.bincount(own & (BITMAP - 1), minlength=BITMAP).astype(np.uint8) & 1).view(np.int64)


def with_prefixes(docs: DataFrame, words: int, percent: int, *others: F.Column) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: its id, the columns ``others``, and what is needed to find similar ones.

    That is: node (hash of the text's words), row (a number for each row once the result is staged), size of the shingle set,
    of (size, last key of the prefix, and whether that is an often seen one, which come late), keys (the prefix), bitmap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_often(docs, words))

    @F.pandas_udf("struct<node: long, of: struct<size: int, late: boolean, last: long>, keys: array<long>, bitmap: array<long>>")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            own = shingle_set(text, words)
            known = np.isin(own, shared.value, assume_unique=True)
            ordered = np.concatenate((own[~known], own[known]))
            to = len(own) - _ceil(len(own), percent) + 1 if len(own) else 0
            of = {"size": len(own), "late": to > int((~known).sum()), "last": int(ordered[to - 1]) if to else 0}
            out.append((_node(text), of, ordered[:to], _bitmap(own)))
        return pd.DataFrame(out, columns=["node", "of", "keys", "bitmap"])

    found = docs.select("doc_id", *others, prefix("text").alias("__p"))
    return found.select("*", "__p.*", F.monotonically_increasing_id().alias("row")).drop("__p")


def _met(nodes: DataFrame, twice: DataFrame) -> DataFrame:
    """(node, of, key) for each of the keys of ``nodes(node, of, keys)`` that is in ``twice(key)``.

    Up to ``BROADCAST_ROWS`` keys are handed to the tasks as a sorted array: Spark's own table of them takes
    the driver eight times as much and more.
    """
    exploded = lambda keys: nodes.select("node", "of", F.explode(keys).alias("key"))
    if twice.count() > BROADCAST_ROWS:
        return exploded("keys").join(twice, "key").select("node", "of", "key")
    shared = nodes.sparkSession.sparkContext.broadcast(np.sort(twice.toArrow().column("key").to_numpy()))

    @F.pandas_udf("array<long>")
    def kept(keys: pd.Series) -> pd.Series:
        known, flat = shared.value, np.concatenate([np.zeros(0, np.int64), *keys])
        held = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        ends = np.cumsum([len(own) for own in keys])
        upto = np.concatenate(([0], np.cumsum(held)))[ends]
        return pd.Series(np.split(flat[held], upto[:-1]) if len(keys) else [], dtype=object)

    return exploded(kept("keys"))


def _node(text: str | None) -> int:
    number = xxhash.xxh64_intdigest(b" ".join(normal_words(text)), SEED)
    return number - (1 << 64) if number >> 63 else number


def _differ(p: str, q: str, bits: int) -> F.Column:
    """In how many bits two bitmaps differ."""
    return F.expr("+".join(f"bit_count({p}[{k}] ^ {q}[{k}])" for k in range(bits // 64)))


def _folded(bitmap: str) -> F.Column:
    """A parity bitmap of fewer bits for the same set: bits that fall together are added."""
    words, kept = BITMAP // 64, FOLDED // 64
    return F.array(*[F.expr(" ^ ".join(f"{bitmap}[{k}]" for k in range(at, words, kept))) for at in range(kept)])


def _possible(met: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of ``met(key, a, b, x, y)`` that may be similar enough by their sizes, the keys they are met with, and their bitmaps.

    Up to the smaller one of the two prefixes' last keys, all that both sets hold is met; beyond it there is
    no more than the rest of that set.
    """
    sized = met.where(f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)")
    pairs = sized.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"))
    both = F.col("x.size") + F.col("y.size")
    ends = F.expr("IF(struct(x.late, x.last) <= struct(y.late, y.last), x.size, y.size)")
    pairs = pairs.where((100 + percent) * (F.col("n") + _ceil(ends, percent) - 1) >= percent * both).select("a", "b", both.alias("both"))
    return _by_bitmaps(stage(pairs), bitmaps, percent)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pairs(a, b, ...)`` with salts, ``for_a`` and ``for_b``, and for each end the salts that its nodes have: (a, for_a) and (b, for_b)."""
    drawn, salts = pairs, []
    for key, by, salt in (("a", "b", "for_a"), ("b", "a", "for_b")):
        spread, hot = _spread(pairs, key)
        salts.append(spread.withColumnRenamed("salt", salt))
        hot = hot.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hot", F.lit(True))
        drawn = drawn.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(hot, [key, salt], "left")
        drawn = drawn.withColumn(salt, F.when(F.col("hot"), F.col(salt)).otherwise(F.lit(0))).drop("hot")
    return stage(drawn), *salts


def _with_ends(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` joined to ``left`` by a and to ``right`` by b, a row for each node; one that many pairs have is dealt to many tasks.

    The pairs are dealt and staged before anything wide is joined to them, so that sets are shuffled once.
    """
    drawn, for_a, for_b = _dealt(pairs)
    held = drawn.join(left.join(for_a, "a"), ["a", "for_a"])
    return held.join(right.join(for_b, "b"), ["b", "for_b"]).drop("for_a", "for_b")


def _by_bitmaps(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b, both)`` whose bitmaps differ in no more bits than similar sets may; ``both`` is the sum of their sizes."""
    p, q = (bitmaps.select(F.col("node").alias(own), F.col("bitmap").alias(name)) for own, name in (("a", "p"), ("b", "q")))
    held = _with_ends(pairs, p, q)
    return stage(held.where((100 + percent) * _differ("p", "q", BITMAP) <= (100 - percent) * F.col("both")).select("a", "b"))


def _near_centres(met: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar by size and bitmap, of each key's texts with ``CENTRES`` of them, for keys that ``CROWD`` texts or more have.

    Each key draws its own ones, so a text is compared with as many different ones as it has such keys. Only folded
    bitmaps go with the texts of a key; whole ones are joined to the pairs that are left.
    """
    crowded = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("key")
    folded = bitmaps.select("node", _folded("bitmap").alias("bits"))
    rows = met.join(few(stage(crowded)), "key", "left_semi").join(folded, "node")
    rows = stage(rows.select("key", F.struct("node", "of.size", "bits").alias("own")))
    drawn = [F.min_by("own", F.xxhash64(F.lit(k), "own.node", "key")) for k in range(CENTRES)]
    centres = rows.groupBy("key").agg(F.array(*drawn).alias("centres"))
    pairs = rows.join(centres, "key").select("own", F.explode("centres").alias("centre")).where("centre.node <> own.node")
    pairs = pairs.where(f"100 * least(own.size, centre.size) >= {percent} * greatest(own.size, centre.size)")
    pairs = pairs.withColumn("both", F.expr("own.size + centre.size")).where((100 + percent) * _differ("own.bits", "centre.bits", FOLDED) <= (100 - percent) * F.col("both"))
    ends = F.least("own.node", "centre.node").alias("a"), F.greatest("own.node", "centre.node").alias("b")
    return _by_bitmaps(stage(pairs.select(*ends, "both").distinct()), bitmaps, percent)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): the fingerprints of those ``pairs(a, b)`` of nodes whose sets are similar enough."""

    @F.pandas_udf("struct<node: long, own: array<long>>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in parts:
            yield pd.DataFrame([(_node(t), shingle_set(t, words)) for t in some], columns=["node", "own"])

    either = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(nodes.select("node", "fp", "doc_id").join(few(stage(either)), "node", "left_semi"))
    ids = few(wanted.select(F.col("doc_id").alias("id")).distinct())
    # Not deterministic, or Spark would test the result for null on all texts, before the join.
    own = shingles.asNondeterministic()("text").alias("s")
    found = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(own).select("s.*")
    # An id may have other texts, and rows may be repeated.
    sets = stage(found.groupBy("node").agg(F.first("own").alias("own")).join(wanted.select("node", "fp"), "node"))
    left = sets.select(F.col("node").alias("a"), F.col("fp").alias("u"), F.col("own").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("fp").alias("v"), F.col("own").alias("y"))
    held = _with_ends(pairs, left, right)
    common = F.size(F.array_intersect("x", "y"))
    similar = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return held.where(similar).select("u", "v")


def similar_links(docs: DataFrame, marked: DataFrame, links: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Links (u, v) that join, together with ``links``, all rows whose shingle sets are that similar.

    ``marked(doc_id, fp, ...)`` has the columns of ``with_prefixes`` and ``docs(doc_id, text)`` the texts.
    ``fp`` must depend on the text's words only. First the texts of each key that many have are compared with a
    few of them; then, of the texts that this leaves in different components, every pair that may be similar.
    So a large group of near copies is not paired throughout.
    """
    # One row of each text.
    copied = stage(marked.groupBy("node").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").select("node", "kept"))
    nodes = marked.join(few(copied), "node", "left").where("kept IS NULL OR kept = row").drop("kept", "row")
    bitmaps = nodes.select("node", "bitmap")
    exploded = nodes.select("node", "of", F.explode("keys").alias("key"))
    twice = stage(exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = stage(_met(nodes, twice))
    first = _verified(_near_centres(met, bitmaps, percent), nodes, docs, words, percent)
    first = stage(first.unionByName(links.select("u", "v")))
    named = nodes.select("node", "fp").join(connected_components(first).withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    placed = stage(met.join(named, "node"))
    # Keys whose texts are in more than one component, and for each the pairs of its components.
    roots = placed.select("key", "root").distinct()
    mixed = roots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    roots = stage(roots.join(mixed, "key", "left_semi"))
    across = roots.alias("l").join(roots.alias("h"), F.expr("l.key = h.key AND l.root < h.root")).select("l.key", F.col("l.root").alias("low"), F.col("h.root").alias("high"))
    left = placed.select("key", F.col("root").alias("low"), F.col("node").alias("a"), F.col("of").alias("x"))
    right = placed.select("key", F.col("root").alias("high"), F.col("node").alias("b"), F.col("of").alias("y"))
    rest = _possible(across.join(left, ["key", "low"]).join(right, ["key", "high"]), bitmaps, percent)
    return first.unionByName(_verified(rest, nodes, docs, words, percent))
