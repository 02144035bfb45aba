"""SimHash near-duplicate groups with pigeonring filtering.

The 64 bits form a ring of eight segments of eight bits. If two fingerprints
differ in at most three bits, some segment starts a chain whose first ``l``
segments differ in at most ``floor(3 l / 8)`` bits, for every ``l`` up to
eight: 0, 0, 1, 1, 1, 2, 2, 3. The first two segments of such a chain are
equal and so are two of the next three, which makes an exact join key of 32
bits; the rest of the chain prunes what the key brings together before the
full distance is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, fresh, plain_columns, read_table, row_key, stage
from .components import connected_components
from .similar import similar_links, with_prefixes

SEED = 42
MAX_BITS = 3
#: Shingles hashed and counted at once, which bounds the memory for a very long text.
SHINGLES_AT_ONCE = 1 << 16
#: Copies of the answer for a fingerprint of more than so many rows, so that one text in a third of all rows is spread out.
HOT, SALTS = 1000, 16


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The SimHash of a whole text as a signed 64-bit number.

    A text that is null, empty or only white space has fingerprint 0; one of
    fewer words than a shingle counts as one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    width = min(words_per_shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = min(n, at + SHINGLES_AT_ONCE)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str, words_per_shingle: int = 3) -> F.Column:
    """The fingerprint of a column of texts."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return simhash(text)


def _keys() -> F.Column:
    """The 24 chain keys of a fingerprint: start, the segment left out of the third to fifth, four segments."""
    seg = lambda k: f"(shiftrightunsigned(fp, {8 * (k % 8)}) & 255)"
    keys = []
    for start in range(8):
        for left_out in range(3):
            kept = [seg(start), seg(start + 1), *(seg(start + 2 + k) for k in range(3) if k != left_out)]
            number = " | ".join(f"shiftleft({s}, {8 * (3 - k)})" for k, s in enumerate(kept))
            keys.append(F.expr(f"struct({start} AS start, ({start * 3 + left_out}L * 4294967296L) | ({number}) AS key)"))
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs (u, v), u < v, of different fingerprints at ``max_bits`` (at most 3) or fewer differing bits.

    The keys are shuffled: by the size of the fingerprints, which Spark goes by, it would broadcast 24 times as many rows.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the chain budgets hold for 0 to {MAX_BITS} bits")
    keyed = distinct.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.start", "k.key")
    a, b = keyed.alias("a"), keyed.select("fp", "key").alias("b")
    differ = "(a.fp ^ b.fp)"
    ring = f"(shiftrightunsigned({differ}, 8 * a.start) | shiftleft({differ}, 64 - 8 * a.start))"
    viable = f"bit_count({ring} & 1099511627775L) <= 1 AND bit_count({ring} & 72057594037927935L) <= 2"
    near = F.expr(f"a.key = b.key AND a.fp < b.fp AND {viable} AND bit_count({differ}) <= {max_bits}")
    return a.join(b.hint("merge"), near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = MAX_BITS, similar: tuple[int, int] | None = None) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    With ``similar``, (words, percent), texts whose sets of shingles of so many
    words have that Jaccard similarity or more are linked too, however far their fingerprints are.

    Equal fingerprints are one node, so copies are never paired. Rows without
    words share fingerprint 0 and are linked like any other. ``component_id``
    is the least id that can be reached; null ids count only where a component
    has no other. Repeated rows each get their row; an empty table gives none.
    """
    return _groups(docs, words_per_shingle, max_bits, similar).select("doc_id", "fp", "component_id")


def _groups(docs: DataFrame, words_per_shingle: int, max_bits: int, similar: tuple[int, int] | None) -> DataFrame:
    """The groups, with ``text_key`` for each row."""
    plain = plain_columns(docs, "doc_id", "text")
    own = [fingerprint_of("text", words_per_shingle).alias("fp"), row_key("text").alias("text_key")]
    prints = with_prefixes(plain, *similar, *own) if similar else plain.select("doc_id", *own)
    prints = stage(prints)
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = fingerprint_links(distinct, max_bits)
    roots = connected_components(similar_links(plain, prints, links, *similar) if similar else links)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint with many rows has its answer in several copies, which the rows are dealt to.
    salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answer = named.join(least, "root").select("fp", "component_id", F.explode(salts).alias("salt"))
    hot = few(named.where(F.col("n") > HOT).select("fp", F.lit(True).alias("hot")))
    rows = prints.select("doc_id", "fp", "text_key").join(hot, "fp", "left")
    salted = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return salted.join(answer, ["fp", "salt"]).select("doc_id", "fp", "component_id", "text_key")


def near_dedup(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = MAX_BITS, similar: tuple[int, int] | None = None) -> DataFrame:
    """One document of each near-duplicate group of ``docs``, with every column.

    It is the one of the least id; of several with that id, the one whose text has the least hash. Null ids
    come last. Rows equal in id and text are one document, and stay or go together.
    """
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = stage(_groups(docs, words_per_shingle, max_bits, similar).select("component_id", "fp", document.alias("own")))
    # Groups without any id are told apart by fingerprint, as far as one goes.
    by = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("only")]
    kept = groups.groupBy(*by).agg(F.min("own").alias("kept"))
    same = F.expr("g.component_id <=> k.component_id AND IF(g.component_id IS NULL, g.fp, NULL) <=> k.only")
    gone = groups.alias("g").join(kept.alias("k"), same).where("own <> kept").select("own.doc_id", "own.text_key").distinct()
    own, key = fresh(docs, "gone"), fresh(docs, "gone_key")
    gone = few(stage(gone.withColumnsRenamed({"doc_id": own, "text_key": key})))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (row_key("text") == F.col(key)), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return groups.select("doc_id", text, "component_id")
