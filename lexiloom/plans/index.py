"""A stored index: postings in blocks that are clustered by term, and searches that read only their terms' blocks.

Under ``path`` lie three Parquet tables:

* ``blocks`` (shard, term, field, grp, n, heads, tokens, max_tf, min_dl, docs): the postings of one term and field in one
  group of documents, each with its frequency, the field's length and the positions. The folder is the shard, a hash of
  the term, and files are sorted by term, so a search prunes folders, then row groups. Each task writes the blocks of its
  own documents, so postings are not shuffled.
* ``terms`` (shard, term, field, df): document frequencies, clustered likewise.
* ``fields`` (field, n_docs, tokens): a row for each field.

A group holds documents of like length among ``BLOCK_DOCS`` neighbours, so a term's block is bounded
however common the term is. A block's greatest frequency with its least length bounds every score in it: the search for
the best documents reads the bounds first, then whole groups from the best bound on, and stops at the first that can't
reach the last rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.plans.queries import Clause
from lexiloom.plans.search import K1, B, held_clauses, terms_of
from lexiloom.plans.search import postings as postings_of
from lexiloom.sources.shared import staged, with_conf

SHARDS, BLOCK_DOCS = 16, 4096
#: Postings that a task turns into blocks at once, and those of the blocks that it hands on at once.
HELD_POSTINGS, HANDED_POSTINGS = 1_000_000, 200_000
#: Documents whose terms are handed to Python at once.
TEXT_ROWS = 1000
#: Length classes for each doubling of a document's length.
CLASSES = 2
#: Groups that are scored before the bounds of the others are looked at hold so many times the wanted documents, at least.
AHEAD = 4
#: Summing the same numbers in another order may differ in the last digits; bounds are widened by so much.
SLACK = 1 + 1e-9
#: Scores that are equal to so many decimals are a tie.
DECIMALS = 9


#: The columns of the stored tables; documents may be told by any type.
SCHEMAS = {
    "blocks": "term string, field string, grp long, n long, heads long, tokens long, max_tf int, min_dl long, docs array<struct<doc: {doc}, tf: int, dl: long, positions: array<int>>>, shard int",
    "terms": "term string, field string, df long, shard int",
    "fields": "field string, n_docs long, tokens long",
}


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _changes(values: pa.Array) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    differ = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], differ]))


@dataclass(frozen=True)
class _Postings:
    """Postings of some documents: each one's place in ``doc`` and ``fields``, its term and position. A document's positions in a field are in order."""

    doc: pa.Array
    fields: list[str]
    number: np.ndarray
    field: np.ndarray
    term: pa.Array
    pos: np.ndarray


def _of_rows(batches: list[pa.RecordBatch]) -> _Postings:
    """Of rows (doc, field, term, pos) that stand document by document."""
    doc, field, term, pos = (pa.concat_arrays([b.column(k) for b in batches]) for k in range(4))
    begins = _changes(doc)
    coded = field.dictionary_encode()
    number = np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(np.append(begins, len(doc))))
    return _Postings(doc.take(pa.array(begins)), coded.dictionary.to_pylist(), number, coded.indices.to_numpy(), term, pos.to_numpy())


def _of_texts(batches: list[pa.RecordBatch]) -> _Postings:
    """Of rows (doc, and the terms of each field as an array), one for each document."""
    doc = pa.concat_arrays([b.column(0) for b in batches])
    fields = batches[0].schema.names[1:]
    lists = [pa.concat_arrays([b.column(k + 1) for b in batches]) for k in range(len(fields))]
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]
    number = [np.repeat(np.arange(len(doc), dtype=np.int32), n) for n in sizes]
    pos = [np.arange(len(of), dtype=np.int32) - np.repeat(np.cumsum(n) - n, n).astype(np.int32) for of, n in zip(number, sizes)]
    field = [np.full(len(of), k, np.int32) for k, of in enumerate(number)]
    return _Postings(doc, fields, np.concatenate(number), np.concatenate(field), pa.concat_arrays([x.flatten() for x in lists]), np.concatenate(pos))


def _blocks_of(rows: _Postings, first_chunk: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """The blocks of some documents; those of ``block_docs`` neighbours and of like length are a group."""
    if not len(rows.term):
        return
    n_fields, n_docs = len(rows.fields), len(rows.doc)
    terms = rows.term.dictionary_encode()
    in_field = rows.number * n_fields + rows.field
    lengths = np.bincount(in_field, minlength=n_docs * n_fields)
    head = np.zeros(len(in_field), np.int8)
    head[np.unique(in_field, return_index=True)[1]] = 1
    sizes = np.floor(np.log2(np.maximum(lengths.reshape(-1, n_fields).sum(axis=1), 1)) * CLASSES).astype(np.int64)
    groups, group = np.unique((first_chunk + np.arange(n_docs) // block_docs) * _SIZES + sizes, return_inverse=True)
    # Postings by term, field, group and document; a document's positions stay in order.
    key = terms.indices.to_numpy().astype(np.int64) * n_fields + rows.field
    key = (key * len(groups) + group[rows.number]) * n_docs + rows.number
    order = np.argsort(key, kind="stable")
    key = key[order]
    entry = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(entry, len(key))).astype(np.int32)
    which, dl, heads = rows.number[order[entry]], lengths[in_field[order[entry]]], np.add.reduceat(head[order], entry, dtype=np.int64)
    of_block = key[entry] // n_docs
    block = np.flatnonzero(np.concatenate([[True], of_block[1:] != of_block[:-1]]))
    positions = pa.ListArray.from_arrays(pa.array(np.append(entry, len(key)), pa.int32()), pa.array(rows.pos[order], pa.int32()))
    told = pa.StructArray.from_arrays([rows.doc.take(pa.array(which)), pa.array(tf), pa.array(dl, pa.int64()), positions], ["doc", "tf", "dl", "positions"])
    word, own = np.divmod(of_block[block], len(groups))
    columns = {
        "term": terms.dictionary.take(pa.array(word // n_fields)),
        "field": pa.array(rows.fields, pa.string()).take(pa.array(word % n_fields)),
        "grp": pa.array(groups[own], pa.int64()),
        "n": pa.array(np.diff(np.append(block, len(entry))), pa.int64()),
        "heads": pa.array(np.add.reduceat(heads, block), pa.int64()),
        "tokens": pa.array(np.add.reduceat(tf, block, dtype=np.int64), pa.int64()),
        "max_tf": pa.array(np.maximum.reduceat(tf, block), pa.int32()),
        "min_dl": pa.array(np.minimum.reduceat(dl, block), pa.int64()),
        "docs": pa.ListArray.from_arrays(pa.array(np.append(block, len(entry)), pa.int32()), told),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    cuts = [0, *(np.flatnonzero(np.diff(entry[block] // HANDED_POSTINGS)) + 1).tolist(), len(block)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


#: More than the length classes of any document, and than the chunks of documents of any task.
_SIZES, _CHUNKS = 128, 1 << 24


def _first_chunk() -> int:
    return TaskContext.get().partitionId() * _CHUNKS


def _row_blocks(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, n_docs, n_rows = [], _first_chunk(), 0, 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n_docs += len(_changes(batch.column(0)))
            n_rows += len(batch)
            if n_docs < block_docs and n_rows < HELD_POSTINGS:
                continue
            # The last document may go on in the next batch.
            rows = pa.Table.from_batches(held).combine_chunks()
            begins = _changes(rows.column(0).chunk(0))
            if len(begins) > 1:
                last = int(begins[-1])
                yield from _blocks_of(_of_rows(rows.slice(0, last).to_batches()), chunk, block_docs)
                chunk += -(-(len(begins) - 1) // block_docs)
                rows = rows.slice(last)
            held, n_docs, n_rows = rows.to_batches(), 1, len(rows)
        if held:
            yield from _blocks_of(_of_rows(held), chunk, block_docs)

    return blocks


def _text_blocks(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, n_docs, n_terms = [], _first_chunk(), 0, 0
        for batch in batches:
            terms = sum(len(x.flatten()) for x in batch.columns[1:])
            if held and (n_docs + len(batch) > block_docs or n_terms + terms > HELD_POSTINGS):
                yield from _blocks_of(_of_texts(held), chunk, block_docs)
                chunk += -(-n_docs // block_docs)
                held, n_docs, n_terms = [], 0, 0
            held.append(batch)
            n_docs, n_terms = n_docs + len(batch), n_terms + terms
        if held:
            yield from _blocks_of(_of_texts(held), chunk, block_docs)

    return blocks


def write_index(postings: DataFrame, path: str, n_docs: int, shards: int = SHARDS, block_docs: int = BLOCK_DOCS) -> "StoredIndex":
    """Store ``postings(doc, field, term, pos)`` of about ``n_docs`` documents; null documents and terms are left out.

    Postings are dealt and sorted by document once; then each task writes the blocks of its documents.
    """
    told = postings.where("doc IS NOT NULL AND term IS NOT NULL").select("doc", "field", "term", F.col("pos").cast("int").alias("pos"))
    return _stored(told.repartition("doc").sortWithinPartitions("doc", "field", "pos"), _row_blocks(block_docs), path, min(shards, 1 + n_docs // block_docs))


def write_texts(docs: DataFrame, id_col: str, fields: list[str], path: str, shards: int = SHARDS, block_docs: int = BLOCK_DOCS) -> "StoredIndex":
    """Store the words of text columns. Nothing is shuffled if ids are different; rows of the same id are one document."""
    named = docs.where(F.col(id_col).isNotNull())
    ids = named.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.count("*").alias("docs"), F.max("n").alias("most")).first()
    if (ids["most"] or 0) > 1:
        return write_index(postings_of(named, id_col, fields), path, ids["docs"], shards, block_docs)
    told = named.select(F.col(id_col).alias("doc"), *[terms_of(F.col(f)).alias(f) for f in fields])
    with with_conf(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS)):
        return _stored(told, _text_blocks(block_docs), path, min(shards, 1 + ids["docs"] // block_docs))


def _stored(told: DataFrame, to_blocks: Callable, path: str, shards: int) -> "StoredIndex":
    doc = told.schema["doc"].dataType.simpleString()
    blocks = told.mapInArrow(to_blocks, SCHEMAS["blocks"].format(doc=doc).removesuffix(", shard int")).withColumn("shard", _shard(F.col("term"), shards))
    blocks.sortWithinPartitions("shard", "term", "field", "grp").write.partitionBy("shard").parquet(f"{path}/blocks")
    index = StoredIndex(told.sparkSession, path, doc, shards)
    stored = index.table("blocks")
    terms = stored.groupBy("shard", "term", "field").agg(F.sum("n").alias("df"))
    terms.repartition("shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/terms")
    # A field's documents are counted at the first of their terms.
    stored.groupBy("field").agg(F.sum("heads").alias("n_docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{path}/fields")
    return index


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    doc: str
    shards: int = SHARDS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name].format(doc=self.doc)).parquet(f"{self.path}/{name}")

    def _of(self, table: str, words: list[str]) -> DataFrame:
        """The rows of some terms: the shards are folders to prune, the terms reach the Parquet scan."""
        shards = F.col("shard").isin([_shard(F.lit(w), self.shards) for w in words])
        return self.table(table).where(shards & F.col("term").isin(words)).drop("shard")

    def blocks(self, words: list[str]) -> DataFrame:
        return self._of("blocks", list(dict.fromkeys(words)) or [""])

    def weights(self, words: list[str], boosts: dict[str, float]) -> DataFrame:
        """(term, field, weight, avgdl): boost times inverse document frequency; a row for each word and field at most."""
        fields = self.table("fields").where(F.col("field").isin(list(boosts)))
        terms = self._of("terms", list(dict.fromkeys(words)) or [""])
        boost = F.element_at(F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair]), F.col("field"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(F.broadcast(fields), "field").select("term", "field", (boost * idf).alias("weight"), (F.col("tokens") / F.col("n_docs")).alias("avgdl"))

    def scored(self, words: list[str], boosts: dict[str, float], groups: DataFrame | None = None) -> DataFrame:
        """(doc, field, term, s): the BM25 score of each word in each field of each document, of some groups only if given."""
        blocks = self.blocks(words).select("term", "field", "grp", "docs")
        if groups is not None:
            blocks = blocks.join(groups, "grp", "left_semi")
        each = blocks.join(F.broadcast(self.weights(words, boosts)), ["term", "field"]).select("term", "field", "weight", "avgdl", F.explode(F.col("docs")).alias("d"))
        return each.select("d.doc", "field", "term", (F.col("weight") * _impact(F.col("d.tf"), F.col("d.dl"))).alias("s"))

    def best_field(self, words: list[str], boosts: dict[str, float], groups: DataFrame | None = None) -> DataFrame:
        """(doc, score): each document's greatest score over the fields; a field's is the sum of its words'."""
        return self.scored(words, boosts, groups).groupBy("doc").agg(_greatest_sum("s", boosts).alias("score"))

    def bounds(self, words: list[str], boosts: dict[str, float]) -> DataFrame:
        """(grp, bound, n): no document of a group scores above its bound. No postings are read for it."""
        heads = self.blocks(words).select("term", "field", "grp", "n", "max_tf", "min_dl").join(F.broadcast(self.weights(words, boosts)), ["term", "field"])
        scored = heads.withColumn("s", F.col("weight") * _impact(F.col("max_tf"), F.col("min_dl")))
        return scored.groupBy("grp").agg((_greatest_sum("s", boosts) * SLACK).alias("bound"), F.max("n").alias("n"))

    def top(self, words: list[str], boosts: dict[str, float], k: int) -> DataFrame:
        """(doc, score): the ``k`` best documents, ties by document; the same as sorting ``best_field``, from fewer blocks.

        Scores count to ``DECIMALS`` decimals, as their last digits depend on the order in which words are summed.
        """
        bounds = staged(self.bounds(words, boosts))
        ahead = Window.orderBy(F.desc("bound"), "grp").rowsBetween(Window.unboundedPreceding, -1)
        # The best groups only: each has a document at least, so AHEAD * k of them are always enough.
        best = bounds.orderBy(F.desc("bound"), "grp").limit(AHEAD * k).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        first = staged(best.where(F.col("before") < AHEAD * k).select("grp"))
        order = [F.round("score", DECIMALS).desc(), F.asc("doc")]
        found = staged(self.best_field(words, boosts, first).orderBy(*order).limit(k))
        last = found.agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        rest = bounds.join(first, "grp", "left_anti")
        rest = rest.where(F.col("bound") >= last["least"] - 10**-DECIMALS) if last["n"] == k else rest
        return found.unionByName(self.best_field(words, boosts, rest.select("grp"))).orderBy(*order).limit(k)

    def matches(self, asked: list[Clause], boosts: dict[str, float]) -> DataFrame:
        """(doc, score): documents for which every clause holds in some way, a word in any of the fields.

        A word scores its best field, a way the sum of its words, a clause its best way, a document the sum of its clauses.
        """
        words = [w for c in asked for w in c.words()]
        hits = self.scored(words, boosts).groupBy("doc", "term").agg(F.max("s").alias("s"))
        return held_clauses(hits, asked)

    def phrase(self, words: list[str], fields: list[str], slop: int = 0) -> DataFrame:
        """(doc, field): where ``words`` stand in order, moved by ``slop`` places at most in all.

        A word's place in the phrase is taken from each of its positions; the phrase stands where all words have one
        within ``slop`` of the least. A repeated word needs as many positions of its own.
        """
        if not words:
            return self.scored([], {f: 1.0 for f in fields}).select("doc", "field").where("false")
        places = self.spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, k int")
        blocks = self.blocks(words).where(F.col("field").isin(fields)).select("term", "field", F.explode("docs").alias("d"))
        each = blocks.join(F.broadcast(places), "term").select("d.doc", "field", "term", "k", F.explode("d.positions").alias("pos"))
        if len(words) > 1 or slop:
            each = each.select("doc", "field", "term", "k", "pos", F.explode(F.sequence(F.col("pos") - F.col("k") - slop, F.col("pos") - F.col("k"))).alias("base"))
        else:
            each = each.withColumn("base", F.col("pos"))
        repeated = {w: [k for k, x in enumerate(words) if x == w] for w in dict.fromkeys(words) if words.count(w) > 1}
        held = [F.collect_set(F.when(F.col("term") == w, F.col("pos"))).alias(f"p{n}") for n, w in enumerate(repeated)]
        stands = each.groupBy("doc", "field", "base").agg(F.count_distinct("k").alias("found"), *held).where(F.col("found") == len(words))
        for n, at in enumerate(repeated.values()):
            for a in range(len(at)):
                for b in range(a + 1, len(at)):
                    # Any run of the word's places in the phrase needs as many positions in the text.
                    stands = stands.where(f"size(filter(p{n}, p -> p BETWEEN base + {at[a]} AND base + {at[b] + slop})) >= {b - a + 1}")
        return stands.select("doc", "field").distinct()


def _impact(tf: Column, dl: Column) -> Column:
    """How much a word counts in a text of ``dl`` words; grows with ``tf`` and falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _greatest_sum(score: str, boosts: dict[str, float]) -> Column:
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col(score))), F.lit(0.0)) for f in boosts]
    return F.greatest(*sums) if len(sums) > 1 else sums[0]
