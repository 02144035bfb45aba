"""A postings table, keyword search over it, and pages of results."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import LOWER, UPPER, fold, runs, word_runs
from lexiloom.plans.queries import Clause
from lexiloom.sources.shared import staged

#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: A query has so many words at most for its word table to be broadcast.
QUERY_WORDS = 10_000


def _terms(text: Column) -> Column:
    return F.filter(word_runs(text), lambda t: t.rlike(r"[^\p{javaWhitespace}\p{P}\p{S}]"))


def terms_of(field: Column) -> Column:
    """The terms of a field in order, none of a null one; symbols and white space are no terms."""
    return _terms(F.coalesce(field.cast("string"), F.lit("")))


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(doc, field, term, pos): one row for each term of each field; symbols and white space are no terms. Nothing is shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")
    split = docs.select(F.col(id_col).alias("doc"), each).select("doc", "x.field", F.posexplode(terms_of(F.col("x.text"))).alias("pos", "term"))
    return split.select("doc", "field", "term", "pos")


def postings_of_terms(placed: DataFrame, id_col: str, field: str, column: str = "placed") -> DataFrame:
    """Postings of an analysed field from its terms with their positions, array<struct<term, pos>>."""
    each = placed.select(F.col(id_col).alias("doc"), F.explode(column).alias("x"))
    return each.select("doc", F.lit(field).alias("field"), "x.term", "x.pos")


def _word_table(hits: DataFrame, asked: list[Clause]) -> DataFrame:
    """A row for each word of each option of each part of each way of each clause, with how many of its kind are needed."""
    rows = [
        (c, w, len(way), p, o, len(set(option)), term)
        for c, asks in enumerate(asked)
        for w, way in enumerate(asks.ways())
        for p, part in enumerate(way)
        for o, option in enumerate(part)
        for term in dict.fromkeys(option)
    ]
    words = hits.sparkSession.createDataFrame(rows, "clause int, way int, parts int, part int, option int, need int, term string")
    return F.broadcast(words) if len(rows) <= QUERY_WORDS else words


def matches(postings_: DataFrame, asked: list[Clause], boosts: dict[str, float] | None = None) -> DataFrame:
    """(doc, score): documents for which every clause holds in some way.

    A word scores the greatest boost of the fields that have it; a way scores the sum of its words (of its parts' best
    options), a clause its best way, a document the sum of its clauses.
    """
    boost = F.lit(1.0)
    if boosts:
        postings_ = postings_.where(F.col("field").isin(list(boosts)))
        boost = F.element_at(F.create_map(*[x for f, b in boosts.items() for x in (F.lit(f), F.lit(b))]), F.col("field"))
    return held_clauses(postings_.select("doc", "term", boost.alias("s")), asked)


def held_clauses(hits: DataFrame, asked: list[Clause]) -> DataFrame:
    """(doc, score) of the documents whose ``hits(doc, term, s)`` let every clause hold; a word counts its greatest ``s``."""
    # Dealt by document once, for which all steps group.
    dealt = hits.join(_word_table(hits, asked), "term").repartition("doc")
    key = ["doc", "clause", "way", "parts"]
    words = dealt.groupBy(*key, "part", "option", "need", "term").agg(F.max("s").alias("s"))
    options = words.groupBy(*key, "part", "option", "need").agg(F.count("*").alias("n"), F.sum("s").alias("s")).where("n = need")
    parts = options.groupBy(*key, "part").agg(F.max("s").alias("s"))
    ways = parts.groupBy(*key).agg(F.count("*").alias("n"), F.sum("s").alias("s")).where("n = parts")
    held = ways.groupBy("doc", "clause").agg(F.max("s").alias("s"))
    return held.groupBy("doc").agg(F.count("*").alias("n"), F.sum("s").alias("score")).where(F.col("n") == len(asked)).select("doc", "score")


def bm25(postings_: DataFrame, words: list[str], n_docs: int | None = None) -> DataFrame:
    """(doc, score): Okapi BM25 of all documents with one of the words, over all their fields together.

    The postings are read once, for the lengths and the words' counts of each document; a stored index needs not even that.
    """
    words = list(dict.fromkeys(words))
    if not words:
        return postings_.select("doc", F.lit(0.0).alias("score")).where("false")
    counts = [F.count_if(F.col("term") == w).alias(f"tf{k}") for k, w in enumerate(words)]
    of_doc = staged(postings_.groupBy("doc").agg(F.count("*").alias("dl"), *counts))
    whole = of_doc.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))]).first()
    n = float(n_docs if n_docs is not None else whole["n"])
    average = whole["avgdl"] or 1.0
    score = F.lit(0.0)
    for k in range(len(words)):
        tf, df = F.col(f"tf{k}"), whole[f"df{k}"]
        score = score + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / average))
    some = reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(words))])
    return of_doc.where(some).select("doc", score.alias("score"))


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def page(hits: DataFrame, order: list[Column], start: int = 0, size: int = 20, names: list[str] | None = None) -> DataFrame:
    """``size`` rows from ``start`` on, with ``_rownum`` and, for the columns ``names``, their values as ``_sort``.

    The order should end in a unique column. Spark keeps only the first ``start + size`` rows of each task.
    """
    cut = hits.orderBy(*order).limit(start + size)
    nth = F.row_number().over(Window.orderBy(*order)) - 1  # of the rows of one result page
    out = cut.withColumn("_rownum", nth.cast("int")).where(F.col("_rownum") >= start)
    return out.withColumn("_sort", F.array(*[F.col(n).cast("string") for n in names])) if names else out


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The text, HTML-encoded, with the words marked in either case; without any of them as it is."""
    marked = sorted({w.upper() for w in words})
    encode = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pieces = runs(text)
    wrapped = F.transform(pieces, lambda t: F.when(fold(t).isin(marked), F.concat(F.lit(before), encode(t), F.lit(after))).otherwise(encode(t)))
    return F.when(F.exists(pieces, lambda t: fold(t).isin(marked)), F.array_join(wrapped, "")).otherwise(text)


def best_fragment(text: Column, words: list[str], size: int = 100, before: str = "<b>", after: str = "</b>") -> Column:
    """The piece of the text with the most different words, marked as ``highlight`` does; without any of them the whole text.

    Piece k has the runs that start from k * ``size`` on; of equal ones the first is taken, and blanks around it go.
    """
    marked = frozenset(w.translate(str.maketrans(LOWER, UPPER)) for w in words)
    folds = str.maketrans(LOWER, UPPER)
    escapes = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})

    def piece(found) -> str | None:
        held: dict[int, set[str]] = {}
        starts, at = [], 0
        for run in found:
            starts.append(at // size)
            key = run.translate(folds)
            if key in marked:
                held.setdefault(at // size, set()).add(key)
            at += len(run)
        if not held:
            return None
        best = min(held, key=lambda k: (-len(held[k]), k))
        chosen = (run for k, run in zip(starts, found) if k == best)
        return "".join(before + r.translate(escapes) + after if r.translate(folds) in marked else r.translate(escapes) for r in chosen).strip(" ")

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([None if found is None else piece(found) for found in rows], dtype=object)

    return F.coalesce(cut(runs(text)), text)


def many(tables: list[DataFrame]) -> DataFrame:
    """Several tables searched as one; columns that one lacks are null there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
