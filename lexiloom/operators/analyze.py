"""Analysis of text columns with broadcast dictionaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.lattice import DictionaryTable, dictionary_of, from_rows
from lexiloom.operators.rules import INDEX, Options, analyse, token_types
from lexiloom.operators.segment import Dictionaries

#: Dictionaries of more rows than this are not handed to the tasks but joined.
DICTIONARY_ROWS = 2_000_000
#: Tokens of so many characters of text are handed on at once, as they take some hundred times the memory.
HELD_CHARS = 200_000
#: Where rows are dealt out, a task gets some so many at least, as starting to analyse takes about as long as a few thousand.
DEALT_ROWS = 10_000

_EXTRA = "struct<term: string, type: string, synonyms: array<string>>"
TOKEN = f"struct<term: string, type: string, start: int, stop: int, pos_inc: int, synonyms: array<string>, extras: array<{_EXTRA}>>"


def load_dictionaries(source: DataFrame, system: DataFrame | None = None, rows: int = DICTIONARY_ROWS) -> Dictionaries | DictionaryTable:
    """All configured dictionaries of ``source`` rows, with their words as nouns beside those of ``system(word, tag, prob)``.

    Up to ``rows`` rows they are handed to the tasks; beyond, the texts' words are joined to them. Results are the same.
    """
    return dictionary_of(source, system, rows)


def _row(t) -> dict:
    """A token as a row of ``TOKEN``."""
    extras = [{"term": e.term, "type": e.type, "synonyms": e.synonyms} for e in t.extras]
    return {"term": t.term, "type": t.type, "start": t.start, "stop": t.stop, "pos_inc": t.pos_inc, "synonyms": t.synonyms, "extras": extras}


#: Terms with their positions only, as an index needs them.
PLACED = "struct<term: string, pos: int>"


def _placed(found: list) -> list[dict]:
    """Terms with positions; one with increment 0 shares the position before."""
    out, pos = [], -1
    for t in found:
        pos += t.pos_inc
        out.append({"term": t.term, "pos": pos})
    return out


def _whole(found: list) -> list[dict]:
    return [_row(t) for t in found]


def _counted(types: list[str]) -> list[dict]:
    return [{"type": kind, "times": n} for kind, n in Counter(types).items()]


def _in_slices(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in slices of some ``HELD_CHARS`` characters, one text at least."""
    sizes = texts.str.len().fillna(0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // HELD_CHARS)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        yield texts.iloc[a:b]


def _with(df: DataFrame, column: str, dictionaries: Dictionaries | DictionaryTable, options: Options, name: str, shape, kind: str, analyse=analyse, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with what ``shape`` makes of the tokens of a text column, which ``analyse`` finds, an array of ``kind``."""
    if isinstance(dictionaries, Dictionaries):
        if by:
            # Analysis takes far longer than reading, and a file's row group is read by one task.
            most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            df = df.hint("rebalance", max(1, min(most, df.count() // DEALT_ROWS)), *by, column)
        shared = df.sparkSession.sparkContext.broadcast(dictionaries)

        @F.pandas_udf(f"array<{kind}>")
        def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = shared.value
            for batch in parts:
                for texts in _in_slices(batch):
                    yield pd.Series([shape(analyse(text, known, options)) for text in texts], dtype=object)

        return df.withColumn(name, tokens(F.col(column)))
    # Texts are told apart by 128 bits; each is analysed once, however many rows have it.
    key = F.struct(F.xxhash64(F.lit(1), F.col(column)).alias("a"), F.xxhash64(F.lit(2), F.col(column)).alias("b"))
    texts = df.select(key.alias("id"), F.col(column).alias("text")).where("text IS NOT NULL").distinct()

    @F.pandas_udf(f"array<{kind}>")
    def looked_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, found in parts:
            yield pd.Series([shape(analyse(text, from_rows(f if f is not None else ()), options)) for text, f in zip(rows, found)])

    known = texts.join(dictionaries.lookups(texts), "id", "left").select(F.col("id").alias("__id"), looked_up("text", "lookups").alias(name))
    return df.join(known, key == F.col("__id"), "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>"))).drop("__id")


def with_tokens(df: DataFrame, column: str, dictionaries: Dictionaries | DictionaryTable, options: Options = INDEX, name: str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the tokens of a text column. A null text has none.

    With columns ``by``, rows are first dealt out to tasks of even size by these and the text; they should tell rows apart, or nearly so.
    """
    return _with(df, column, dictionaries, options, name, _whole, TOKEN, by=by)


def with_placed_terms(df: DataFrame, column: str, dictionaries: Dictionaries | DictionaryTable, options: Options = INDEX, name: str = "placed") -> DataFrame:
    """``df`` with only the terms of a text column and their positions."""
    return _with(df, column, dictionaries, options, name, _placed, PLACED)


def with_type_counts(df: DataFrame, column: str, dictionaries: Dictionaries | DictionaryTable, options: Options = INDEX, name: str = "types") -> DataFrame:
    """``df`` with how many tokens of each type a text column has, as array<struct<type, times>>."""
    return _with(df, column, dictionaries, options, name, _counted, "struct<type: string, times: long>", token_types)


def register_udtf(spark: SparkSession, dictionaries: Dictionaries, name: str = "analyze_text") -> None:
    """A table function for SQL: ``SELECT * FROM analyze_text('text', true)`` with a row for each token."""
    shared = dictionaries

    class AnalyzeText:
        def eval(self, text: str, for_query: bool):
            for t in analyse(text, shared, Options(for_query=bool(for_query))):
                yield t.term, t.type, t.start, t.stop, t.pos_inc, t.synonyms

    table_function = F.udtf(AnalyzeText, returnType="term: string, type: string, start: int, stop: int, pos_inc: int, synonyms: array<string>")
    spark.udtf.register(name, table_function)


def detail_sets(tokens: Column) -> Column:
    """The tokens of a query sorted into named sets: stop words, model names, units, others, synonyms, compounds, and all final terms."""
    of = lambda *kinds: F.transform(F.filter(tokens, lambda t: t["type"].isin(*kinds)), lambda t: t["term"])
    parts = F.flatten(F.transform(tokens, lambda t: F.transform(t["extras"], lambda e: e["term"])))
    synonyms = F.array_distinct(F.flatten(F.transform(tokens, lambda t: t["synonyms"])))
    other = F.transform(F.filter(tokens, lambda t: ~t["type"].isin("FULL_STRING", "STOPWORD", "MODEL_NAME", "UNIT", "COMPOUND")), lambda t: t["term"])
    terms = F.transform(F.filter(tokens, lambda t: t["type"] != "FULL_STRING"), lambda t: t["term"])
    return F.struct(
        of("FULL_STRING").alias("full"),
        of("STOPWORD").alias("stop"),
        of("MODEL_NAME").alias("model"),
        of("UNIT").alias("unit"),
        other.alias("normal"),
        synonyms.alias("synonym"),
        of("COMPOUND").alias("compound"),
        F.array_distinct(F.concat(terms, parts, synonyms)).alias("final"),
    )
