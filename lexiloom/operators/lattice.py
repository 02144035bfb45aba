"""Segmentation and analysis with dictionaries of any size: the dictionary is a table that is joined, not broadcast.

A dictionary table has a row (key, kind, score, values) for each folded key of each dictionary. Texts give the keys
that analysis may look up in them; one join finds those that exist, and each text is analysed with just these.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import dictionaries as d
from lexiloom.operators.rules import CONNECTORS, NUMBER_SYMBOLS, runs_of
from lexiloom.operators.segment import LONGEST, Dictionaries, best_path, fold, nodes
from lexiloom.sources.shared import staged

#: Dictionaries whose words are keys only, and those that have values.
_SETS, _MAPS = ("user", "stop", "unit"), ("space", "compound", "synonym", "unit_synonym")


def dictionary_table(source: DataFrame, system: DataFrame | None = None) -> DataFrame:
    """(key, kind, score, values) of all configured dictionaries of ``source`` rows; kind ``word`` holds the scored words.

    Their words count as nouns beside those of ``system(word, tag, prob)``. Of keys that are equal when folded the
    synonyms come together; else the least values stay.
    """
    built = {c.name: d.compile_dictionary(source, c) for c in d.CONFIGURED if c.kind not in ("SYSTEM", "CUSTOM")}
    words = system if system is not None else source.sparkSession.createDataFrame([], "word string, tag string, prob double")
    for config in d.CONFIGURED:
        if config.noun_score and config.name in built:
            words = d.inject_nouns(words, built[config.name].select("key"), config.noun_score)
    none = F.lit(None).cast("array<string>")
    parts = [words.where("tag <> 'J'").select(tx.fold(F.col("word")).alias("key"), F.lit("word").alias("kind"), F.col("prob").alias("score"), none.alias("values"))]
    for name in (*_SETS, *_MAPS):
        values = F.col("values") if name in _MAPS else none
        parts.append(built[name].select(tx.fold(F.col("key")).alias("key"), F.lit(name).alias("kind"), F.lit(None).cast("double").alias("score"), values.alias("values")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list("values"))))
    merged = rows.where("key <> ''").groupBy("key", "kind").agg(F.max("score").alias("score"), F.min("values").alias("least"), joined.alias("all"))
    return merged.select("key", "kind", "score", F.when(F.col("kind").isin("synonym", "unit_synonym"), F.col("all")).otherwise(F.col("least")).alias("values"))


def from_rows(rows: Iterable) -> Dictionaries:
    """Dictionaries of some rows of a dictionary table."""
    scores, keys, maps = {}, {name: set() for name in _SETS}, {name: {} for name in _MAPS}
    for row in rows:
        kind = row["kind"]
        if kind == "word":
            scores[row["key"]] = row["score"]
        elif kind in keys:
            keys[kind].add(row["key"])
        else:
            maps[kind][row["key"]] = tuple(row["values"])
    return Dictionaries(scores, *(frozenset(keys[name]) for name in _SETS), maps["space"], maps["compound"], maps["synonym"], maps["unit_synonym"])


def candidate_keys(text: str | None, longest: int) -> set[str]:
    """All folded keys of ``longest`` characters at most that the rules may look up for ``text``.

    Words start and end where the class of characters changes, anywhere within Hangul, and before an ``x`` that ends a
    run of letters. Beside the text's own pieces there are numbers without their commas, and what stands on both sides
    of a connector joined.
    """
    out: set[str] = set()
    for piece in re.findall(r"\S+", text or ""):
        found = runs_of(piece)
        cuts = {0, len(piece)}
        for e in found:
            cuts |= {e.start, e.stop}
            if e.kind == "HANGUL":
                cuts |= set(range(e.start, e.stop))
            elif e.kind == "ALPHA" and e.text[-1] in "xX":
                cuts.add(e.stop - 1)
        ordered = sorted(cuts)
        for k, start in enumerate(ordered):
            for stop in ordered[k + 1 :]:
                word = piece[start:stop]
                short = word.replace(",", "") if "," in word else word
                if len(short) > longest:
                    break
                if len(word) <= longest:
                    out.add(fold(word))
                out.add(fold(short))
        for k in range(1, len(found) - 1):
            if len(found[k].text) == 1 and found[k].text in CONNECTORS:
                for left in _sides(found[k - 1 :: -1], True):
                    for right in _sides(found[k + 1 :], False):
                        if len(left) + len(right) <= longest:
                            out |= {fold(left + right), fold((left + right).replace(",", ""))}
    return out


def _sides(found: list, backwards: bool) -> list[str]:
    """The run beside a connector, and that with the numbers it may be one number with."""
    sides, at = [found[0].text], 0
    while found[at].kind == "NUMBER" and at + 2 < len(found) and len(found[at + 1].text) == 1 and found[at + 1].text in NUMBER_SYMBOLS and found[at + 2].kind == "NUMBER":
        more = (found[at + 2].text + found[at + 1].text) if backwards else (found[at + 1].text + found[at + 2].text)
        sides.append(more + sides[-1] if backwards else sides[-1] + more)
        at += 2
    return sides


@dataclass(frozen=True)
class DictionaryTable:
    """Dictionaries that stay a table. ``longest`` is the length of its longest key, beyond which nothing is looked up."""

    table: DataFrame
    longest: int

    def of_text(self, text: str) -> Dictionaries:
        """What one text needs; its keys reach the scan as a filter."""
        found: list = []
        asked: set[str] = set()
        new = candidate_keys(text, self.longest)
        for _ in range(2):
            keys = sorted(new - asked)
            rows = self.table.where(F.col("key").isin(keys)).collect() if keys else []  # as many as the text has words
            found += rows
            asked |= new
            new = set().union(*(candidate_keys(v, self.longest) for r in rows if r["kind"] in ("compound", "synonym") for v in r["values"]))
        return from_rows(found)

    def lookups(self, texts: DataFrame) -> DataFrame:
        """(id, lookups): for each row of ``texts(id, text)`` the dictionary rows that its analysis may look up.

        What compounds and synonyms stand for is looked up as well. A key that many texts have has a few rows in the
        dictionary; Spark splits it where the join is skewed.
        """
        longest = self.longest

        @F.pandas_udf("array<string>")
        def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in parts:
                yield pd.Series([sorted(candidate_keys(t, longest)) for t in rows])

        found = texts.select("id", F.explode(keys("text")).alias("key")).join(self.table, "key")
        more = found.where(F.col("kind").isin("compound", "synonym")).select("id", F.explode(keys(F.array_join("values", " "))).alias("key")).distinct().join(self.table, "key")
        both = found.select("id", "key", "kind", "score", "values").unionByName(more.select("id", "key", "kind", "score", "values"))
        return both.groupBy("id").agg(F.collect_set(F.struct("key", "kind", "score", "values")).alias("lookups"))


def dictionary_of(source: DataFrame, system: DataFrame | None, rows: int) -> Dictionaries | DictionaryTable:
    """All dictionaries in memory if they have ``rows`` rows at most, else the table that holds them, written once."""
    table = staged(dictionary_table(source, system))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("key")), F.lit(0)).alias("longest")).first()
    return from_rows(table.collect()) if size["n"] <= rows else DictionaryTable(table, size["longest"])


def segments(chunks: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(chunk, words): the distinct texts of ``chunks(chunk)`` cut into the words of the best path.

    ``words(word, score)`` is joined once to the distinct substrings of all chunks, so it may have any size; what it
    has of a chunk's substrings comes together for that chunk, whose path is then found. Null chunks are left out; an
    empty one has no words.
    """
    distinct = chunks.select("chunk").where("chunk IS NOT NULL").distinct()
    n = F.length("chunk")
    starts = distinct.select("chunk", F.explode(F.sequence(F.lit(1), n)).alias("start")).where("chunk <> ''")
    pieces = starts.select("chunk", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start") + 1))).alias("size"))
    # The whole chunk is looked up too, however long it is.
    keyed = pieces.select("chunk", tx.fold(F.substr("chunk", "start", "size")).alias("key")).unionByName(distinct.select("chunk", tx.fold(F.col("chunk")).alias("key"))).distinct()
    scored = words.groupBy(tx.fold(F.col("word")).alias("key")).agg(F.max("score").alias("score"))
    edges = keyed.join(scored, "key").groupBy("chunk").agg(F.collect_list(F.struct("key", "score")).alias("edges"))

    @F.pandas_udf("array<string>")
    def path(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in parts:
            out = []
            for text, rows in zip(texts, found):
                score = {r["key"]: r["score"] for r in rows} if rows is not None else {}
                if not text or fold(text) in score:
                    out.append([text] if text else [])
                else:
                    out.append([text[a:b] for a, b, _ in best_path(text, nodes(text, score.get, longest), score.__contains__)])
            yield pd.Series(out)

    return distinct.join(edges, "chunk", "left").select("chunk", path("chunk", "edges").alias("words"))
