"""The library's surface: analysis, dictionaries, ingest and search as functions of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import analyze as a
from lexiloom.operators import dictionaries as d
from lexiloom.operators.lattice import DictionaryTable
from lexiloom.operators.rules import HIGHLIGHT, SEARCH, Options, analyse
from lexiloom.operators.segment import Dictionaries
from lexiloom.plans import index as ix
from lexiloom.plans import queries as q
from lexiloom.plans import search as s
from lexiloom.sources import records


@dataclass
class Engine:
    """Dictionaries in use; ``reload`` replaces them."""

    spark: SparkSession
    dictionaries: Dictionaries | DictionaryTable

    def _for(self, text: str) -> Dictionaries:
        """The dictionaries as one text needs them, in memory."""
        return self.dictionaries if isinstance(self.dictionaries, Dictionaries) else self.dictionaries.of_text(text)

    # -- analysis ---------------------------------------------------------

    def analyze(self, df: DataFrame, column: str, for_query: bool = True, synonyms: bool = True, drop_stop: bool = False, full_string: bool = True, by: Sequence[str] = ()) -> DataFrame:
        """``df`` with ``tokens`` and, in ``detail``, the named sets of them. Rows are first dealt out to tasks by columns ``by``, if there are any."""
        options = Options(for_query=for_query, synonyms=synonyms, drop_stop=drop_stop, full_string=full_string)
        return a.with_tokens(df, column, self.dictionaries, options, by=by).withColumn("detail", a.detail_sets(F.col("tokens")))

    def multi_analyze(self, df: DataFrame, fields: str = "fields") -> DataFrame:
        """``terms``: for each key of a map column its value's index terms; keys without any go."""
        # Rows are told apart by what they hold, so that a task that runs again finds the same.
        entries = F.array_sort(F.map_entries(fields))
        key = F.struct(F.xxhash64(F.lit(1), entries).alias("a"), F.xxhash64(F.lit(2), entries).alias("b"))
        split = df.select(key.alias("row"), F.col(fields).alias("fields")).dropDuplicates(["row"]).select("row", F.explode("fields").alias("key", "text"))
        told = a.with_tokens(split, "text", self.dictionaries, Options(drop_stop=False)).withColumn("terms", F.transform("tokens", lambda t: t["term"]))
        maps = told.where("size(terms) > 0").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "terms"))).alias("terms"))
        return df.join(maps, key == F.col("row"), "left").drop("row")

    def expand_keywords(self, text: str, drop_stop: bool = True, synonyms: bool = True) -> list[dict]:
        """What a search for ``text`` asks for: each term with its synonyms and parts."""
        return [_as_dict(t) for t in analyse(text, self._for(text), Options(for_query=True, synonyms=synonyms, drop_stop=drop_stop, full_string=True))]

    def synonyms(self, keyword: str) -> list[str]:
        """The synonyms of the token that is the whole keyword."""
        return next((t.synonyms for t in analyse(keyword, self._for(keyword), replace(SEARCH, drop_stop=False)) if t.term == keyword), [])

    # -- search -----------------------------------------------------------

    def clauses(self, text: str) -> list[q.Clause]:
        return q.clauses([_as_dict(t) for t in analyse(text, self._for(text), replace(SEARCH, full_string=True))])

    def build_query(self, fields: str, text: str, analyzer: str = "whitespace") -> dict:
        return {"query": q.query_json(self.clauses(text), [f.strip() for f in fields.split(",")], analyzer)}

    def explain(self, text: str) -> dict:
        """The words that a search for ``text`` asks for, as a tree of AND and OR."""
        return q.explain(self.clauses(text))

    def total(self, postings: DataFrame | ix.StoredIndex, fields: str, text: str) -> int:
        """How many rows hold all of ``text``'s terms."""
        return s.total(_matches(postings, self.clauses(text), q.parse_fields(fields))).first()["total"]

    def store(self, df: DataFrame, id_col: str, fields: list[str], path: str) -> ix.StoredIndex:
        """The analysed fields as an index stored under ``path``; searches of it score by relevance."""
        return ix.write_index(self.index(df, id_col, fields), path, df.count())

    def index(self, df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
        """Postings of the analysed fields, with parts at their term's position."""
        parts = [s.postings_of_terms(a.with_placed_terms(df.select(id_col, F.col(f).cast("string").alias("text")), "text", self.dictionaries), id_col, f) for f in fields]
        return s.many(parts)

    def search(
        self,
        table: DataFrame,
        postings: DataFrame | ix.StoredIndex,
        id_col: str,
        fields: str,
        text: str,
        query: dict | None = None,
        sort: list[Column] | None = None,
        start: int = 0,
        size: int = 20,
        highlight: dict | None = None,
    ) -> DataFrame:
        """A page of the rows that hold all of ``text``'s terms.

        Postings of a stored index score by BM25 in each word's best field; a table of postings has no statistics, so
        there each word scores its field's boost.
        ``query`` is a user's function_score, whose filters and weights apply. If its inner query
        is no bool, that takes the place of the terms.
        ``highlight`` has fields, and pre_tags and post_tags as lists of one; with fragment_size only the best fragment is shown.
        """
        rows = table.where(q.merge_user_query(F.lit(True), query))
        if q.replaces_analysed(query):
            rows = rows.withColumn("score", q.constant_score(query["function_score"].get("query", {})))
        else:
            found = _matches(postings, self.clauses(text), q.parse_fields(fields))
            rows = rows.join(found, F.col(id_col) == F.col("doc")).drop("doc")
        if query and "function_score" in query:
            rows = rows.withColumn("score", q.function_score(F.col("score"), query["function_score"]))
        out = s.page(rows, sort or [F.col("score").desc(), F.col(id_col)], start, size)
        if highlight:
            words = sorted({t.term for t in analyse(text, self._for(text), replace(HIGHLIGHT, uppercase=True))})
            before, after = highlight.get("pre_tags", ["<b>"])[0], highlight.get("post_tags", ["</b>"])[0]
            size = highlight.get("fragment_size")
            for name in highlight["fields"]:
                if name != "_all":
                    marked = s.best_fragment(F.col(name), words, size, before, after) if size else s.highlight(F.col(name), words, before, after)
                    out = out.withColumn(name, marked)
        return out

    # -- dictionaries -----------------------------------------------------

    def reload(self, source: DataFrame, system: DataFrame | None = None) -> None:
        self.dictionaries = a.load_dictionaries(source, system)

    def is_loaded(self) -> bool:
        return isinstance(self.dictionaries, DictionaryTable) or bool(self.dictionaries.words or self.dictionaries.units)


def _matches(postings: DataFrame | ix.StoredIndex, asked: list[q.Clause], boosts: dict[str, float]) -> DataFrame:
    return postings.matches(asked, boosts) if isinstance(postings, ix.StoredIndex) else s.matches(postings, asked, boosts)


def _as_dict(t) -> dict:
    return {"term": t.term, "type": t.type, "synonyms": t.synonyms, "extras": [{"term": e.term, "type": e.type, "synonyms": e.synonyms} for e in t.extras]}


def engine(source: DataFrame, system: DataFrame | None = None, rows: int = a.DICTIONARY_ROWS) -> Engine:
    """Up to ``rows`` rows the dictionaries are handed to the tasks, beyond they are joined."""
    return Engine(source.sparkSession, a.load_dictionaries(source, system, rows))


def compile_dictionaries(source: DataFrame, log: DataFrame, types: str | None, applied_time: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The built tables of the comma-listed types, or of all, and the apply log with their rows counted."""
    names = {t.strip().lower() for t in types.split(",")} if types else None
    chosen = [c for c in d.CONFIGURED if c.kind != "SYSTEM" and (names is None or c.name in names)]
    built = {c.name: d.compile_dictionary(source, c) for c in chosen}
    counts = source.where(F.col("type").isin([c.name.upper() for c in chosen])).groupBy(F.col("type").alias("id")).agg(F.count("*").alias("count"))
    return built, d.upsert_log(log, counts.withColumn("applied_time", F.lit(applied_time)))


def dict_info(source: DataFrame, log: DataFrame) -> DataFrame:
    """Each configured dictionary with its number of rows and when it was last applied."""
    return d.dictionary_info(source, log)


def dict_find(source: DataFrame, word: str, system: DataFrame | None = None) -> DataFrame:
    """(type, keyword, value, tag, prob): the system words and the source rows that have ``word``."""
    rows = d.find_word(source, word).select("type", "keyword", "value")
    if system is None:
        return rows.select("*", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("prob"))
    words = system.where(F.col("word") == word).select(F.lit("SYSTEM").alias("type"), F.col("word").alias("keyword"), "tag", "prob")
    return words.unionByName(rows, allowMissingColumns=True).select("type", "keyword", "value", "tag", "prob")


def save_dictionaries(built: dict[str, DataFrame], path: str) -> None:
    for name, table in built.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def restore_dictionaries(built: dict[str, DataFrame]) -> DataFrame:
    """Source rows of all built tables; what a table can't tell (ids) is null."""
    configs = {c.name: c for c in d.CONFIGURED}
    return s.many([d.restore_rows(table, configs[name]).withColumn("id", F.lit(None).cast("string")) for name, table in built.items()])


def restore_table(built: dict[str, DataFrame], path: str) -> DataFrame:
    """The source rows of all built tables, written to ``path`` in place of what is there."""
    restore_dictionaries(built).select("id", "keyword", "value", "type").write.mode("overwrite").parquet(path)
    return next(iter(built.values())).sparkSession.read.parquet(path)


def compile_system(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """The system words (word, tag, prob) of text files, written to ``target``.

    Files named like ``01.N.HIGH.txt`` give tag and score by their name, others in the second and third column.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    named = F.element_at(F.split("path", "/"), -1).rlike(r"^[^.]+\.[^.]+\.[^.]+\.txt$")
    words = d.best_scores(d.words_by_file(lines.where(named)).unionByName(d.scored_words(lines.where(~named).select("value"))))
    words.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def ingest_text(spark: SparkSession, paths: list[str], target: str, schema: dict[str, str], charset: str = "EUC-KR", flush: int = 50_000) -> None:
    """Record files into a table; files whose first line has no key are left out whole."""
    lines = records.accepted_lines(spark, paths, charset)
    records.append_table(records.typed_records(records.parse_records(lines), schema), target, flush)


def ingest_pages(spark: SparkSession, url: str, target: str, schema: dict[str, str], start: int = 1, length: int = 1000) -> None:
    """A paged HTTP source into a table."""
    from lexiloom.sources.pages import PagedJsonSource

    spark.dataSource.register(PagedJsonSource)
    rows = spark.read.format("paged_json").option("url", url).option("start", start).option("length", length).load()
    records.append_table(records.typed_records(rows, schema), target)
