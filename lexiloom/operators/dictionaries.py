"""Word dictionaries as tables.

Source rows are (id, keyword, value, type). What is built from them are tables
of keys and values; lookups are joins on the folded key (``fold``). Every
function takes and returns DataFrames, so a dictionary may be as large as any
other table; analysis broadcasts one only where it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import fold, remove_spaces, split_spaces
from lexiloom.sources.shared import staged

#: Log-probabilities of nouns by the name that a dictionary is configured with; other names add no nouns.
NOUN_SCORES = {"MAX": -5.0, "HIGH": -8.0, "MID": -13.0, "MIN": -16.0}


@dataclass(frozen=True)
class DictionaryConfig:
    name: str
    kind: str
    noun_score: str | None = None


# The configured dictionaries.
CONFIGURED = (
    DictionaryConfig("product", "SYSTEM"),
    DictionaryConfig("user", "SET", "MAX"),
    DictionaryConfig("synonym", "SYNONYM"),
    DictionaryConfig("stop", "SET", "MAX"),
    DictionaryConfig("space", "SPACE", "MIN"),
    DictionaryConfig("compound", "COMPOUND", "MID"),
    DictionaryConfig("unit", "SET", "HIGH"),
    DictionaryConfig("unit_synonym", "SYNONYM_2WAY", "HIGH"),
    DictionaryConfig("maker", "CUSTOM"),
    DictionaryConfig("brand", "CUSTOM"),
    DictionaryConfig("category", "CUSTOM"),
    DictionaryConfig("english", "SET", "MAX"),
)


def of_type(source: DataFrame, name: str) -> DataFrame:
    """The source rows of one dictionary; the filter reaches the scan."""
    return source.where(F.col("type") == name.upper())


def _items(value: Column) -> Column:
    return F.array_remove(F.transform(F.split(value, ","), lambda v: F.trim(v)), "")


def build_set(source: DataFrame) -> DataFrame:
    """(key): trimmed words without spaces, each once."""
    return source.select(remove_spaces(F.trim("keyword")).alias("key")).where("key <> ''").distinct()


def build_map(source: DataFrame) -> DataFrame:
    """(key, values): of several rows with a key the one with the greatest id stays; rows without a key go."""
    rows = source.where(F.col("keyword").isNotNull()).select(remove_spaces(F.trim("keyword")).alias("key"), _items("value").alias("values"), "id")
    return rows.groupBy("key").agg(F.max_by("values", "id").alias("values"))


def synonym_pairs(source: DataFrame) -> DataFrame:
    """(word, synonym), each once. With a keyword a row maps it, and its form without spaces, to its values; without one its values map to each other."""
    keyed = source.where(F.trim(F.coalesce("keyword", F.lit(""))) != "").select(F.trim("keyword").alias("k"), _items("value").alias("vs"))
    one_way = keyed.select(F.explode(F.array_distinct(F.array("k", remove_spaces(F.col("k"))))).alias("word"), "vs").select("word", F.explode("vs").alias("synonym"))
    loose = source.where(F.trim(F.coalesce("keyword", F.lit(""))) == "").select(_items("value").alias("vs"))
    two_way = loose.select(F.explode("vs").alias("word"), "vs").select("word", F.explode("vs").alias("synonym"))
    return one_way.unionByName(two_way).where("word <> synonym").distinct()


def build_synonyms(source: DataFrame) -> DataFrame:
    """(key, values): the synonyms of each word, sorted, each once."""
    return synonym_pairs(source).groupBy(F.col("word").alias("key")).agg(F.array_sort(F.collect_set("synonym")).alias("values"))


def word_set(source: DataFrame) -> DataFrame:
    """(word): all words of synonym rows, and the parts of those with spaces."""
    words = source.select(F.explode(F.concat(F.array(F.trim(F.coalesce("keyword", F.lit("")))), _items(F.coalesce("value", F.lit(""))))).alias("w"))
    return words.select(F.explode(F.concat(F.array("w"), split_spaces(F.col("w")))).alias("word")).where("word <> ''").distinct()


def build_space(source: DataFrame) -> DataFrame:
    """(key, values): a phrase's form without white space, and its parts."""
    spaced = source.select(F.trim("keyword").alias("k"))
    return spaced.select(F.regexp_replace("k", r"\s", "").alias("key"), F.array_remove(F.split("k", r"\s+"), "").alias("values")).where("key <> ''").distinct()


def build_compound(source: DataFrame) -> DataFrame:
    """(key, values): a word and its parts; rows without values build nothing."""
    rows = source.where(F.col("keyword").isNotNull()).select(F.trim("keyword").alias("key"), _items("value").alias("values"))
    return rows.where("key <> '' AND size(values) > 0").distinct()


def build_custom(source: DataFrame) -> DataFrame:
    """(key, id, values): words that stand for an id."""
    return source.select(F.trim("keyword").alias("key"), "id", _items(F.coalesce("value", F.lit(""))).alias("values")).where("key <> ''")


def invert(built: DataFrame) -> DataFrame:
    """(key, values) with the keys of each value as its values."""
    each = built.select("key", F.explode("values").alias("value"))
    return each.groupBy(F.col("value").alias("key")).agg(F.array_sort(F.collect_set("key")).alias("values"))


def scored_words(lines: DataFrame) -> DataFrame:
    """(word, tag, prob) from lines of word, tag and score separated by tabs.

    Comments and blank lines go, as do tags of no known group. One-character
    nouns never score above the least; other one-character words go. Of a word
    and tag the best score stays.
    """
    parts = lines.where(~F.col("value").rlike(r"^\s*(#|//|$)")).select(F.split("value", "\t").alias("p")).where("size(p) >= 3")
    tag = F.get("p", F.lit(1))
    group = F.when(tag.startswith("N"), "N").when(tag.startswith("V"), "V").when(tag.startswith("M"), "M").when(tag.startswith("IC"), "IC").when(tag.startswith("J"), "J").when(tag.startswith("E"), "E").when(tag.startswith("XPN"), "XPN")
    words = parts.select(F.get("p", F.lit(0)).alias("word"), group.alias("tag"), F.get("p", F.lit(2)).cast("double").alias("prob")).where("tag IS NOT NULL AND prob IS NOT NULL AND word <> ''")
    single = F.length("word") == 1
    words = words.where(~single | (F.col("tag") == "N")).withColumn("prob", F.when(single & (F.col("prob") > -13), F.lit(-16.0)).otherwise(F.col("prob")))
    return best_scores(words)


def words_by_file(lines: DataFrame) -> DataFrame:
    """(word, tag, prob) of files whose names, as in ``01.N.HIGH.txt``, give tag and score; ``lines`` has value and path."""
    named = lines.withColumn("name", F.split(F.element_at(F.split("path", "/"), -1), r"\."))
    scores = F.create_map(*[x for k, v in {**NOUN_SCORES, "P11": -11.0, "P12": -12.0, "LOW": -14.0}.items() for x in (F.lit(k), F.lit(v))])
    rows = named.select(F.trim("value").alias("word"), F.element_at("name", 2).alias("tag"), F.coalesce(F.try_element_at(scores, F.element_at("name", 3)), F.lit(-16.0)).alias("prob"))
    return best_scores(rows.where("word <> '' AND NOT word LIKE '#%'"))


def best_scores(words: DataFrame) -> DataFrame:
    return words.groupBy("word", "tag").agg(F.max("prob").alias("prob"))


def inject_nouns(system: DataFrame, words: DataFrame, noun_score: str) -> DataFrame:
    """``system`` with ``words`` as nouns of the named score; a better score replaces a worse one."""
    if noun_score not in NOUN_SCORES:
        return system
    nouns = words.select(F.col("key").alias("word"), F.lit("N").alias("tag"), F.lit(NOUN_SCORES[noun_score]).alias("prob"))
    return best_scores(system.unionByName(nouns))


def lookup(words: DataFrame, built: DataFrame, word: str = "word") -> DataFrame:
    """``words`` left-joined to a dictionary, ignoring the case of a to z."""
    keyed = built.select(fold(F.col("key")).alias("__key"), *[c for c in built.columns if c != "key"])
    return words.join(keyed, fold(F.col(word)) == F.col("__key"), "left").drop("__key")


def mutual_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (word, synonym) that hold both ways."""
    back = pairs.select(F.col("synonym").alias("word"), F.col("word").alias("synonym"))
    return pairs.join(back, ["word", "synonym"], "left_semi")


def two_way_sets(pairs: DataFrame) -> DataFrame:
    """(word, words): each word with those it reaches over its synonyms that name it in turn; words alone have no row.

    Reaching goes on over words that were added, so it takes as many rounds as the longest chain. Each round joins
    only the pairs that the one before found, and writes what it adds.
    """
    pairs = staged(pairs.select("word", "synonym").distinct())
    naming = pairs.select(F.col("synonym").alias("word"), F.col("word").alias("other"))
    new = staged(pairs.withColumnRenamed("synonym", "other").join(naming, ["word", "other"], "left_semi").select("word", "other"))
    found = new
    while not new.isEmpty():
        on = new.alias("f").join(pairs.alias("p"), F.col("f.other") == F.col("p.word")).select(F.col("f.word").alias("word"), F.col("p.synonym").alias("other"))
        grown = on.where("word <> other").distinct().join(naming, ["word", "other"], "left_semi")
        new = staged(grown.join(found, ["word", "other"], "left_anti").select("word", "other"))
        found = found.unionByName(new)
    return found.groupBy("word").agg(F.array_sort(F.concat(F.collect_set("other"), F.array(F.first("word")))).alias("words"))


def mutual_cliques(built: DataFrame) -> DataFrame:
    """(key, values) of keys that all other keys of ``built`` name; values that are no keys go."""
    keys = built.select("key")
    each = built.select("key", F.explode("values").alias("value")).join(keys.select(F.col("key").alias("value")), "value", "left_semi")
    named = each.where("key <> value").groupBy(F.col("value").alias("key")).agg(F.countDistinct("key").alias("times"))
    others = keys.agg((F.count("*") - 1).alias("times"))
    kept = named.join(F.broadcast(others), "times").select("key")  # ``others`` is one row
    values = each.join(kept, "key", "left_semi").join(kept.select(F.col("key").alias("value")), "value", "left_semi")
    return values.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def one_way_words(pairs: DataFrame) -> DataFrame:
    """(word): words with a synonym that does not name them in turn."""
    back = pairs.select(F.col("synonym").alias("word"), F.col("word").alias("synonym"))
    return pairs.join(back, ["word", "synonym"], "left_anti").select("word").distinct()


def dictionary_info(source: DataFrame, apply_log: DataFrame, config: tuple[DictionaryConfig, ...] = CONFIGURED) -> DataFrame:
    """(name, kind, count, applied_time, applied_count) of each configured dictionary."""
    spark = source.sparkSession
    named = spark.createDataFrame([(c.name.upper(), c.kind) for c in config], "name string, kind string")
    counts = source.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("count"))
    log = apply_log.select(F.col("id").alias("name"), F.col("applied_time"), F.col("count").alias("applied_count"))
    joined = named.join(counts, "name", "left").join(log, "name", "left")
    return joined.select("name", "kind", F.coalesce("count", F.lit(0)).alias("count"), "applied_time", F.coalesce("applied_count", F.lit(0)).cast("long").alias("applied_count"))


def find_word(source: DataFrame, word: str) -> DataFrame:
    """The source rows that have ``word`` as keyword or among their values."""
    return source.where((F.col("keyword") == word) | F.array_contains(_items(F.coalesce("value", F.lit(""))), word))


def difference(left: DataFrame, right: DataFrame, shorter_than: int = 8) -> DataFrame:
    """(key): words of ``left`` that ``right`` has not, below a length."""
    return left.join(right, "key", "left_anti").where(F.length("key") < shorter_than).select("key").distinct()


def upsert_log(log: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, applied_time, count): the latest row of each id."""
    latest = Window.partitionBy("id").orderBy(F.col("applied_time").desc(), F.col("count").desc())
    rows = log.select("id", "applied_time", "count").unionByName(updates.select("id", "applied_time", "count"))
    return rows.withColumn("__nth", F.row_number().over(latest)).where("__nth = 1").drop("__nth")


def compile_dictionary(source: DataFrame, config: DictionaryConfig) -> DataFrame:
    """The built table of one configured dictionary."""
    rows = of_type(source, config.name)
    builders = {"SET": build_set, "MAP": build_map, "SYNONYM": build_synonyms, "SYNONYM_2WAY": build_synonyms, "SPACE": build_space, "COMPOUND": build_compound, "CUSTOM": build_custom}
    if config.kind == "INVERT_MAP":
        return invert(build_map(rows))
    if config.kind not in builders:
        raise ValueError(f"a {config.kind} dictionary is not built from source rows")
    return builders[config.kind](rows)


def restore_rows(built: DataFrame, config: DictionaryConfig) -> DataFrame:
    """Source rows (keyword, value, type) of a built table. Synonyms that hold both ways come back as one row without keyword."""
    name = F.lit(config.name.upper()).alias("type")
    if config.kind == "SET":
        return built.select(F.col("key").alias("keyword"), F.lit(None).cast("string").alias("value"), name)
    if config.kind == "SPACE":
        return built.select(F.concat_ws(" ", "values").alias("keyword"), F.lit(None).cast("string").alias("value"), name)
    if config.kind in ("SYNONYM", "SYNONYM_2WAY"):
        pairs = built.select(F.col("key").alias("word"), F.explode("values").alias("synonym"))
        sets = two_way_sets(pairs).select(F.concat_ws(",", "words").alias("value")).distinct()
        back = pairs.select(F.col("synonym").alias("word"), F.col("word").alias("synonym"))
        single = pairs.join(back, ["word", "synonym"], "left_anti").groupBy("word").agg(F.array_sort(F.collect_set("synonym")).alias("vs"))
        one_way = single.select(F.col("word").alias("keyword"), F.concat_ws(",", "vs").alias("value"), name)
        return sets.select(F.lit(None).cast("string").alias("keyword"), "value", name).unionByName(one_way)
    return built.select(F.col("key").alias("keyword"), F.concat_ws(",", "values").alias("value"), name)
