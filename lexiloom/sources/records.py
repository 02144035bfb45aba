"""Product records: text files of ``[%KEY%]value`` lines, and pages of JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"\[%([a-zA-Z0-9_-]+)%\]"
_KEY_ALONE = r"\[%[a-zA-Z0-9_-]+%\]"
DATE_FIELD, DATE_FORMAT = "REGISTERDATE", "yyyyMMdd"


def read_lines(spark: SparkSession, paths: list[str], charset: str = "UTF-8") -> DataFrame:
    """(value): the lines of all files below ``paths``. Other charsets than UTF-8 need ``spark.sql.legacy.javaCharsets``."""
    return _lines(spark, paths, charset).select("value")


def _lines(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """(value, file, start, nth): lines with their file, the start of the block that they were read in, and a number that grows within it."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")]
    if charset.upper() in ("UTF-8", "UTF8"):
        return spark.read.option("recursiveFileLookup", True).text(paths).select("value", *place)
    if charset.upper().startswith(("UTF-16", "UTF-32")):  # their line ends can't be told from bytes
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        each = files.select(F.posexplode(F.split(F.decode("content", charset), "\r?\n")).alias("nth", "value"), F.col("path").alias("file"))
        return each.select("value", "file", F.lit(0).cast("long").alias("start"), F.col("nth").cast("long").alias("nth"))
    # A file of one column whose separator never occurs: such files are split over tasks. Empty lines are left out.
    whole = spark.read.schema("value string").option("encoding", charset).option("recursiveFileLookup", True)
    return whole.options(sep="\x01", quote="", escape="", mode="PERMISSIVE", emptyValue="", nullValue="\x01").csv(paths).select("value", *place)


def accepted_lines(spark: SparkSession, paths: list[str], charset: str = "UTF-8") -> DataFrame:
    """(value): the lines of the files whose first line has a key; other files are left out whole.

    A file's first line is the first of the block that starts at 0, so files that are split over tasks are judged
    alike. In charsets other than Unicode ones empty lines are not seen, so there it is the first line with text.
    """
    lines = _lines(spark, paths, charset)
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "nth").alias("first"))
    refused = first.where(~F.coalesce(F.col("first"), F.lit("")).rlike(KEY)).select("file")
    return lines.join(refused, "file", "left_anti").select("value")


def parse_record(line: Column) -> Column:
    """map<string, string> of a line; the last of a repeated key wins. A line without a key gives an empty map."""
    keys = F.regexp_extract_all(line, F.lit(KEY), F.lit(1))
    return _last_wins(keys, F.slice(F.split(line, _KEY_ALONE), 2, F.size(keys)))


def _last_wins(keys: Column, values: Column) -> Column:
    """A map of the two arrays. Only where a key is repeated, which map_from_arrays refuses, are the last ones sought."""
    pairs = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))
    unique = F.array_distinct(F.reverse(keys))
    chosen = F.transform(unique, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"])
    return F.when(F.size(unique) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(unique, chosen))


def parse_records(lines: DataFrame) -> DataFrame:
    """(fields): records of ``lines(value)``; lines that hold no key are no records."""
    split = lines.where(F.col("value").rlike(KEY)).select("value", F.regexp_extract_all("value", F.lit(KEY), F.lit(1)).alias("keys"))
    split = split.select("keys", F.slice(F.split("value", _KEY_ALONE), 2, F.size("keys")).alias("values"))
    return split.select(_last_wins(F.col("keys"), F.col("values")).alias("fields"))


def typed_columns(schema: dict[str, str]) -> list[Column]:
    """The fields of ``schema`` (name: type) from a map ``fields``. The date field is read as yyyyMMdd; what can't be cast is null."""
    columns = []
    for name, kind in schema.items():
        value = F.try_element_at("fields", F.lit(name))
        if name == DATE_FIELD or kind == "timestamp":
            columns.append(F.try_to_timestamp(F.nullif(value, F.lit("")), F.lit(DATE_FORMAT)).alias(name))
        else:
            columns.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return columns


def typed_records(records: DataFrame, schema: dict[str, str]) -> DataFrame:
    """One column for each field of ``schema``."""
    return records.select(*typed_columns(schema))


def write_record(columns: list[str]) -> Column:
    """A line of ``[%KEY%]value`` pairs in the given order; tabs, line ends and NUL become spaces, nulls are empty."""
    parts = [F.concat(F.lit(f"[%{c}%]"), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n\x00]", " ")) for c in columns]
    return F.concat(*parts)


def export_text(df: DataFrame, path: str, columns: list[str] | None = None, charset: str = "UTF-8") -> None:
    df.select(write_record(columns or df.columns).alias("value")).write.option("encoding", charset).option("lineSep", "\r\n").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(fields): the results of landed JSON pages {total_count, fieldname_list, result: [{...}]}."""
    pages = spark.read.schema("total_count long, fieldname_list array<string>, result array<map<string,string>>").option("multiLine", True).json(path)
    return pages.select(F.explode("result").alias("fields"))


def read_dictionary_lines(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """(id, keyword, value, type): the rows of UTF-8 files with a keyword, or a keyword, a tab and values, in each line.

    A line that begins with a tab has values only. Comments after ``#`` or ``//`` and blank lines are left out; the id
    tells the file and the place of a line in it, so that of lines with one keyword the last can be told.
    """
    lines = _lines(spark, paths, "UTF-8").where(~F.col("value").rlike(r"^\s*(#|//|$)"))
    parts = F.split("value", "\t", 2)
    name = F.element_at(F.split("file", "/"), -1)
    place = F.concat(name, F.lit(":"), F.lpad("start", 15, "0"), F.lit(":"), F.lpad(F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)).cast("string"), 10, "0"))
    keyword = F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit(""))
    return lines.select(place.alias("id"), keyword.alias("keyword"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("value"), F.lit(kind.upper()).alias("type"))


def append_table(df: DataFrame, path: str, rows_a_file: int = 50_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_a_file).parquet(path)


def delete_all(spark: SparkSession, path: str) -> None:
    """An empty table of the same schema in place of the one at ``path``."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
