"""Compiled dictionaries in versions: only changed keys are compiled anew, a version counts once its manifest is there.

Under ``path`` lie ``sources/<version>`` (the source rows of that version), ``tables/<name>/<version>`` and
``manifests/<version>``, which is written last: a row for each dictionary with the folder of its table, its number of
source rows and when it was applied. Readers take the greatest version that has a manifest, so one that was broken off
is never seen, and any earlier one can be read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.functions.text import remove_spaces
from lexiloom.operators import dictionaries as d

SOURCE = "id string, keyword string, value string, type string"
MANIFEST = "version long, name string, folder string, count long, applied_time string"
LOG = "id string, applied_time string, count long"


def row_keys(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with each ``key`` of the built dictionary that a source row has a part in."""
    keyword = F.trim(F.coalesce("keyword", F.lit("")))
    values = F.transform(F.split(F.coalesce("value", F.lit("")), ","), lambda v: F.trim(v))
    keys = {
        "SET": F.array(remove_spaces(keyword)),
        "MAP": F.array(remove_spaces(keyword)),
        "SPACE": F.array(F.regexp_replace(keyword, r"\s", "")),
        "COMPOUND": F.array(keyword),
        "CUSTOM": F.array(keyword),
    }.get(kind, F.when(keyword != "", F.array(keyword, remove_spaces(keyword))).otherwise(values))
    return rows.select("*", F.explode(F.array_distinct(keys)).alias("key"))


def recompiled(built: DataFrame, before: DataFrame, now: DataFrame, config: d.DictionaryConfig) -> DataFrame:
    """The dictionary of the source rows ``now``, from ``built``, which is that of the rows ``before``.

    Keys of rows that came or went are built from all rows that have a part in them; all other keys stay as they are.
    """
    before, now = (d.of_type(rows, config.name).select("id", "keyword", "value", "type") for rows in (before, now))
    changed = before.exceptAll(now).unionByName(now.exceptAll(before))
    affected = row_keys(changed, config.kind).select("key").distinct()
    touching = row_keys(now, config.kind).join(affected, "key", "left_semi").drop("key")
    fresh = d.compile_dictionary(touching, config).join(affected, "key", "left_semi")
    return built.join(affected, "key", "left_anti").unionByName(fresh)


@dataclass(frozen=True)
class DictionaryStore:
    spark: SparkSession
    path: str

    def manifests(self) -> DataFrame:
        """(version, name, folder, count, applied_time) of all complete versions."""
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifests")

    def version(self) -> int | None:
        """The current version, or None before the first."""
        try:
            return self.manifests().agg(F.max("version").alias("v")).first()["v"]
        except Exception as error:  # the folder comes with the first version
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def compile(self, source: DataFrame, applied_time: str, names: set[str] | None = None) -> int:
        """A new version for ``source(id, keyword, value, type)``; of the dictionaries ``names`` only, or of all.

        Dictionaries that are not named, or whose rows have not changed, keep the table that they have.
        """
        current = self.version()
        new = 1 if current is None else current + 1
        now = source.select("id", "keyword", "value", "type")
        held = {r["name"]: r for r in self.manifests().where(F.col("version") == current).collect()} if current else {}  # a row for each dictionary
        chosen = [c for c in d.CONFIGURED if c.kind != "SYSTEM" and (names is None or c.name in names or c.name not in held)]
        kinds = [c.name.upper() for c in chosen]
        if held and names is not None:
            # What is not compiled stays as it was, in the source as well.
            now = now.where(F.col("type").isin(kinds)).unionByName(self.source().where(~F.col("type").isin(kinds)))
        now.write.mode("overwrite").parquet(f"{self.path}/sources/{new}")
        now = self._source_of(new)
        counts = {r["type"]: r["count"] for r in now.groupBy("type").count().collect()}
        rows = [(new, name, r["folder"], r["count"], r["applied_time"]) for name, r in held.items() if name not in {c.name for c in chosen}]
        for config in chosen:
            folder = f"tables/{config.name}/{new}"
            if config.name in held:
                before = self._source_of(current)
                if self._same(before, now, config.name):
                    rows.append((new, config.name, held[config.name]["folder"], held[config.name]["count"], applied_time))
                    continue
                table = recompiled(self.spark.read.parquet(f"{self.path}/{held[config.name]['folder']}"), before, now, config)
            else:
                table = d.compile_dictionary(now, config)
            table.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            rows.append((new, config.name, folder, counts.get(config.name.upper(), 0), applied_time))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{new}")
        return new

    def _source_of(self, version: int) -> DataFrame:
        return self.spark.read.schema(SOURCE).parquet(f"{self.path}/sources/{version}")

    @staticmethod
    def _same(before: DataFrame, now: DataFrame, name: str) -> bool:
        """Whether a dictionary's rows are the same, by their number and two sums of hashes."""
        row = F.struct("id", "keyword", "value")
        digest = [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)).alias("x"), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("s")]
        return d.of_type(before, name).agg(*digest).first() == d.of_type(now, name).agg(*digest).first()

    def source(self, version: int | None = None) -> DataFrame:
        """The source rows of a version, ids included; of the current one by default."""
        return self._source_of(version or self._needed())

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The built dictionaries of a version; of the current one by default."""
        chosen = version or self._needed()
        rows = self.manifests().where(F.col("version") == chosen).collect()
        return {r["name"]: self.spark.read.parquet(f"{self.path}/{r['folder']}") for r in rows}

    def _needed(self) -> int:
        version = self.version()
        if version is None:
            raise ValueError(f"no dictionaries have been compiled to {self.path}")
        return version

    def log(self) -> DataFrame:
        """(id, applied_time, count): when each dictionary was last applied."""
        rows = self.manifests().select(F.upper("name").alias("id"), "applied_time", "count")
        return d.upsert_log(rows.where("false"), rows)

    def restore(self, version: int, applied_time: str) -> int:
        """A new version with the rows of an earlier one."""
        return self.compile(self.source(version), applied_time)


def log_stream(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each id of a stream ``updates(id, applied_time, count)`` as tables ``path``/<batch>.

    A batch that runs again writes the same table again; readers take the greatest batch (``read_log``).
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(LOG).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], LOG)
        d.upsert_log(before, batch).write.mode("overwrite").parquet(f"{path}/{number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(id, applied_time, count) after the last batch of ``log_stream``."""
    rows = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path).select("*", F.regexp_extract("_metadata.file_path", r"/(\d+)/[^/]*$", 1).cast("long").alias("batch"))
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("id", "applied_time", "count")  # ``last`` is one row
