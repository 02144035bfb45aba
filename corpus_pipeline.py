"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes the documents that the one before kept, as a table read
back from Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.bpe import token_digests
from lexiloom.llm.common import stage
from lexiloom.llm.decontaminate import drop_contaminated
from lexiloom.llm.lines import dedup_lines
from lexiloom.llm.quality import keep_good
from lexiloom.llm.simhash import near_dedup

#: Words of a shingle and least percent of similarity in the near-dedup stage.
NEAR = (5, 80)
#: Characters of a block in the last stage, which shares its executors' memory with what the stages before left.
BLOCK_CHARS = 2_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    Null and empty texts have no words and go; a null language is one of its own. Equal rows stay or go together.
    """
    return keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are taken out of the texts; every document stays.

    The first occurrence is that of the least id, then place. Null texts stay null; a text that is one copy too many
    becomes empty. ``n_chars`` follows the text.
    """
    cleaned = dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: within three bits, or with 80 % of all five-word shingles in common.

    It is the one of the least id, null ids last. Texts without words are one group. Rows equal in id and text stay or go together.
    """
    return near_dedup(docs, similar=NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter one, go.

    Null texts and items have no words and match nothing. Equal rows stay or go together.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, after a round trip through the ids.

    Null texts count as empty. Every row gets one, repeated rows too.
    """
    return token_digests(docs, block_chars=BLOCK_CHARS)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontaminate_stage),
    ("bpe", bpe_stage),
]
#: The model's bands, fingerprints and ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
