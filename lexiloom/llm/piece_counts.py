"""Token counts of whole texts under a sentencepiece model, without shuffling a word.

No piece of such a model holds the space mark after another character, so no
merge reaches over the start of a run of spaces: the pre-tokens, each a run of
spaces and what follows, are encoded apart and their lengths add up. The
driver learns a table of frequent pre-tokens from a bounded sample of rows and
broadcasts it, packed; what the table lacks is encoded once in a worker and
kept in that worker's cache.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import plain_columns, read_table, release_memory
from .packing import pack_ints, pack_strings, unpack_ints, unpack_strings

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: The mark that stands for a space in the pieces; in a text it counts as one.
MARK = "▁"
#: The table is learnt from so many rows at most, of each so many characters from a place that varies, and keeps so
#: many pre-tokens. This bounds the broadcast; lengths never depend on it.
SAMPLE_ROWS, SAMPLE_CHARS, TABLE_SIZE = 2_000, 4_000, 1 << 16
#: A worker's cache holds so many pre-tokens of so many characters; longer ones are encoded where they stand.
CACHE_SIZE, CACHED_CHARS = 500_000, 64
_PRE_TOKEN = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a whole text, each without the first of its spaces.

    The model puts one space before a text, so every pre-token has one; an
    empty text has none at all.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [t[1:] for t in _PRE_TOKEN.findall(" " + text)]


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table at first, then also what was encoded since."""

    def __init__(self, model: bytes, known: dict[str, int]):
        super().__init__(known)
        self.known = known
        self.encode = SentencePieceProcessor(model_proto=model).encode
        # The library gives nothing for an empty text, so a lone space is what a last one adds.
        self.lone = len(self.encode("x ")) - len(self.encode("x"))

    def __missing__(self, token: str) -> int:
        n = len(self.encode(token)) if token else self.lone
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE + len(self.known):
                self.clear()
                self.update(self.known)
            self[token] = n
        return n


def token_count(text: str | None, lengths: Lengths) -> int:
    """The number of tokens of a whole text; a null one counts as empty."""
    return sum(map(lengths.__getitem__, pre_tokens(text))) if text else 0


def frequent_lengths(docs: DataFrame, model: bytes) -> bytes:
    """The packed table of pre-tokens that occur twice or more in the sample, the most frequent first."""
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = docs.where("text IS NOT NULL").select(F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).take(SAMPLE_ROWS)
    counts = Counter(t for row in rows for t in pre_tokens(row["text"]) if len(t) <= CACHED_CHARS)
    chosen = [t for t, n in counts.most_common(TABLE_SIZE) if n > 1]
    lengths = Lengths(model, {})
    strings = pack_strings([t.encode("utf-8", "surrogatepass") for t in chosen])
    return len(strings).to_bytes(8, "little") + strings + pack_ints([lengths[t] for t in chosen])


def unpacked(table: bytes) -> dict[str, int]:
    cut = 8 + int.from_bytes(table[:8], "little")
    words = [w.decode("utf-8", "surrogatepass") for w in unpack_strings(table[8:cut])]
    return dict(zip(words, unpack_ints(table[cut:]).tolist()))


#: The lengths that a worker holds, of one run only.
_HELD: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    Texts are counted whole, as the library would give their ids without begin and end tokens; control strings in
    them are plain characters. Null and empty texts have 0 bytes and 0 tokens. Repeated rows get a row each, and an
    empty table gives none. ``model_path`` is read by the driver only; workers get the model's bytes.
    """
    plain = plain_columns(docs, "doc_id", "text")
    with open(model_path, "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(plain, model)))
    run = uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if run not in _HELD:
            _HELD.clear()
            model_bytes, table = shared.value
            _HELD[run] = Lengths(model_bytes, unpacked(table))
        lengths = _HELD[run]
        for texts in parts:
            yield pd.Series([token_count(t, lengths) for t in texts], dtype="int64")
        release_memory()

    counted = plain.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
