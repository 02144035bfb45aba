"""Secret scans: all rules in one minimal automaton, one byte pass over each text."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Scanner, chars, either, literal, many, maybe, seq
from .common import read_table

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), string.digits.encode()
_WORD = _UPPER + _LOWER + _DIGITS
_VALUE = chars(_WORD + b"+/_.=-")
_QUOTE, _SPACES = maybe(chars(b"\"'")), many(chars(b" "))
_NAME = either(
    *[literal(w, any_case=True) for w in (b"password", b"passwd", b"secret", b"token")],
    seq(literal(b"api", any_case=True), maybe(chars(b"_")), literal(b"key", any_case=True)),
)

#: The base kinds, in the order in which equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")

_RUN = chars(_WORD + b"_-")

#: Kind: rule, and the characters that a match needs (of its value, for ``assign``). Shorter
#: matches are dropped after they took up their text. Only ``hex`` has its length in the rule,
#: since it would end a match in every other word; counting inside the rules that have a prefix
#: would multiply the states.
RULES = {
    "assign": (seq(_NAME, _QUOTE, _SPACES, chars(b":="), _SPACES, _QUOTE, many(_VALUE, 1)), 6),
    "access": (seq(literal(b"AKIA"), many(chars(_UPPER + _DIGITS), 1)), 20),
    "hex": (many(chars(_DIGITS + b"abcdef"), 24), 24),
    "github": (seq(literal(b"gh"), chars(b"pousr"), literal(b"_"), many(chars(_WORD), 1)), 40),
    "slack": (seq(literal(b"xox"), chars(b"abprs"), literal(b"-"), many(chars(_WORD + b"-"), 1)), 15),
    "google": (seq(literal(b"AIza"), many(_RUN, 1)), 39),
    "private_key": (seq(literal(b"-----BEGIN "), many(chars(_UPPER + b" ")), literal(b"PRIVATE KEY-----")), 0),
}


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """Compiled once for each worker."""
    return Scanner([rule for rule, _ in RULES.values()])


def _length(kind: str, match: bytes) -> int:
    """The length that counts: of an ``assign`` match, what follows the first colon or equals sign."""
    if kind != "assign":
        return len(match)
    cut = min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0)
    rest = match[cut + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def find_secrets(texts: list[str | None]) -> list[list[tuple[int, str, int]]]:
    """For each text the (start, kind, end) of its secrets, in code points with the end exclusive."""
    kinds = list(RULES)
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    out = []
    for raw, spans in zip(data, scanner().scan(data)):
        kept = [(s, kinds[r], e) for s, r, e in spans if _length(kinds[r], raw[s:e]) >= RULES[kinds[r]][1]]
        if kept and not raw.isascii():
            at = lambda k: len(raw[:k].decode("utf-8", "replace"))
            kept = [(at(s), kind, at(e)) for s, kind, e in kept]
        out.append(kept)
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``secrets``: an array of (start, kind, stop), by start, then by kind as in ``RULES``.

    Null and empty texts have an empty array. Every row and column stays; a
    column that is already called ``secrets`` is replaced.
    """

    @F.pandas_udf("array<struct<start: int, kind: string, stop: int>>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = find_secrets(texts.tolist())
            yield pd.Series([[{"start": s, "kind": k, "stop": e} for s, k, e in spans] for spans in found])

    return docs.withColumn("secrets", scan("text"))


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's characters in ``text`` replaced by ``mark``; overlapping ones become one mark."""

    @F.pandas_udf("string")
    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for text, spans in zip(texts, find_secrets(texts.tolist())):
                if text is None or not spans:
                    out.append(text)
                    continue
                pieces, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        pieces += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*pieces, text[at:]]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", mask("text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
