"""Character classes and string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Class name: Java character class. A run is a longest piece of one class; what no class names is UNCATEGORIZED.
CLASSES = {
    "HANGUL": "가-힣",
    "HANGUL_JAMO": "ㄱ-ㆎ",
    "JAPANESE": "\u3040-\u30ff",
    "CHINESE": "\u4e00-\u9fff",
    "OTHER_LANGUAGE": "\\p{Lo}&&[^가-힣ㄱ-ㆎ\u3040-\u30ff\u4e00-\u9fff]",
    "ALPHA": "\\p{Lu}\\p{Ll}",
    "NUMBER": "\\p{Nd}",
    "SYMBOL": "\\p{P}\\p{S}",
    "WHITESPACE": "\\p{javaWhitespace}",
}
_REST = "[^" + "".join(f"[{c}]" for c in CLASSES.values()) + "]"
RUN_PATTERN = "|".join([*(f"[{c}]+" for c in CLASSES.values()), f"{_REST}+"])

_NUMBER_PART = r"([0-9]{0,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)*"
NUMBER_PATTERN = f"^{_NUMBER_PART}(:{_NUMBER_PART})?$"


def char_class(text: Column) -> Column:
    """The class of the first character of ``text``; null for an empty text."""
    out = F.when(text == "", F.lit(None))
    for name, members in CLASSES.items():
        out = out.when(text.rlike(f"^[{members}]"), F.lit(name))
    return out.otherwise(F.lit("UNCATEGORIZED"))


def uniform_class(text: Column) -> Column:
    """The class that all characters share, else UNCATEGORIZED."""
    out = F.when(F.lit(False), F.lit(""))
    for name, members in CLASSES.items():
        out = out.when(text.rlike(f"^[{members}]+$"), F.lit(name))
    return out.otherwise(F.lit("UNCATEGORIZED"))


def term_type(text: Column) -> Column:
    """The class of a term: letters with digits are ALPHANUM; symbols after a letter or digit make it ASCII.

    A term that begins with a symbol and holds other classes is UNCATEGORIZED, as is any other mix.
    """
    alnum = r"[\p{Lu}\p{Ll}\p{Nd}]"
    return (
        F.when(text.rlike(f"^{alnum}+$") & text.rlike(r"\p{Nd}") & text.rlike(r"[\p{Lu}\p{Ll}]"), F.lit("ALPHANUM"))
        .when(text.rlike(rf"^{alnum}[\p{{Lu}}\p{{Ll}}\p{{Nd}}\p{{P}}\p{{S}}]*$") & text.rlike(r"[\p{P}\p{S}]"), F.lit("ASCII"))
        .otherwise(uniform_class(text))
    )


def is_alnum(text: Column) -> Column:
    return text.rlike(r"^[\p{Lu}\p{Ll}\p{Nd}]+$")


def is_number(text: Column) -> Column:
    """Plain, grouped by commas, with fractions, and ratios of two such numbers; the empty text too."""
    return text.rlike(NUMBER_PATTERN)


def contains_any(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")) < F.length(text)


def is_split_char(text: Column) -> Column:
    return text.rlike(r"^[\p{javaWhitespace}\p{P}\p{S}]$")


def fold(text: Column) -> Column:
    """The key under which dictionary lookups ignore case: only a to z are folded."""
    return F.translate(text, LOWER, UPPER)


def remove_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def has_spaces(text: Column) -> Column:
    return F.contains(text, F.lit(" "))


def split_spaces(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def sub_sequence(text: Column, start: int, end_inclusive: int) -> Column:
    """Characters from ``start`` up to and with ``end_inclusive``, counted from 0."""
    return F.substring(text, start + 1, end_inclusive - start + 1)


def strip_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def emphasis(text: Column, template: str = "<strong>${TEXT}</strong>") -> Column:
    before, _, after = template.partition("${TEXT}")
    return F.concat(F.lit(before), text, F.lit(after))


def full_string(text: Column) -> Column:
    """The text without trailing blanks if that has 1 to 63 characters, else null."""
    cut = F.rtrim(text)
    return F.when(F.length(cut).between(1, 63), cut)


def runs(text: Column) -> Column:
    """All runs of one class in order, white space included."""
    return F.regexp_extract_all(text, F.lit(f"({RUN_PATTERN})"), F.lit(1))


#: Classes that may share characters with symbols, and come first.
_RANGES = "".join(CLASSES[c] for c in ("HANGUL", "HANGUL_JAMO", "JAPANESE", "CHINESE"))
#: Runs of symbols and of white space are passed over; letters, which no class before has, are tried first.
_WORD_PATTERN = (
    f"(?:(?![{_RANGES}])[{CLASSES['SYMBOL']}]+|[{CLASSES['WHITESPACE']}]+)*+"
    + "(" + "|".join([*(f"[{CLASSES[c]}]+" for c in ("ALPHA", *(c for c in CLASSES if c not in ("ALPHA", "SYMBOL", "WHITESPACE")))), f"{_REST}+"]) + ")"
)


def word_runs(text: Column) -> Column:
    """The runs other than those of the classes SYMBOL and WHITESPACE, and maybe runs of symbols of other classes that are none of ``runs``."""
    return F.regexp_extract_all(text, F.lit(_WORD_PATTERN), F.lit(1))


def typed_runs(text: Column) -> Column:
    """array<struct<term, type, start, stop>> of the runs other than white space, for product-style texts of moderate length."""
    placed = F.aggregate(
        runs(text),
        F.struct(F.array().cast("array<struct<term:string,start:int,stop:int>>").alias("out"), F.lit(0).alias("at")),
        lambda a, t: F.struct(
            F.array_append(a["out"], F.struct(t.alias("term"), a["at"].alias("start"), (a["at"] + F.length(t)).alias("stop"))).alias("out"),
            (a["at"] + F.length(t)).alias("at"),
        ),
        lambda a: a["out"],
    )
    typed = F.transform(placed, lambda t: F.struct(t["term"].alias("term"), char_class(t["term"]).alias("type"), t["start"].alias("start"), t["stop"].alias("stop")))
    return F.filter(typed, lambda t: t["type"] != "WHITESPACE")


def url_path(url: Column) -> Column:
    """An address without its parameters and fragment."""
    return F.regexp_extract(url, "^[^?#]*", 0)


def url_query(url: Column) -> Column:
    """An address from its question mark on, with percent codes decoded; a plus sign stays, and what can't be decoded is null."""
    return F.try_url_decode(F.replace(F.regexp_extract(url, "[?].*", 0), F.lit("+"), F.lit("%2B")))


def connected_chunks(text: Column) -> Column:
    """Chunks of ASCII letters and digits joined by single connectors, in order."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+(?:[-./&][A-Za-z0-9]+)*)"), F.lit(1))


def letters_and_digits(chunk: Column) -> Column:
    """Whether a chunk may be a model name: it has both."""
    return chunk.rlike("[0-9]") & chunk.rlike("[A-Za-z]")
