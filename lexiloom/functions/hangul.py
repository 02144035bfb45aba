"""Hangul syllables and their elements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The elements in the order of the Unicode syllable block.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, LAST = 0xAC00, 0xD7A3


def _offset(char: Column) -> Column:
    return F.ascii(char) - FIRST


def is_syllable(char: Column) -> Column:
    return F.ascii(char).between(FIRST, LAST)


def _at(elements: str, index: Column) -> Column:
    return F.substr(F.lit(elements), (index + 1).cast("int"), F.lit(1))


def initial(char: Column) -> Column:
    return F.when(is_syllable(char), _at(INITIALS, F.floor(_offset(char) / (21 * 28))))


def medial(char: Column) -> Column:
    return F.when(is_syllable(char), _at(MEDIALS, F.floor((_offset(char) % (21 * 28)) / 28)))


def final_code(char: Column) -> Column:
    """0 where a syllable has no final element."""
    return F.when(is_syllable(char), _offset(char) % 28)


def has_final(char: Column) -> Column:
    return F.coalesce(final_code(char) > 0, F.lit(False))


def final(char: Column) -> Column:
    return F.when(final_code(char) > 0, _at(FINALS, final_code(char) - 1))


def decompose(text: Column) -> Column:
    """The text with every syllable written as its elements."""
    each = F.transform(F.split(text, ""), lambda c: F.when(is_syllable(c), F.concat(initial(c), medial(c), F.coalesce(final(c), F.lit("")))).otherwise(c))
    return F.array_join(each, "")


def compose(initial_: Column, medial_: Column, final_: Column | None = None) -> Column:
    """The syllable of its elements; null if one is not an element of its place."""
    a, b = F.instr(F.lit(INITIALS), initial_), F.instr(F.lit(MEDIALS), medial_)
    c = F.when(final_ == "", F.lit(0)).otherwise(F.instr(F.lit(FINALS), final_)) if final_ is not None else F.lit(0)
    code = F.lit(FIRST) + (a - 1) * (21 * 28) + (b - 1) * 28 + c
    # Three UTF-8 bytes, as chr() knows single bytes only.
    as_hex = F.lpad(F.hex((F.lit(0xE08080) + F.floor(code / 4096).cast("long") * 65536 + (F.floor(code / 64) % 64).cast("long") * 256 + (code % 64).cast("long"))), 6, "0")
    return F.when((a > 0) & (b > 0), F.decode(F.unhex(as_hex), "UTF-8"))
