"""Words in unspaced text: the best path through a lattice of typed nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lexiloom.functions.text import LOWER, UPPER

_FOLD = str.maketrans(LOWER, UPPER)
#: Longest node.
LONGEST = 20
# Scores of the kinds of nodes.
UNKNOWN, PARTICLE, DIGIT, ALPHA, SYMBOL = -16.0, -13.0, -8.0, -8.0, -16.0

# Particles of one or two syllables, and those that depend on a final consonant before them.
PARTICLES = frozenset("은 는 이 가 을 를 에 과 와 의 로 만 께 에게 에서 으로 부터 라서 라고 께서 한테 처럼 같이 라는 하며 하고 까지".split())
AFTER_FINAL, AFTER_VOWEL = frozenset("은이을과"), frozenset("는가를와")


def fold(word: str) -> str:
    return word.translate(_FOLD)


def has_final(char: str) -> bool:
    return "가" <= char <= "힣" and (ord(char) - 0xAC00) % 28 > 0


@dataclass(frozen=True)
class Dictionaries:
    """The dictionaries that analysis looks into. Keys are folded; values keep their case."""

    words: dict[str, float] = field(default_factory=dict)
    user: frozenset[str] = frozenset()
    stop: frozenset[str] = frozenset()
    units: frozenset[str] = frozenset()
    space: dict[str, tuple[str, ...]] = field(default_factory=dict)
    compound: dict[str, tuple[str, ...]] = field(default_factory=dict)
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unit_synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: What analysis keeps of pieces that it has met; no part of the dictionaries' value.
    pieces: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": {}}

    def known(self, word: str) -> bool:
        return fold(word) in self.words or fold(word) in self.user

    def score(self, key: str) -> float | None:
        """The score of a folded word, or None where no dictionary has it."""
        return self.words.get(key, -5.0 if key in self.user else None)


def _particle(text: str, start: int, stop: int) -> bool:
    """Whether a particle stands there: behind something, and with a final consonant before it or without one as it demands."""
    word = text[start:stop]
    if start == 0 or word not in PARTICLES:
        return False
    final = has_final(text[start - 1])
    return not (word in AFTER_FINAL and not final or word in AFTER_VOWEL and final)


def _class_of(char: str) -> str | None:
    if char.isdecimal():
        return "DIGIT"
    if char.isalpha():
        return "ALPHA" if char.isascii() else None
    return "SYMBOL"


def nodes(text: str, score: Callable[[str], float | None], longest: int = LONGEST) -> list[list[tuple[int, str, float]]]:
    """For each place the nodes that end there, as (start, tag, score), the longest first.

    A word of the dictionary is a node, and so are a particle, a run of digits, of ASCII letters or of symbols, and any
    single character that is none of these.
    """
    kinds = [_class_of(c) for c in text]
    ends: list[list[tuple[int, str, float]]] = [[] for _ in range(len(text) + 1)]
    for stop in range(1, len(text) + 1):
        same = True
        for start in range(stop - 1, max(0, stop - longest) - 1, -1):
            same = same and kinds[start] is not None and kinds[start] == kinds[stop - 1]
            found = score(fold(text[start:stop]))
            if found is not None:
                ends[stop].append((start, "WORD", found))
            elif stop - start <= 2 and _particle(text, start, stop):
                ends[stop].append((start, "PARTICLE", PARTICLE))
            if same:
                ends[stop].append((start, kinds[start], {"DIGIT": DIGIT, "ALPHA": ALPHA, "SYMBOL": SYMBOL}[kinds[start]]))
            elif found is None and start == stop - 1 and not ends[stop]:
                ends[stop].append((start, "UNKNOWN", 2 * UNKNOWN))
        ends[stop].reverse()
    return ends


def best_path(text: str, ends: list[list[tuple[int, str, float]]], paired: Callable[[str], bool]) -> list[tuple[int, int, bool]]:
    """(start, stop, known) of the best path's words; neighbouring unknown characters are one word.

    Of equal kind, digits, letters or symbols never follow each other, so each run is one node. Two words of one
    character don't where both together are a word, which ``paired`` tells. A path of several one-character words
    must end in a particle; if there is no other the whole text is one unknown word.
    """
    n = len(text)
    # For each place and state (last tag, last of one character, all of one character): score, previous place, previous state.
    best: list[dict[tuple, tuple]] = [{("START", False, True): (0.0, 0, None)}, *({} for _ in range(n))]
    for stop in range(1, n + 1):
        here = best[stop]
        for start, tag, score in ends[stop]:
            one = stop - start == 1
            for state, (before, _, _) in best[start].items():
                last, last_one, ones = state
                if tag == last and tag in ("DIGIT", "ALPHA", "SYMBOL"):
                    continue
                if one and last_one and tag == last == "WORD" and paired(fold(text[start - 1 : stop])):
                    continue
                new = (tag, one, ones and one)
                total = before + score
                if new not in here or total > here[new][0]:
                    here[new] = (total, start, state)
    whole = [(total, state) for state, (total, _, _) in best[n].items() if not (state[2] and n > 1 and state[0] in ("WORD", "UNKNOWN"))]
    if not whole:
        return [(0, n, False)]
    # Of equal paths the one whose last state sorts first.
    state = min(whole, key=lambda x: (-x[0], x[1]))[1]
    path, at = [], n
    while at:
        _, start, before = best[at][state]
        path.append((start, at, state[0] != "UNKNOWN"))
        at, state = start, before
    merged: list[tuple[int, int, bool]] = []
    for start, stop, known in reversed(path):
        if merged and not known and not merged[-1][2]:
            merged[-1] = (merged[-1][0], stop, False)
        else:
            merged.append((start, stop, known))
    return merged


def segment(text: str, d: Dictionaries, longest: int = LONGEST) -> list[tuple[int, int, bool]]:
    """(start, stop, known) of the words of ``text``, in order.

    A text that is a word of the dictionary stays whole. Else the path of the greatest sum of scores is taken, whole:
    there is no queue limit and no early end.
    """
    if not text:
        return []
    if d.known(text):
        return [(0, len(text), True)]
    return best_path(text, nodes(text, d.score, longest), lambda pair: d.score(pair) is not None)
