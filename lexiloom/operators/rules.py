"""Typed tokens of product names: numbers, units, model names with their parts, compounds.

A name is cut at white space; each piece goes through the same steps. Class
runs become entries; dictionary words that span runs are joined; digits with
``, . :`` between them become one number; numbers take a unit; letters and
numbers joined by single connectors become a model name with parts. Symbols
that are left go. Offsets count characters of the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from lexiloom.functions.text import NUMBER_PATTERN
from lexiloom.operators.segment import Dictionaries, fold, segment

# Fixed values.
CONNECTORS, NUMBER_SYMBOLS = "-./&", ",.:"
LONGEST_UNIT, LONG_NUMBER, JOINED_RUNS, SHORT_WORD = 10, 5, 10, 3

_NUMBER = re.compile(NUMBER_PATTERN)
_LEADING_NUMBER = re.compile(r"\d[\d,.:]*")
_RUN = re.compile(r"(?P<HANGUL>[가-힣]+)|(?P<HANGUL_JAMO>[ㄱ-ㆎ]+)|(?P<JAPANESE>[぀-ヿ]+)|(?P<CHINESE>[一-鿿]+)|(?P<NUMBER>\d+)|(?P<ALPHA>[^\W\d_]+?(?=[가-힣ㄱ-ㆎ぀-ヿ一-鿿\W\d_]|$))|(?P<SYMBOL>[^\w\s]+|_+)|(?P<UNCATEGORIZED>\S)")


@dataclass(frozen=True)
class Entry:
    text: str
    kind: str
    start: int
    stop: int
    parts: tuple["Entry", ...] = ()
    number: "Entry | None" = None
    frozen: bool = False


@dataclass(frozen=True)
class Options:
    """How a text is analysed: for an index, or for a query with synonyms and parts beside each term."""

    for_query: bool = False
    synonyms: bool = True
    drop_stop: bool = True
    full_string: bool = False
    uppercase: bool = False


# The presets of the different uses.
INDEX, SEARCH = Options(), Options(for_query=True)
HIGHLIGHT = Options(synonyms=False, uppercase=True)


def _runs(piece: str, at: int) -> list[Entry]:
    return [Entry(m[0], m.lastgroup, at + m.start(), at + m.end()) for m in _RUN.finditer(piece)]


def runs_of(piece: str) -> list[Entry]:
    """The class runs of a piece without white space, with offsets in it."""
    return _runs(piece, 0)


def _joined(entries: list[Entry], kind: str, **more) -> Entry:
    return Entry("".join(e.text for e in entries), kind, entries[0].start, entries[-1].stop, **more)


def _spaced(word: Entry, d: Dictionaries) -> list[Entry]:
    """The parts of a word that is written with spaces elsewhere."""
    parts, at = [], word.start
    for part in d.space[fold(word.text)]:
        parts.append(Entry(part, "HANGUL", at, at + len(part), frozen=True))
        at += len(part)
    return parts


def _known_words(entries: list[Entry], d: Dictionaries) -> list[Entry]:
    """Longest first, neighbouring runs that are a dictionary word together; then the words inside Hangul runs."""
    out, k = [], 0
    while k < len(entries):
        for n in range(min(JOINED_RUNS + 1, len(entries) - k), 1, -1):
            word = _joined(entries[k : k + n], "HANGUL")
            key = fold(word.text)
            if key in d.space:
                out += _spaced(word, d)
                break
            if key in d.stop or d.known(word.text):
                out.append(replace(word, frozen=key in d.stop))
                break
        else:
            out.append(entries[k])
            n = 1
        k += n
    split = []
    for e in out:
        if e.kind == "HANGUL" and not e.frozen and fold(e.text) in d.space:
            split += _spaced(e, d)
        elif e.kind != "HANGUL" or e.frozen or d.known(e.text):
            split.append(e)
        else:
            split += [Entry(e.text[a:b], "HANGUL", e.start + a, e.start + b) for a, b, _ in segment(e.text, d)]
    return split


def _adjoins(entries: list[Entry], k: int) -> bool:
    """Whether letters, digits or symbols touch entry ``k``."""
    around = [e for e in (entries[k - 1] if k else None, entries[k + 1] if k + 1 < len(entries) else None) if e is not None]
    return any(e.kind in ("ALPHA", "NUMBER", "SYMBOL") and (e.stop == entries[k].start or e.start == entries[k].stop) for e in around)


def _retyped(entries: list[Entry], d: Dictionaries) -> list[Entry]:
    """Dictionary words that are no plain words.

    One that begins with a number and ends in a unit is these two. A short one of letters and digits which is no user
    word falls apart where such characters touch it; any other short one is typed by its characters.
    """
    out: list[Entry] = []
    for k, e in enumerate(entries):
        if e.kind != "HANGUL" or e.frozen:
            out.append(e)
            continue
        number = _LEADING_NUMBER.match(e.text)
        if number:
            unit = e.text[number.end() :]
            if unit and fold(unit) in d.units:
                at = e.start + number.end()
                pieces = _runs(unit, at)
                out.append(Entry(number[0], "NUMBER" if number[0].isdecimal() else "NUMBER_TRANS", e.start, at))
                out.append(Entry(unit, pieces[0].kind if len(pieces) == 1 else "UNCATEGORIZED", at, e.stop))
                continue
        elif len(e.text) <= SHORT_WORD:
            kinds = {r.kind for r in _runs(e.text, 0)}
            if kinds <= {"ALPHA", "NUMBER"} and fold(e.text) not in d.user:
                out += _runs(e.text, e.start) if _adjoins(entries, k) else [e]
                continue
            if kinds <= {"ALPHA", "NUMBER", "SYMBOL"} and "ALPHA" in kinds:
                e = replace(e, kind="ALPHA" if kinds == {"ALPHA"} else "MODEL_NAME")
        out.append(e)
    return out


def _far_eastern(entries: list[Entry]) -> list[Entry]:
    """Chinese characters that touch kana are Japanese, and one word with them."""
    out: list[Entry] = []
    for e in entries:
        both = {out[-1].kind, e.kind} if out and out[-1].stop == e.start else set()
        if "JAPANESE" in both and both <= {"JAPANESE", "CHINESE"}:
            out[-1] = _joined([out[-1], e], "JAPANESE")
        else:
            out.append(e)
    return out


def _numbers(entries: list[Entry]) -> list[Entry]:
    """Numbers with single ``, . :`` between them are one if the whole reads as a number."""
    out, k = [], 0
    while k < len(entries):
        n = 1
        if entries[k].kind == "NUMBER":
            while k + n + 1 < len(entries) and len(entries[k + n].text) == 1 and entries[k + n].text in NUMBER_SYMBOLS and entries[k + n + 1].kind == "NUMBER":
                n += 2
        while n > 1 and not _NUMBER.match("".join(e.text for e in entries[k : k + n])):
            n -= 2
        out.append(_joined(entries[k : k + n], "NUMBER_TRANS") if n > 1 else entries[k])
        k += n
    return out


def _units(entries: list[Entry], d: Dictionaries) -> list[Entry]:
    """A number and the longest unit right after it. Letters give a unit as a whole, or before an ``x`` and another number."""
    out, k = [], 0
    while k < len(entries):
        e = entries[k]
        follows = entries[k + 1 : k + 6]
        unit = None
        if e.kind.startswith("NUMBER") and follows:
            for n in range(len(follows), 0, -1):
                word = "".join(x.text for x in follows[:n])
                if len(word) <= LONGEST_UNIT and fold(word) in d.units:
                    unit = (word, n, [])
                    break
            first = follows[0]
            if unit is None and first.kind == "ALPHA" and first.text[-1:] in "xX" and fold(first.text[:-1]) in d.units and len(follows) > 1 and follows[1].kind.startswith("NUMBER"):
                unit = (first.text[:-1], 1, [Entry(first.text[-1], "CROSS", first.stop - 1, first.stop)])
            if unit is None and first.kind == "HANGUL" and not d.known(first.text):
                whole = [u for u in (first.text[:m] for m in range(min(LONGEST_UNIT, len(first.text) - 1), 0, -1)) if fold(u) in d.units]
                if whole:
                    rest = Entry(first.text[len(whole[0]) :], "HANGUL", first.start + len(whole[0]), first.stop)
                    unit = (whole[0], 1, [rest])
        if unit is None:
            out.append(e)
            k += 1
            continue
        word, n, rest = unit
        alpha = word.isascii() and word.isalpha()
        out.append(Entry(e.text + word, "UNIT_ALPHA" if alpha else "UNIT", e.start, e.stop + len(word), number=e))
        out += rest
        k += 1 + n
    return out


def _is_part(e: Entry) -> bool:
    return e.kind in ("ALPHA", "NUMBER", "NUMBER_TRANS", "UNIT_ALPHA") and not e.frozen


def _crossed(entries: list[Entry]) -> list[Entry]:
    """Numbers with ``x`` between them, as in sizes, stay apart: the crosses go where nothing else is in the run."""
    out, k = [], 0
    while k < len(entries):
        n = 1
        if entries[k].kind.startswith(("NUMBER", "UNIT_ALPHA")):
            while k + n + 1 < len(entries) and entries[k + n].text in ("x", "X") and entries[k + n + 1].kind.startswith(("NUMBER", "UNIT_ALPHA")):
                n += 2
        alone = (k == 0 or not _is_part(entries[k - 1]) and entries[k - 1].text not in CONNECTORS) and (k + n == len(entries) or not _is_part(entries[k + n]))
        if n > 1 and alone:
            out += [replace(e, frozen=True) for e in entries[k : k + n : 2]]
        else:
            out += [replace(e, kind="ALPHA") if e.kind == "CROSS" else e for e in entries[k : k + n]]
        k += n
    return out


def _models(entries: list[Entry], for_query: bool) -> list[Entry]:
    """Runs of letters and numbers, joined by single connectors, as model names."""
    out, k = [], 0
    while k < len(entries):
        if not _is_part(entries[k]):
            out.append(entries[k])
            k += 1
            continue
        blocks, links, at = [[entries[k]]], [], k + 1
        while at < len(entries):
            if _is_part(entries[at]):
                blocks[-1].append(entries[at])
                at += 1
                continue
            link = entries[at]
            after = entries[at + 1 : at + 3]
            if link.text not in CONNECTORS or len(link.text) != 1 or not after or not _is_part(after[0]):
                break
            plain = lambda x: x.kind in ("NUMBER", "NUMBER_TRANS")
            lone = len(after) < 2 or not _is_part(after[1])
            if link.text == "/" and len(blocks[-1]) == 1 and plain(blocks[-1][0]) and plain(after[0]) and lone and len(blocks) == 1:
                break
            if link.text != "-" and (blocks[-1][-1].kind == "UNIT_ALPHA" or after[0].kind == "UNIT_ALPHA"):
                break
            if blocks[-1][-1].kind == after[0].kind == "UNIT_ALPHA":
                break
            links.append(link)
            blocks.append([after[0]])
            at += 2
        whole = [e for block in blocks for e in block]
        if len(whole) == 1:
            out.append(whole[0])
        else:
            out.append(_model(blocks, links, for_query))
        k = at
    return out


def _apart(e: Entry) -> list[Entry]:
    """A unit inside a model name is its number and letters."""
    if e.kind != "UNIT_ALPHA":
        return [replace(e, kind="NUMBER") if e.kind == "NUMBER_TRANS" else e]
    return [replace(e.number, kind="NUMBER"), Entry(e.text[len(e.number.text) :], "ALPHA", e.number.stop, e.stop)]


def _model(blocks: list[list[Entry]], links: list[Entry], for_query: bool) -> Entry:
    blocks = [[p for e in block for p in _apart(e)] for block in blocks]
    text = blocks[0][0].text
    sequence = [blocks[0][0]]
    for k, block in enumerate(blocks):
        for e in block if k else block[1:]:
            if k and e is block[0]:
                text += links[k - 1].text
            text += e.text
            sequence.append(e)
    model = Entry(text, "MODEL_NAME", sequence[0].start, sequence[-1].stop)
    single = lambda block: all(len(e.text) == 1 for e in block)
    if all(map(single, blocks)) and (len(blocks) == 1 or len(sequence) == 2):
        return model
    parts: list[Entry] = []
    for k, block in enumerate(blocks):
        if len(block) > 1 and single(block):
            parts.append(_joined(block, "ALPHANUM"))
        if len(block) != 2 or not single(block):
            parts += [_long(e) for e in block]
        if for_query or k + 1 == len(blocks):
            continue
        left, right = block[-1], blocks[k + 1][0]
        if links[k].text in "-/&" and left.kind == right.kind:
            parts.append(_long(Entry(left.text + right.text, left.kind, left.start, right.stop)))
        tail = [e for b in blocks[k + 1 :] for e in b]
        if k == 0 and len(block) == 1 and len(tail) > 1 and not single(blocks[1]):
            parts.append(Entry(text[right.start - model.start :], "MODEL_NAME", right.start, model.stop))
    ordered = sorted(enumerate(parts), key=lambda x: (x[1].start, -x[1].stop, x[0]))
    return replace(model, parts=tuple(e for _, e in ordered))


def _long(e: Entry) -> Entry:
    return replace(e, kind="MODEL_NAME") if e.kind == "NUMBER" and len(e.text) >= LONG_NUMBER else e


def entries(text: str, d: Dictionaries, for_query: bool) -> list[Entry]:
    """The typed entries of a text, in order, symbols left out."""
    return [e for m in re.finditer(r"\S+", text) for e in _piece_entries(m[0], m.start(), d, for_query)]


def _one_word(found: list[Entry], d: Dictionaries) -> bool:
    """Whether the runs are one word of letters, with symbols before or after it at most, that no dictionary has together: no rule changes these."""
    kinds = [e.kind for e in found]
    if len(kinds) > 3 or kinds.count("ALPHA") != 1 or kinds.count("SYMBOL") != len(kinds) - 1:
        return False
    for n in range(2, len(found) + 1):
        for k in range(len(found) - n + 1):
            key = fold("".join([e.text for e in found[k : k + n]]))
            if key in d.space or key in d.stop or key in d.words or key in d.user:
                return False
    return True


def _piece_entries(piece: str, at: int, d: Dictionaries, for_query: bool) -> list[Entry]:
    """The entries of a piece without white space, which stands at ``at``; other pieces don't matter to it."""
    out: list[Entry] = []
    found = _runs(piece, at)
    if not _one_word(found, d):
        found = _far_eastern(_retyped(_known_words(found, d), d))
        found = _models(_crossed(_units(_numbers(found), d)), for_query)
    for e in found:
        if e.kind in ("SYMBOL", "CROSS") and not d.known(e.text):
            continue
        if not for_query and fold(e.text) in d.compound:
            parts = tuple(Entry(p, "COMPOUND", e.start, e.stop) for p in d.compound[fold(e.text)])
            e = replace(e, kind="COMPOUND", parts=parts)
        out.append(_long(e))
    return out


@dataclass
class Token:
    term: str
    type: str
    start: int
    stop: int
    pos_inc: int = 1
    synonyms: list[str] = field(default_factory=list)
    extras: list["Token"] = field(default_factory=list)


def _plain(kind: str) -> str:
    return {"UNIT_ALPHA": "UNIT", "NUMBER_TRANS": "NUMBER"}.get(kind, kind)


def _variants(e: Entry, d: Dictionaries, options: Options) -> tuple[list[Token], list[str]]:
    """What stands beside an entry: its parts and plain forms, and for queries its synonyms."""
    token = lambda text, kind, of: Token(text, _plain(kind), of.start, of.stop, 0)
    extras, synonyms = [], []
    if e.number is not None:
        unit = e.text[len(e.number.text) :]
        plain = e.number.text.replace(",", "")
        if plain != e.number.text:
            extras.append(token(plain + unit, "UNIT", e))
        if options.for_query:
            synonyms += [e.number.text + s for s in d.unit_synonyms.get(fold(unit), ())]
        else:
            extras.append(token(e.number.text, "NUMBER", e.number))
            if plain != e.number.text:
                extras.append(token(plain, "NUMBER", e.number))
    elif e.kind == "NUMBER_TRANS" and "," in e.text:
        extras.append(token(e.text.replace(",", ""), "NUMBER", e))
    extras += [token(p.text, p.kind, p) for p in e.parts]
    if options.for_query and options.synonyms and e.number is None:
        for synonym in d.synonyms.get(fold(e.text), ()):
            words = [x.text for w in synonym.split(" ") for x in entries(w, d, True)]
            synonyms.append(" ".join(words) or synonym)
    return extras, list(dict.fromkeys(s for s in synonyms if s != e.text))


#: Symbols that end words.
_ENDS = ".,;:!?\"')"


def _stands_alone(word: str, piece: str, d: Dictionaries) -> bool:
    """Whether a word of ASCII letters, behind which are symbols at most, has nothing in the dictionaries that makes an index token other than itself."""
    key = fold(word)
    if key in d.stop or key in d.compound:
        return False
    if len(word) == len(piece):
        return True
    both = fold(piece)
    return not (both in d.space or both in d.stop or both in d.words or both in d.user or d.known(piece[len(word) :]))


def _piece_tokens(piece: str, d: Dictionaries, options: Options) -> tuple[int, str, list[Token]]:
    """How many entries a piece has, the first one's text, and its tokens with places counted from its start."""
    word = piece.rstrip(_ENDS)
    if not options.for_query and word.isascii() and word.isalpha() and _stands_alone(word, piece, d):
        return 1, word, [Token(word, "ALPHA", 0, len(word))]
    found = _piece_entries(piece, 0, d, options.for_query)
    out: list[Token] = []
    for e in found:
        stop = fold(e.text) in d.stop
        if stop and options.drop_stop:
            continue
        extras, synonyms = _variants(e, d, options)
        if options.drop_stop:
            extras = [x for x in extras if fold(x.term) not in d.stop]
        token = Token(e.text, "STOPWORD" if stop else _plain(e.kind), e.start, e.stop)
        out.append(token)
        if options.for_query:
            token.synonyms, token.extras = synonyms, extras
        else:
            out += extras
    return len(found), found[0].text if found else "", out


#: Pieces of texts come again and again, so the tokens of so many of so many characters are kept beside the dictionaries.
KEPT_PIECES, KEPT_CHARS = 100_000, 64


def _kept_tokens(piece: str, d: Dictionaries, options: Options) -> tuple[int, str, list[Token]]:
    if len(piece) > KEPT_CHARS:
        return _piece_tokens(piece, d, options)
    key = (piece, options.for_query, options.synonyms, options.drop_stop)
    held = d.pieces.get(key)
    if held is None:
        if len(d.pieces) >= KEPT_PIECES:
            d.pieces.clear()
        held = d.pieces[key] = _piece_tokens(piece, d, options)
    return held


def _moved(t: Token, by: int) -> Token:
    return Token(t.term, t.type, t.start + by, t.stop + by, t.pos_inc, t.synonyms, [_moved(x, by) for x in t.extras] if t.extras else [])


def analyse(text: str | None, d: Dictionaries, options: Options = INDEX) -> list[Token]:
    """The tokens of a text. For an index, parts are tokens of their own at the same position; for a query they stand beside their term."""
    text = text or ""
    if options.uppercase:
        text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
    out: list[Token] = []
    count, only = 0, ""
    for m in re.finditer(r"\S+", text):
        n, first, tokens = _kept_tokens(m[0], d, options)
        count += n
        only = only or first
        at = m.start()
        out += [_moved(t, at) for t in tokens]
    full = text.rstrip(" ")
    if options.for_query and options.full_string and 0 < len(full) < 64 and not (count == 1 and only == full):
        out.insert(0, Token(full, "FULL_STRING", 0, len(full)))
    return out


def token_types(text: str | None, d: Dictionaries, options: Options = INDEX) -> list[str]:
    """The types of a text's tokens, in order."""
    if options.uppercase or options.for_query and options.full_string:
        return [t.type for t in analyse(text, d, options)]
    return [t.type for piece in (text or "").split() for t in _kept_tokens(piece, d, options)[2]]
