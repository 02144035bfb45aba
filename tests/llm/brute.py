"""Plain forms of what the operators do, for tests."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from lexiloom.llm.secrets import BASE_KINDS
from lexiloom.llm.suffix import LENGTH, _prefix_lengths, prefix_intervals


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All strings of at least ``least`` bytes that occur twice or more and can't be made longer, with all (text, start).

    A plain suffix array over a bounded set of texts: the same scan, with
    the test that the occurrences' left neighbours differ.
    """
    suffixes = sorted(((t[k:], d, k) for d, t in enumerate(texts) for k in range(len(t) - least + 1)), key=lambda x: x[0])
    out = []
    for length, first, last in prefix_intervals(_prefix_lengths([s for s, _, _ in suffixes])):
        if length < least:
            continue
        spots = [(d, k) for _, d, k in suffixes[first : last + 1]]
        if len({texts[d][k - 1] if k else (d,) for d, k in spots}) > 1:
            out.append((suffixes[first][0][:length], sorted(spots)))
    return out


def removed_by_brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, from all strings of ``length`` bytes; for tests."""
    raws = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            own = hashlib.md5(raw[k : k + length]).digest()
            count[own] = count.get(own, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, np.int8)
        for k in range(len(raw) - length + 1):
            if count[hashlib.md5(raw[k : k + length]).digest()] > 1:
                gone[k + 1 : k + length + 1] = 1
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def base_spans(text: str | None) -> str:
    """The base kinds by Python's regular expressions."""
    text, found = text or "", []
    assign = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(base_spans(text).encode()).hexdigest()
