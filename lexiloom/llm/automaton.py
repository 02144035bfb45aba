"""Byte automata: rules to an NFA, subset construction, minimisation, transition arrays.

A rule is a sequence of parts over bytes, built with the functions below. All
rules together become one deterministic automaton that may start a match at
any byte, so a single pass over the bytes meets the ends of every rule's
matches. A second automaton per rule reads backwards from such an end and
finds where the match may have begun.
"""

from __future__ import annotations

from collections import deque

import numpy as np

Part = tuple


def chars(members: bytes) -> Part:
    return ("chars", frozenset(members))


def literal(text: bytes, any_case: bool = False) -> Part:
    both = lambda c: bytes([c]).lower() + bytes([c]).upper() if any_case else bytes([c])
    return ("seq", *[chars(both(c)) for c in text])


def seq(*parts: Part) -> Part:
    return ("seq", *parts)


def either(*parts: Part) -> Part:
    return ("either", *parts)


def many(part: Part, least: int = 0) -> Part:
    """``part`` at least so many times."""
    return ("seq", *[part] * least, ("star", part))


def maybe(part: Part) -> Part:
    return ("either", part, ("seq",))


def reverse(part: Part) -> Part:
    if part[0] == "chars":
        return part
    inner = [reverse(p) for p in part[1:]]
    return (part[0], *(inner[::-1] if part[0] == "seq" else inner))


class Nfa:
    """States with byte edges and empty edges (Thompson's construction)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, part: Part, start: int) -> int:
        """Add ``part`` from ``start``; the state in which it ends."""
        kind = part[0]
        if kind == "chars":
            end = self.state()
            self.edges[start].append((part[1], end))
            return end
        if kind == "seq":
            for inner in part[1:]:
                start = self.add(inner, start)
            return start
        end = self.state()
        if kind == "either":
            for inner in part[1:]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(inner, own)].append(end)
        else:  # star
            own = self.state()
            self.empty[start] += [own, end]
            self.empty[self.add(part[1], own)] += [own, end]
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for q in self.empty[todo.pop()]:
                if q not in found:
                    found.add(q)
                    todo.append(q)
        return frozenset(found)


class Dfa:
    """Minimal automaton: ``step[state * width + byte_class]``, ``accepts[state]`` as a bit for each rule.

    State 0 is the start.
    """

    def __init__(self, rules: list[Part], anywhere: bool) -> None:
        nfa = Nfa()
        first = nfa.state()
        ends = {}
        for bit, rule in enumerate(rules):
            own = nfa.state()
            nfa.empty[first].append(own)
            ends[nfa.add(rule, own)] = 1 << bit
        self.classes, samples = self._byte_classes(nfa)
        start = nfa.closure([first])
        index, order, rows = {start: 0}, deque([start]), []
        accepts = []
        while order:
            here = order.popleft()
            accepts.append(sum({ends[q] for q in here if q in ends}))
            row = []
            for byte in samples:
                to = {q for s in here for members, q in nfa.edges[s] if byte in members}
                target = nfa.closure(to | {first}) if anywhere else nfa.closure(to)
                if target not in index:
                    index[target] = len(index)
                    order.append(target)
                row.append(index[target])
            rows.append(row)
        step, accepts = self._minimise(np.array(rows, np.int64), np.array(accepts, np.int64))
        self.width = step.shape[1]
        self.step, self.accepts = step.astype(np.int32).ravel(), accepts
        self.dead = next((s for s in range(len(accepts)) if not accepts[s] and (step[s] == s).all() and s), -1)

    @staticmethod
    def _byte_classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no edge tells apart share a class; a sample byte of each class."""
        sets = list({members for edges in nfa.edges for members, _ in edges})
        seen: dict[tuple, int] = {}
        classes, samples = np.zeros(256, np.int32), []
        for byte in range(256):
            sign = tuple(byte in members for members in sets)
            if sign not in seen:
                seen[sign] = len(seen)
                samples.append(byte)
            classes[byte] = seen[sign]
        return classes, samples

    @staticmethod
    def _minimise(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split blocks of states until all states of a block step into the same blocks."""
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            signs = np.column_stack([block, block[step]])
            _, finer = np.unique(signs, axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        order = np.argsort(first)  # the block of state 0 comes first
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(len(order))
        keep = first[order]
        return name[block[step[keep]]], accepts[keep]


class Scanner:
    """Leftmost, longest, non-overlapping matches of each rule, from one pass for all of them."""

    #: Below so many unfinished texts, the rest of each is stepped by itself.
    FEW = 128

    def __init__(self, rules: list[Part]) -> None:
        self.rules = len(rules)
        self.forward = Dfa(rules, anywhere=True)
        self.backward = [Dfa([reverse(rule)], anywhere=False) for rule in rules]
        d = self.forward
        after = d.accepts[d.step.reshape(-1, d.width)]
        #: Rules that accepted before a byte and not after it: their matches end there.
        self.ended = (d.accepts[:, None] & ~after).astype(np.int32).ravel()

    def _ends(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text the (offset, rule bits) at which matches end, in order."""
        d = self.forward
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(order) else np.zeros(0, np.int64)
        data = d.classes[np.frombuffer(b"".join(texts[k] for k in order), np.uint8)]
        state = np.zeros(len(order), np.int32)
        at, active = 0, int((lengths > 0).sum())
        while active >= self.FEW:
            here = state[:active] * d.width + data[starts[:active] + at]
            ended = self.ended[here]
            if ended.any():
                for lane in np.flatnonzero(ended):
                    found[order[lane]].append((at, int(ended[lane])))
            state[:active] = d.step[here]
            at += 1
            active = int(np.searchsorted(-lengths, -at, side="left"))
        step, ended = d.step.tolist(), self.ended.tolist()
        for lane in range(active):
            s, own = int(state[lane]), found[order[lane]]
            begin = int(starts[lane])
            for offset, c in enumerate(data[begin + at : begin + int(lengths[lane])].tolist(), at):
                here = s * d.width + c
                if ended[here]:
                    own.append((offset, ended[here]))
                s = step[here]
            state[lane] = s
        for lane, k in enumerate(order):
            if last := int(d.accepts[state[lane]]):
                found[k].append((int(lengths[lane]), last))
        return found

    def _begin(self, rule: int, text: bytes, end: int, floor: int) -> int:
        """The least start, not before ``floor``, of a match that ends at ``end``; -1 if there is none."""
        d, s, best = self.backward[rule], 0, -1
        for at in range(end - 1, floor - 1, -1):
            s = int(d.step[s * d.width + int(d.classes[text[at]])])
            if s == d.dead:
                break
            if d.accepts[s]:
                best = at
        return best

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, rule, end) of all matches, in bytes, by start and then rule."""
        out = []
        for text, ends in zip(texts, self._ends(texts)):
            spans, floor = [], [0] * self.rules
            for end, bits in ends:
                for rule in range(self.rules):
                    if bits >> rule & 1 and (begin := self._begin(rule, text, end, floor[rule])) >= 0:
                        spans.append((begin, rule, end))
                        floor[rule] = end
            out.append(sorted(spans))
        return out
