"""Repeats of 400 bytes or more, by sampled suffixes and common-prefix interval trees.

Of every 250 consecutive bytes some 50-byte gram has the least hash; equal
strings pick the same gram at the same place. So all occurrences of a repeated
string of 250 bytes or more meet among the occurrences of that gram, which are suffixes
with up to 350 bytes before them. Those whose whole context is repeated are
settled by its hash. The others of a gram form an enhanced suffix array: a
scan over common-prefix lengths gives the interval tree, and within each
interval the common left extensions tell how far its occurrences repeat.

Repeats of 400 bytes are removed. Those of 250 bytes, which a passage of fifty words
has unless its words are very short, are only reported.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, cleared, few, plain_columns, read_table, release_memory, stage

#: Bytes of a repeat that is removed, of one that is reported, and of the grams that sample the suffixes.
LENGTH, PASSAGE, GRAM = 400, 250, 50
#: Bytes of context on either side of a gram.
SIDE = LENGTH - GRAM
#: Texts are searched for least grams in pieces of so many bytes, which bounds memory.
PIECE = 1 << 20
#: Bytes of text that a task turns into Python objects at once.
HELD = 1 << 21
#: Anchors that a task holds to combine equal ones before the shuffle.
COMBINED = 200_000
#: Contexts that a task hands on, or compares with the next ones, at once.
TAKEN = 1_000
#: Occurrences in intervals of the tree that are compared at once.
COMPARED = 1 << 15
#: Beyond so many different contexts of one gram, windows are compared by hash over many tasks instead.
LARGE_GROUP = 50_000
#: Up to so many results in all (about 25 bytes each), they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_RESULTS = 3_000_000

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE + LENGTH + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE + LENGTH + 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed rolling hash of each gram of at most ``PIECE + LENGTH`` bytes."""
    mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed * _UP[: len(data)], out=sums[1:])
    out = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(text: bytes) -> np.ndarray:
    """The starts of the grams that have the least hash in some ``PASSAGE`` bytes of the text, ties included."""
    found = []
    width = PASSAGE - GRAM + 1
    for at in range(0, max(len(text) - PASSAGE + 1, 0), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + PASSAGE - 1, len(text) - at), at)
        hashes = _gram_hashes(data)
        least = _least_of_windows(hashes, width)
        # A gram counts if some window that holds it has its hash as the least.
        most = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        inverse = np.iinfo(np.uint64).max - most
        reached = np.iinfo(np.uint64).max - _least_of_windows(inverse, width)
        found.append(np.flatnonzero(reached == hashes) + at)
    if len(found) == 1:
        return found[0]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


_ANCHORS = "k1 long, k2 long, pos int, g long, c long, flag int"


def _combined(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Anchors, of which those with the gram and context of an earlier one are settled."""
    order = np.lexsort((c, g))
    again = (g[order[1:]] == g[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    flag = np.zeros(len(g), np.int32)
    flag[order[:-1][again]] = 1
    later = order[1:][again]
    flag[later], c[later] = 2, 0
    g[later] = [xxhash.xxh3_64_intdigest(b"%d %d %d" % key) for key in zip(k1[later].tolist(), k2[later].tolist(), pos[later].tolist())]
    columns = {"k1": k1, "k2": k2, "pos": pos, "g": g.view(np.int64), "c": c.view(np.int64), "flag": flag}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with the hashes of gram and context. Copies within a partition are combined before the shuffle.

    flag 1: the context is repeated. flag 2: settled here, as another anchor of the partition
    stands for it; such rows get a gram hash of their own, which no other row has.
    """
    seen_texts: set[tuple[int, int]] = set()
    digest = xxhash.xxh3_64_intdigest
    #: What a context's hash begins with: how much of it stands before the gram.
    before = [n.to_bytes(2, "little") for n in range(SIDE + 1)]
    keys, counts, columns = [], [], [array(x) for x in "iQQ"]

    def held() -> pa.RecordBatch:
        k1, k2 = np.repeat(np.array(keys, np.int64), counts, axis=0).T
        return _combined(k1, k2, *(np.array(x) for x in columns))

    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            if (k1, k2) in seen_texts:
                continue
            seen_texts.add((k1, k2))
            raw = text.as_py()
            spots = anchors(raw).tolist()
            keys.append((k1, k2))
            counts.append(len(spots))
            pos, g, c = columns
            pos.extend(spots)
            g.extend([digest(raw[x : x + GRAM]) for x in spots])
            c.extend([digest(before[min(x, SIDE)] + raw[max(0, x - SIDE) : x + LENGTH]) for x in spots])
            if len(pos) >= COMBINED:
                yield held()
                keys, counts, columns = [], [], [array(x) for x in "iQQ"]
    if columns[0]:
        yield held()
    keys, counts, columns = [], [], []
    release_memory()


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def _prefix_lengths(strings: list[bytes]) -> np.ndarray:
    """Common prefix length of each string with the next one."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(strings) - 1, TAKEN):
        some = strings[at : at + TAKEN + 1]
        sizes = np.array([len(x) for x in some])
        width = max(int(sizes.max()), 1)
        table = np.array(some, f"S{width}").view(np.uint8).reshape(len(some), width)
        differ = table[1:] != table[:-1]
        shorter = np.minimum(sizes[1:], sizes[:-1])
        out.append(np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), shorter), shorter))
    return np.concatenate(out)


def prefix_intervals(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each node of the interval tree of a sorted suffix list, by one scan with a stack.

    ``lengths[k]`` is the common prefix length of suffixes k and k + 1; all suffixes from first to last share ``length``.
    """
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*lengths.tolist(), -1]):
        start = k
        while stack and stack[-1][0] > length:
            own, start = stack.pop()
            yield own, start, k
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, start))


class _RangeMinima:
    """The least of any range of numbers, from those of all ranges whose length is a power of two."""

    def __init__(self, numbers: np.ndarray) -> None:
        levels = [numbers]
        while len(levels[-1]) > (half := 1 << len(levels) - 1):
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        self.levels = np.concatenate(levels)
        self.begins = np.cumsum([0, *map(len, levels[:-1])])

    def least(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        level = np.frexp(stops - starts)[1] - 1
        begins = self.begins[level]
        return np.minimum(self.levels[begins + starts], self.levels[begins + stops - (1 << level.astype(np.int64))])


def extents(lefts: list[bytes], rights: list[bytes], least: tuple[int, ...], sizes: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """How far left and right each occurrence of a gram belongs to repeats, for each length in ``least``, which count without the gram.

    ``lefts`` are reversed. An occurrence i has a repeat with j if their
    common extensions left and right add up to the length; the largest left and
    right extension over all such j are returned, -1 where there is none. For
    each interval of the tree (right extension) only neighbours by left
    extension have to be compared: they have the largest.
    ``sizes``: how many occurrences each of several grams has, which stand one gram after the other.
    Few grams have many occurrences, so the intervals of all are compared together.
    """
    n = len(rights)
    found = [(np.full(n, -1, np.int64), np.full(n, -1, np.int64)) for _ in least]
    sizes = np.array(sizes or [n])
    stops = np.cumsum(sizes)
    starts = stops - sizes

    def sorted_by(side: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of each gram in order, and what each has in common with the next one, -1 for the last one."""
        order = [k for a, b in zip(starts.tolist(), stops.tolist()) for k in sorted(range(a, b), key=side.__getitem__)]
        common = np.append(_prefix_lengths([side[k] for k in order]), -1)
        common[stops - 1] = -1
        return np.array(order, np.int64), common

    order, after = sorted_by(rights)
    sorted_left, between = sorted_by(lefts)
    by_left = np.empty(n, np.int64)
    by_left[sorted_left] = np.arange(n)
    minima = _RangeMinima(between)
    longest = np.repeat(np.maximum.reduceat(between, starts), sizes)
    nodes = np.fromiter(prefix_intervals(after[:-1]), np.dtype((np.int64, 3)))
    nodes = nodes[nodes[:, 0] + longest[nodes[:, 1]] >= min(least)]
    upto = np.cumsum(nodes[:, 2] - nodes[:, 1] + 1)
    for some in np.split(nodes, np.flatnonzero(np.diff(upto // COMPARED)) + 1):
        members = some[:, 2] - some[:, 1] + 1
        node = np.repeat(np.arange(len(some)), members)
        place = np.arange(len(node)) + np.repeat(some[:, 1] - np.cumsum(members) + members, members)
        # The members of each interval by left extension.
        ranks = np.sort(node * n + by_left[order[place]]) - node * n
        # The common left extension of two members is the least of those between them.
        shared = np.full(max(len(node) - 1, 0), -1)
        same = np.flatnonzero(node[1:] == node[:-1])
        shared[same] = minima.least(ranks[same], ranks[same + 1])
        best = np.maximum(np.append(-1, shared), np.append(shared, -1))[: len(node)]
        length = some[node, 0]
        for (left, right), enough in zip(found, least):
            ok = best + length >= enough
            who = sorted_left[ranks[ok]]
            np.maximum.at(left, who, best[ok])
            np.maximum.at(right, who, length[ok])
    return found


_CONTEXTS = "g long, k1 long, k2 long, pos int, cover boolean, left binary, right binary"
#: ``kept`` spans are reported only.
_SPANS = "k1 long, k2 long, kept boolean, start int, stop int"
_SHORT = (LENGTH - GRAM, PASSAGE - GRAM)


def _take_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text", HELD):
        spots = batch.column("spots").flatten()
        pos, rows = spots.field("pos").to_numpy(), pc.list_parent_indices(batch.column("spots"))
        raws = batch.column("text").cast(pa.binary()).to_pylist()
        for at in range(0, len(spots), TAKEN):
            some, row = spots.slice(at, TAKEN), rows.slice(at, TAKEN)
            where = [(raws[k], x) for k, x in zip(row.to_pylist(), pos[at : at + TAKEN].tolist())]
            left = pa.array([raw[max(0, x - SIDE) : x][::-1] for raw, x in where], pa.binary())
            right = pa.array([raw[x + GRAM : x + LENGTH] for raw, x in where], pa.binary())
            yield pa.RecordBatch.from_arrays([some.field("g"), batch.column("k1").take(row), batch.column("k2").take(row), some.field("pos"), some.field("cover"), left, right], ["g", "k1", "k2", "pos", "cover", "left", "right"])


def _group_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from the interval tree of each gram's contexts; rows come sorted by gram."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        g, k1, k2, pos, cover = (rows.column(c).to_numpy() for c in ("g", "k1", "k2", "pos", "cover"))
        sizes = np.diff([0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)])
        out = []
        for kept, (left, right) in zip((False, True), extents(rows.column("left").to_pylist(), rows.column("right").to_pylist(), _SHORT, sizes.tolist())):
            hit = np.flatnonzero((left >= 0) & ~cover)
            out.append([k1[hit], k2[hit], np.full(len(hit), kept), pos[hit] - left[hit], pos[hit] + GRAM + right[hit]])
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds)], ["k1", "k2", "kept", "start", "stop"])

    #: Rows whose grams are not whole yet.
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        g = batch.column("g").to_numpy()
        starts = np.flatnonzero(np.diff(g)) + 1
        if held and g[0] != held[-1].column("g")[-1].as_py():
            starts = np.append(0, starts)
        # Rows up to the start of the last gram are whole.
        if len(starts):
            if whole := [x for x in (*held, batch.slice(0, starts[-1])) if len(x)]:
                yield spans(whole)
            held = []
            batch = batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield spans(held)
    held = []
    release_memory()


def _shared(side: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts with ``most``, which no common extension on one side with another context of the gram is longer than; rows come sorted by gram and that side.

    The longest is that with a neighbour. The first and last row of a partition don't know theirs, so all of their side may be common.
    """

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.RecordBatch, before: list[tuple], after: list[tuple]) -> pa.RecordBatch:
            own = list(zip(rows.column("g").to_pylist(), rows.column(side).to_pylist()))
            line = [*before, *own, *after]
            common = [_common(x, y) if g == h else 0 for (g, x), (h, y) in zip(line, line[1:])]
            if not before:
                common.insert(0, len(own[0][1]))
            if not after:
                common.append(len(own[-1][1]))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(map(max, common, common[1:]), pa.int32())], [*rows.schema.names, "most"])

        held, before = None, []
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield told(held, before, [(batch.column("g")[0].as_py(), batch.column(side)[0].as_py())])
                before = [(held.column("g")[-1].as_py(), held.column(side)[-1].as_py())]
            held = batch
        if held is not None:
            yield told(held, before, [])

    return bounds


#: Windows that are hashed and compared at once (about 60 bytes each); more go in several passes.
WINDOWS_AT_ONCE = 200_000_000
_WINDOWS = "g long, k1 long, k2 long, pos int, kept boolean, lag int, a long, b long"


def _lags(side: F.Column) -> tuple[F.Column, F.Column]:
    """The least and the greatest place of the gram in a window that may be repeated."""
    return F.greatest(F.lit(0), side - F.col("ahead")), F.least(side, F.col("behind"))


def _window_hashes(turn: int, turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each context, the hashes of its windows of either length that may be repeated; ``lag`` is the gram's place in the window."""
        for batch in batches:
            for g, k1, k2, pos, left, right, ahead, behind in zip(*(batch.column(c).to_pylist() for c in ("g", "k1", "k2", "pos", "left", "right", "ahead", "behind"))):
                whole = left[::-1] + right
                rows = []
                for kept, side in zip((False, True), _SHORT):
                    first = max(0, side - ahead)
                    for lag in range(first + (turn - first) % turns, min(side, behind) + 1, turns):
                        own = whole[len(left) - lag : len(left) - lag + side]
                        both = xxhash.xxh3_128_intdigest(lag.to_bytes(2, "little") + own)
                        rows.append((g, k1, k2, pos, kept, lag, _signed(both >> 64), _signed(both & (1 << 64) - 1)))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["g", "k1", "k2", "pos", "kept", "lag", "a", "b"])

    return hashes


def _bounded(contexts: DataFrame) -> DataFrame:
    """The contexts that may have a repeat, with what they have in common with any other one at most: ``ahead`` on the right and ``behind`` on the left."""
    for side, name, other in (("right", "ahead", F.octet_length("left")), ("left", "behind", F.col("ahead"))):
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contexts.schema)
        told = contexts.repartitionByRange("g", side).sortWithinPartitions("g", side).mapInArrow(_shared(side), f"{kinds}, most int")
        before, contexts = contexts, stage(told.where(F.col("most") + other >= min(_SHORT)).withColumnRenamed("most", name))
        cleared(before)
    return contexts


def _large_group_spans(contexts: DataFrame) -> DataFrame:
    """The same spans for grams with very many contexts: windows are counted by hash, linear in the contexts.

    A window goes no further than what its context has in common with its neighbours in order, and where there are many, passes take
    every so many places of the gram, so that shuffles stay small.
    """
    bounded = _bounded(stage(contexts))
    sizes = [F.greatest(F.lit(0), last - first + 1) for first, last in (_lags(F.lit(side)) for side in _SHORT)]
    turns = -(-(bounded.agg(F.sum(sizes[0] + sizes[1])).first()[0] or 0) // WINDOWS_AT_ONCE) or 1
    found = []
    for turn in range(turns):
        windows = bounded.mapInArrow(_window_hashes(turn, turns), _WINDOWS)
        repeated = windows.groupBy("g", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("g", "a", "b")
        spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        hit = windows.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(16)).cast("int")).join(spread, ["g", "a", "b", "salt"])
        found.append(stage(hit.groupBy("k1", "k2", "pos", "kept").agg(F.min("lag").alias("near"), F.max("lag").alias("far"))))
    ends = reduce(DataFrame.unionByName, found).groupBy("k1", "k2", "pos", "kept").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    return ends.selectExpr("k1", "k2", "kept", "CAST(pos - far AS INT) AS start", f"CAST(pos - near + IF(kept, {PASSAGE}, {LENGTH}) AS INT) AS stop")


def _merge(spans: str) -> str:
    """SQL that unites overlapping or adjoining (start, stop) of a sorted array."""
    return (
        f"aggregate({spans}, CAST(array() AS array<struct<start: int, stop: int>>), (a, x) -> CASE"
        " WHEN size(a) > 0 AND a[size(a) - 1].stop >= x.start THEN concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start AS start, greatest(a[size(a) - 1].stop, x.stop) AS stop)))"
        " ELSE concat(a, array(x)) END)"
    )


def _with_texts(texts: DataFrame, results: DataFrame, how: str, listed: str) -> DataFrame:
    """``texts`` joined to one row of ``results`` each; texts are moved only if there are too many results, in the arrays ``listed``, to broadcast."""
    total = results.agg(F.sum(1 + F.greatest(F.size(listed), F.lit(0)))).first()[0] or 0
    small = total <= BROADCAST_RESULTS
    return texts.join(F.broadcast(results) if small else results, ["k1", "k2"], how)


def repeated_spans(docs: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """(k1, k2, copies, spans, passages) for each different text of ``docs(k1, k2, text)`` with a repeat.

    ``spans`` are the united byte ranges that repeats of ``LENGTH`` bytes cover and ``passages`` those of ``PASSAGE`` bytes,
    but for the ends of the text: a stop may lie beyond it and a start before it. ``copies`` counts the rows with this text.
    """
    long_enough = docs.where(F.octet_length("text") >= PASSAGE)
    copies = long_enough.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    found = long_enough.select("k1", "k2", "text").mapInArrow(_find_anchors, _ANCHORS)
    found = stage(found)
    # Most grams occur once; they go before anything else is done.
    grams = found.groupBy("g").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("several"))
    kept = stage(found.join(grams, "g").where("n > 1 OR flag > 0").drop("n"))
    cleared(found)
    # Of the anchors with the same context, one is compared with other contexts of the gram.
    contexts = kept.where("flag < 2").groupBy("g", "c", "several").agg(F.count("*").alias("n"), F.max("flag").alias("flag"), F.min(F.struct("k1", "k2", "pos")).alias("own"))
    contexts = stage(contexts)
    again = contexts.where("n > 1").select("g", "c")
    settled = kept.where("flag > 0").select("k1", "k2", "pos").unionByName(kept.where("flag = 0").join(again, ["g", "c"], "left_semi").select("k1", "k2", "pos"))
    settled = settled.selectExpr("k1", "k2", "explode(array(false, true)) AS kept", f"CAST(pos - {SIDE} AS INT) AS start", f"CAST(pos + {LENGTH} AS INT) AS stop")

    needed = contexts.where("several")
    large = needed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > large_group).select("g")
    large = few(stage(large))
    needed = needed.select("own.*", "g", ((F.col("n") > 1) | (F.col("flag") > 0)).alias("cover"))

    def taken(some: DataFrame) -> DataFrame:
        spots = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "g", "cover")).alias("spots"))
        # Copies of a text have the same contexts; one row of each text will do.
        once = _with_texts(long_enough.select("k1", "k2", "text"), spots, "inner", "spots").select("k1", "k2", "spots", "text")
        return once.mapInArrow(_take_contexts_once, _CONTEXTS)

    usual = taken(needed.join(large, "g", "left_anti"))
    spans = settled.unionByName(usual.repartition("g").sortWithinPartitions("g").mapInArrow(_group_spans, _SPANS))
    if not large.isEmpty():
        spans = spans.unionByName(_large_group_spans(taken(needed.join(large, "g", "left_semi"))))
    listed = [F.array_sort(F.collect_list(F.when(F.col("kept") == kept, F.struct("start", "stop")))).alias(name) for kept, name in ((False, "all"), (True, "told"))]
    merged = spans.groupBy("k1", "k2").agg(*listed).selectExpr("k1", "k2", f"{_merge('all')} AS spans", f"{_merge('told')} AS passages")
    return stage(merged.join(copies, ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("copies", F.lit(1)).alias("copies"), "spans", "passages"))


def _take_contexts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each text the partition has not met before; copies in other partitions give equal rows."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key not in seen:
                seen.add(key)
                keep.append(k)
        if keep:
            yield from _take_contexts([batch if len(keep) == len(batch) else batch.take(pa.array(keep, pa.int64()))])
    release_memory()


_CUT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "n_passage_bytes": pa.int64()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the spans, in batches of bounded size."""
    for batch in by_size(batches, "text", HELD):
        rows = []
        for text, copies, spans, passages in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
            raw = text.encode("utf-8", "replace")
            n = len(raw)
            ranges, told = (
                [] if n < length else [(0, n)] if (copies or 1) > 1 else [(max(0, x["start"]), min(n, x["stop"])) for x in some or ()]
                for length, some in ((LENGTH, spans), (PASSAGE, passages))
            )
            pieces, at = [], 0
            for a, b in ranges:
                pieces.append(raw[at:a])
                at = b
            rest = b"".join([*pieces, raw[at:]])
            rows.append((n, n - len(rest), len(ranges), rest, sum(b - a for a, b in told)))
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _CUT.values()))], ["doc_id", *_CUT])
    release_memory()


def remove_repeats(docs: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_passage_bytes) for each row of ``docs(doc_id, text)``.

    ``kept`` are the text's UTF-8 bytes without those that a string of
    ``LENGTH`` bytes covers which also starts anywhere else, in this row or
    another. ``n_passage_bytes`` counts the bytes that such a string of ``PASSAGE`` bytes covers, removed or not.
    Null texts are empty. Repeated rows count as copies, and lose all their bytes if
    they are long enough.
    """
    keyed = plain_columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("k2")
    )
    results = repeated_spans(keyed.select("k1", "k2", "text"), large_group)
    joined = _with_texts(keyed, results, "left", "spans").select("doc_id", "text", "copies", "spans", "passages")

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.BinaryType() if n == "kept" else T.LongType()) for n in _CUT)]
    return joined.mapInArrow(_cut, T.StructType(fields))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")
