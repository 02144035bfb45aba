"""Token ids in files of grammar-compressed shards (Re-Pair), with random access.

Rows are put in ascending id order over range partitions and tokenised there.
Some million tokens make a shard. In each shard frequent id pairs are replaced
by nonterminals, round after round; no pair crosses the end of a document, so
every document is a range of the compressed sequence, and expansion lengths
lead to any token without expanding what comes before.

A file table has a row for each shard: part and nth (its place in the order),
n_docs, n_tokens, and payload. The payload is::

    4 bytes  magic "RPR1"
    8 bytes  lengths of the six sections, 8 bytes each, little endian
    1 doc ids, an Arrow stream of one column
    2 tokens of each document, the end id included, as packed integers
    3 compressed symbols of each document, as packed integers
    4 rules: left and right symbol of nonterminal base + 1, base + 2, ...
    5 expansion length of each nonterminal
    6 the compressed sequence

Symbols below ``base`` are ids, ``base`` is the end of a document.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress as compress_by
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, shared_dir
from .packing import gather, pack_ints, unpack_ints

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SHARD_CHARS = 4_000_000
#: A pair is frequent if it stands at so many places.
LEAST_COUNT = 16
#: Chunks whose ids a worker remembers; when there are more it keeps those that came again, unless they are over half of this number.
REMEMBERED = 1_500_000
MAGIC = b"RPR1"

#: White space other than space and newline.
_UNUSUAL = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
#: Chunks that the library gets in one text.
LEARNT = 1000
#: Kinds of a text's bytes. Texts are cut before a space, around a newline, and before an ASCII mark after a letter or digit.
_OTHER, _SPACE, _NEWLINE, _WORD, _MARK, _BEYOND = range(6)
_KINDS = np.array([_BEYOND if c > 127 else _WORD if chr(c).isalnum() else _SPACE if c == 32 else _NEWLINE if c == 10 else _MARK if 32 < c < 127 else _OTHER for c in range(256)], np.uint8)


def _even(text: str) -> bool:
    """Whether each space and newline of the text stands between two other characters than white space, and there is no other white space."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return not any(c in text for c in _UNUSUAL)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each character up to U+FFFF is a letter or digit."""
    codes = [k for k in range(0x10000) if not 0xD800 <= k < 0xE000]
    out = np.zeros(0x10000, bool)
    out[codes] = pc.match_substring_regex(pa.array(map(chr, codes)), r"^[\pL\pN]$").to_numpy(zero_copy_only=False)
    return out


def _cuts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether a chunk starts there; after characters past U+FFFF no mark does."""
    kinds = _KINDS.take(data)
    cut = (kinds == _SPACE) | (kinds == _NEWLINE)
    cut[1:] |= kinds[:-1] == _NEWLINE
    mark = kinds[1:] == _MARK
    cut[1:] |= mark & (kinds[:-1] == _WORD)
    at = np.flatnonzero(mark & (kinds[:-1] == _BEYOND)) + 1
    # The character before is of two or three bytes if one of them is a first byte.
    third, second, last = (data.take(at - k, mode="clip").astype(np.int32) for k in (3, 2, 1))
    code = np.where(second >= 0xC0, (second & 0x1F) << 6, (third & 0x0F) << 12 | (second & 0x3F) << 6) | last & 0x3F
    cut[at] |= ((second >= 0xC0) | (third >= 0xE0)) & _letters().take(code)
    return cut


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class ChunkEncoder:
    """The tokenizers library, with a memory of chunks.

    The pre-tokeniser always cuts before a single space between two
    non-spaces, on either side of such a newline, and between a letter or digit
    and an ASCII mark after it, so texts that have no other kind of white space are cut there, and
    each chunk is encoded once. Other texts, and those with one of the file's
    added tokens, are given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are found before the pre-tokeniser runs, so a text that may hold one is never cut.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # In the byte-level alphabet a token has a character for each of its bytes.
        self.sizes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.base)], np.int64)
        self._forget()

    def _forget(self) -> None:
        #: Chunks, with the space before them, by their number. Piece k of ``values`` has the ids of number k.
        self.number: dict[str, int] = {"\n": 0}
        self.values, self.ends, self.used, self.count = np.empty(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 1, 1
        (self.values[0],), self.ends[1] = self._encode(["\n"])[0], 1
        #: Whether the chunk of a number came again since it was learnt or last kept.
        self.again = np.zeros(1 << 18, bool)

    def _thin_out(self) -> None:
        """Keep the chunks that came again, under new numbers in their old order."""
        self.again[0] = True
        kept = np.flatnonzero(self.again[: self.count])
        if len(kept) > REMEMBERED // 2:
            self._forget()
            return
        names = list(compress_by(self.number, self.again[: self.count].tolist()))
        ends, values = self.ends[: self.count + 1], gather(self.values[: self.used], self.ends[: self.count + 1], kept)
        upto = np.cumsum(np.diff(ends)[kept])
        self.number = dict(zip(names, range(len(names))))
        self.used, self.count = len(values), len(names)
        self.values[: self.used], self.ends[1 : self.count + 1] = values, upto
        self.again[:] = False

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], lengths: np.ndarray) -> None:
        """Encode new chunks of so many bytes, many in one text; a newline goes before those that have no space there. The tokens' lengths in bytes tell them apart."""
        for at in range(0, len(chunks), 20_000):
            names = chunks[at : at + 20_000]
            bare = np.array([name[0] != " " for name in names])
            parts = ["\n" + name if x else name for name, x in zip(names, bare.tolist())]
            texts = ["".join(parts[k : k + LEARNT]) for k in range(0, len(parts), LEARNT)]
            ids = np.concatenate([np.array(x, np.uint32) for x in self._encode(texts)])
            reached = np.cumsum(self.sizes[ids])
            ends = np.cumsum(lengths[at : at + 20_000] + bare)
            cuts = np.searchsorted(reached, ends) + 1
            if not (reached[cuts - 1] == ends).all():
                raise RuntimeError("a token reaches over a cut")
            starts = np.concatenate(([0], cuts[:-1]))[bare]
            if not (self.sizes[ids[starts]] == 1).all():
                raise RuntimeError("a token reaches over a cut")
            ids, cuts = np.delete(ids, starts), cuts - np.cumsum(bare)
            while self.used + len(ids) > len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            while self.count + len(names) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.again = np.concatenate([self.again, np.zeros_like(self.again)])
            self.values[self.used : self.used + len(ids)] = ids
            self.ends[self.count + 1 : self.count + 1 + len(names)] = self.used + cuts
            self.number.update(zip(names, range(self.count, self.count + len(names))))
            self.used += len(ids)
            self.count += len(names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if len(self.number) > REMEMBERED:
            self._thin_out()
        even = [k for k, t in enumerate(texts) if _even(t) and not any(mark in t for mark in self.added)]
        whole = sorted(set(range(len(texts))) - set(even))
        joined = pa.array([texts[k] for k in even], pa.large_string())
        bounds, data = np.frombuffer(joined.buffers()[1], np.int64, len(even) + 1), joined.buffers()[2] or pa.py_buffer(b"")
        cut = _cuts(np.frombuffer(data, np.uint8, bounds[-1]))
        cut[bounds[:-1]] = True
        at = np.append(np.flatnonzero(cut), bounds[-1])
        starts = np.searchsorted(at, bounds)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = known < 0
        self.again[known[~new]] = True
        known[new] = self.count + np.arange(np.count_nonzero(new))
        sizes = np.diff(np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(names) + 1))
        self._learn(list(compress_by(names, new.tolist())), sizes[new])
        take = known[coded.indices.to_numpy()]
        ends = self.ends[: self.count + 1]
        values = gather(self.values[: self.used], ends, take)
        upto = np.concatenate(([0], np.cumsum(np.diff(ends)[take])))[starts]
        if not whole:
            return values, np.diff(upto)
        parts = {k: values[a:b] for k, a, b in zip(even, upto.tolist(), upto[1:].tolist())}
        parts |= {k: np.array(ids, np.uint32) for k, ids in zip(whole, self._encode([texts[k] for k in whole]))}
        ordered = [parts[k] for k in range(len(texts))]
        return np.concatenate(ordered), np.array([len(p) for p in ordered], np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _bucket(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def _pairs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent pairs, their counts, and for each code which of them it is: -1 for none, -2 if that is open.

    Pairs are told apart by a table of hash buckets. Of frequent pairs in one
    bucket one is taken; the others' turn comes in a later round.
    """
    ordered = np.sort(code)
    # A pair at n places equals the one LEAST_COUNT - 1 further on at n - LEAST_COUNT + 1 of them.
    further = LEAST_COUNT - 1
    runs = ordered.take(np.flatnonzero(ordered[further:] == ordered[: max(len(ordered) - further, 0)]))
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(runs), 1), bool), runs[1:] != runs[:-1])))
    pairs, counts = runs[starts], np.diff(starts, append=len(runs)) + further
    _, first = np.unique(_bucket(pairs), return_index=True)
    first.sort()
    pairs, counts = pairs[first], counts[first]
    table = np.full(1 << 20, -1, np.int32)
    table[_bucket(pairs)] = np.arange(len(pairs))
    which = table.take(_bucket(code))
    if len(pairs):
        which[np.flatnonzero((pairs.take(which, mode="clip") != code) & (which >= 0))] = -2
    return pairs, counts, which


def compress(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair over ids and end marks (``base``): the sequence that is left, and the rules, a row (left, right) each.

    A round takes all frequent pairs together. Where occurrences overlap the
    more frequent pair has its way, and every other one from the left within a
    run of one pair; the others wait for a later round. Rounds go on until no
    pair is frequent. Only places that may have a frequent pair are looked at
    again: a pair that is not can become so only by a new symbol.
    """
    # Places are taken by number: a mask that is true here and there costs several times as much.
    seq, rules, known = symbols.astype(np.uint32), [], 0
    active = np.ones(len(seq), bool)
    while len(seq) > 1:
        active[-1] = False
        places = np.flatnonzero(active)
        left, right = seq.take(places), seq.take(places + 1)
        inside = (left != base) & (right != base)
        active[places] = inside
        inside = np.flatnonzero(inside)
        places = places.take(inside)
        code = left.take(inside).astype(np.uint64)
        code <<= np.uint64(32)
        code |= right.take(inside)
        del left, right, inside
        if not len(code):
            break
        pairs, counts, which = _pairs(code)
        if not len(pairs):
            break
        active[places] = which != -1
        hit = np.flatnonzero(which >= 0)
        places, which = places.take(hit), which.take(hit)
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(pairs))
        beside = np.diff(places) == 1
        key = (2 * rank + 1).take(which)
        # Within a run of one pair the second, fourth and so on come after the others.
        again = np.flatnonzero(beside & (which[1:] == which[:-1])) + 1
        run_start = np.flatnonzero(np.diff(again, prepend=-1) != 1)
        nth = np.arange(len(again)) - np.repeat(run_start, np.diff(run_start, append=len(again)))
        key[again[nth % 2 == 0]] -= 1
        more = key[1:] > key[:-1]
        taken = np.ones(len(places), bool)
        taken[1:] = ~beside | more
        taken[:-1] &= ~(beside & more)
        taken = np.flatnonzero(taken)
        places, which = places.take(taken), which.take(taken)
        # The most frequent pair always has so many places.
        good = np.bincount(which, minlength=len(pairs)) >= LEAST_COUNT // 2
        taken = np.flatnonzero(good.take(which))
        places, which = places.take(taken), which.take(taken)
        seq[places] = (base + known + np.cumsum(good)).astype(np.uint32).take(which)
        active[places] = True
        active[np.maximum(places - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        keep = np.flatnonzero(keep)
        seq, active = seq.take(keep), active.take(keep)
        chosen = pairs[good]
        rules.append(np.column_stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        known += len(chosen)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _levels(rules: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """The rules in runs that only use symbols from before the run."""
    newest, at = np.maximum.accumulate(rules.max(axis=1).astype(np.int64) - base) if len(rules) else np.zeros(0, np.int64), 0
    while at < len(rules):
        end = max(at + 1, int(np.searchsorted(newest, at, side="right")))
        yield rules[at:end].astype(np.int64)
        at = end


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many symbols each id, the end mark and each nonterminal stand for."""
    lengths = np.ones(base + 1 + len(rules), np.int64)
    at = base + 1
    for level in _levels(rules, base):
        lengths[at : at + len(level)] = lengths[level].sum(axis=1)
        at += len(level)
    return lengths


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' expansions as one array and its offsets: ids and the end mark stand for themselves."""
    offsets = np.concatenate(([0], np.cumsum(expansion_lengths(rules, base))))
    values = np.empty(offsets[-1], np.uint32)
    values[: base + 1] = np.arange(base + 1, dtype=np.uint32)
    at = base + 1
    for level in _levels(rules, base):
        values[offsets[at] : offsets[at + len(level)]] = gather(values, offsets, level.ravel())
        at += len(level)
    return values, offsets


def write_shard(ids: pa.Array, symbols: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """A shard's payload; ``symbols`` end each document with ``base``, which ``counts`` include."""
    seq, rules = compress(symbols, base)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    ends = np.flatnonzero(seq == base) + 1
    lengths = expansion_lengths(rules, base)[base + 1 :]
    head = np.array([base], np.uint32)
    sections = [sink.getvalue().to_pybytes(), pack_ints(counts), pack_ints(np.diff(ends, prepend=0)), pack_ints(np.concatenate((head, rules.ravel()))), pack_ints(lengths), pack_ints(seq)]
    return MAGIC + b"".join(len(x).to_bytes(8, "little") for x in sections) + b"".join(sections)


class Shard:
    """A payload, read: whole documents or any range of one."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        sizes = [int.from_bytes(payload[4 + 8 * k : 12 + 8 * k], "little") for k in range(6)]
        cuts = np.cumsum([52, *sizes]).tolist()
        doc_ids, counts, own, rules, lengths, seq = (payload[a:b] for a, b in zip(cuts, cuts[1:]))
        self.doc_ids = pa.ipc.open_stream(doc_ids).read_all().column(0).combine_chunks()
        self.counts, self.seq = unpack_ints(counts).astype(np.int64), unpack_ints(seq)
        self.ends = np.concatenate(([0], np.cumsum(unpack_ints(own), dtype=np.int64)))
        numbers = unpack_ints(rules)
        self.base, self.rules = int(numbers[0]), numbers[1:].reshape(-1, 2)
        self.lengths = unpack_ints(lengths).astype(np.int64)

    def all_tokens(self) -> np.ndarray:
        values, offsets = expansions(self.rules, self.base)
        out = gather(values, offsets, self.seq.astype(np.int64))
        out[out == self.base] = END_ID
        return out

    def tokens(self, doc: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Tokens ``start`` to ``stop`` of the shard's document number ``doc``; only the symbols that reach into the range are expanded."""
        stop = int(self.counts[doc]) if stop is None else min(stop, int(self.counts[doc]))
        seq = self.seq[self.ends[doc] : self.ends[doc + 1]]
        sizes = np.ones(len(seq), np.int64)
        rule = seq > self.base
        sizes[rule] = self.lengths[seq[rule].astype(np.int64) - self.base - 1]
        upto = np.cumsum(sizes)
        k = int(np.searchsorted(upto, start, side="right"))
        at, out = int(upto[k] - sizes[k]) if k < len(seq) else stop, []
        while k < len(seq) and at < stop:
            todo = [int(seq[k])]
            while todo:
                x = todo.pop()
                if x > self.base:
                    size = int(self.lengths[x - self.base - 1])
                    if at + size <= start or at >= stop:
                        at += size
                    else:
                        todo += self.rules[x - self.base - 1].tolist()[::-1]
                else:
                    if start <= at < stop:
                        out.append(END_ID if x == self.base else x)
                    at += 1
            k += 1
        return out


_FILE = "part int, nth int, n_docs long, n_tokens long, payload binary"


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, nth = _encoder(path), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            values, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            symbols = np.insert(values, ends, encoder.base)
            payload = write_shard(pa.concat_arrays(ids), symbols, counts + 1, encoder.base)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "n_docs": pa.array([len(texts)], pa.int64()), "n_tokens": pa.array([len(symbols)], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                ids.append(batch.column(0).slice(k, 1))
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= SHARD_CHARS:
                    yield shard()
                    ids, texts, size, nth = [], [], 0, nth + 1
        if texts:
            yield shard()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Tokenise ``docs(doc_id, text)`` and write the file table to ``path``, in ascending id order.

    Null and empty texts are the end id alone. Null ids come first; rows with
    equal ids are ordered by their texts. No row, no shard.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(vocabulary or vocabulary_path()), _FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; ``start`` counts all ids before it."""
    files = spark.read.schema(_FILE).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each range partition
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    spots = files.select("part", "nth", "n_tokens").withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
    spots = spots.select("part", "nth", (F.col("before") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "payload"))):
                shard = Shard(payload)
                tokens = shard.all_tokens().astype("<u4")
                ends = np.concatenate(([0], np.cumsum(shard.counts)))
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                n = len(crc)
                columns = [pa.array([part] * n, pa.int32()), pa.array([nth] * n, pa.int32()), shard.doc_ids, pa.array(ends[:-1]), pa.array(shard.counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32"])

    fields = [("part", T.IntegerType()), ("nth", T.IntegerType()), ("doc_id", id_type), ("inside", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    read = files.select("part", "nth", "payload").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
    return read.join(spots, ["part", "nth"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    write_token_files(docs, path)
    return read_token_files(spark, path, docs.schema["doc_id"].dataType)
