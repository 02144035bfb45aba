"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions. A block of some million
characters keeps one entry for each distinct pre-token with all positions of
it, so what is shuffled is (word, block) pairs, not occurrences. All entries
of a word meet in the shard of the word's hash, where it is encoded once; its
ids go back to every block and are put at their positions there. Rows travel
packed, one for each block and shard.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read_table, release_memory
from .packing import gather, pack_ints, pack_strings, unpack_ints, unpack_strings

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text that make a block; a longer text is a block by itself.
BLOCK_CHARS = 6_000_000
#: Words whose ids a task remembers; it forgets them all when there are more.
REMEMBERED = 500_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("distinct-words", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


_PACKED = "dest int, kind int, block string, shard int, docs binary, counts binary, body binary"
_PACKED_ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("block", pa.string()), ("shard", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])
#: Kinds of packed rows. Answers sort before the block's own row, which needs them.
_WORDS, _ANSWER, _BLOCK = 0, 1, 2


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The packed rows, one at a time; a batch may hold those of many blocks."""
    for batch in batches:
        for k in range(len(batch)):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED_ARROW)], schema=_PACKED_ARROW)


def _pack_block(name: str, ids: pa.Array, number: dict[str, int], docs: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """One block as packed rows. ``number`` has its distinct words by first appearance, ``docs`` the numbers of each text's words.

    The words are numbered anew by falling count. Those that occur once come
    last, in order of appearance, and stand as 0 in the sequence.
    """
    sequence = np.concatenate(docs)
    counts = np.bincount(sequence, minlength=len(number))
    order = np.argsort(-counts, kind="stable")
    often = int((counts > 1).sum())
    place = np.empty(len(number), np.uint32)
    place[order] = np.concatenate((np.arange(1, often + 1), np.zeros(len(number) - often, np.int64)))
    words = [w.encode("utf-8", "replace") for w in number]
    words = [words[at] for at in order.tolist()]
    shard_of = np.fromiter((zlib.crc32(w) % shards for w in words), np.uint32, len(words))
    by_shard: dict[int, list[bytes]] = {}
    for shard, word in zip(shard_of.tolist(), words):
        by_shard.setdefault(shard, []).append(word)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    where = pack_ints(shard_of)
    body = often.to_bytes(8, "little") + len(where).to_bytes(8, "little") + where + pack_ints(place[sequence])
    own_row = (zlib.crc32(name.encode()) % shards, _BLOCK, name, -1, sink.getvalue().to_pybytes(), pack_ints([len(d) for d in docs]), body)
    return _rows([own_row] + [(s, _WORDS, name, s, None, None, pack_strings(own)) for s, own in sorted(by_shard.items())])


def _explode(pattern: str, shards: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, part, nth = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, docs, number, size = [], [], {}, 0
        for batch in batches:
            texts = batch.column(1)
            for k in range(len(batch)):
                text = texts[k].as_py() or ""
                words = find(text)
                ids.append(batch.column(0).slice(k, 1))
                docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                size += len(text)
                if size >= block_chars:
                    yield _pack_block(f"{part}-{nth}", pa.concat_arrays(ids), number, docs, shards)
                    ids, docs, number, size, nth = [], [], {}, 0, nth + 1
        if ids:
            yield _pack_block(f"{part}-{nth}", pa.concat_arrays(ids), number, docs, shards)
        del ids, docs, number
        release_memory()

    return run


def _encode_words(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _encoder(path, pattern), {}
        for row in _each(batches):
            if row["kind"] != _WORDS:
                yield _rows([tuple(row.values())])
                continue
            if len(known) > REMEMBERED:
                known.clear()
            words = unpack_strings(row["body"])
            for word in words:
                if word not in known:
                    known[word] = encoder.encode_ordinary(word.decode())  # a pre-token alone is one match of the pattern
            ids = [known[w] for w in words]
            lengths = pack_ints([len(i) for i in ids])
            body = len(lengths).to_bytes(8, "little") + lengths + pack_ints([x for i in ids for x in i])
            yield _rows([(row["dest"], _ANSWER, row["block"], row["shard"], None, None, body)])
        known.clear()
        release_memory()

    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, name = {}, None
    for row in _each(batches):
        if row["block"] != name:
            held, name = {}, row["block"]
        if row["kind"] == _ANSWER:
            cut = 8 + int.from_bytes(row["body"][:8], "little")
            held[row["shard"]] = (unpack_ints(row["body"][8:cut]), unpack_ints(row["body"][cut:]))
            continue
        often, cut = int.from_bytes(row["body"][:8], "little"), 16 + int.from_bytes(row["body"][8:16], "little")
        # A shard's answers are in the order of its words in the block.
        shard_of = unpack_ints(row["body"][16:cut])
        once = len(shard_of) - often
        answers = [(np.flatnonzero(shard_of == shard), *held[shard]) for shard in sorted(held)]
        if any(len(spots) != len(own) for spots, own, _ in answers) or sum(len(spots) for spots, _, _ in answers) != len(shard_of):
            raise RuntimeError(f"block {name} has not got all its words back")
        lengths = np.zeros(often + once, np.int64)
        for spots, own, _ in answers:
            lengths[spots] = own
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        values = np.empty(int(offsets[-1]), np.int32)
        for spots, own, ids in answers:
            ends = np.cumsum(own, dtype=np.int64)
            values[np.arange(len(ids)) + np.repeat(offsets[spots] - (ends - own), own)] = ids
        sequence = unpack_ints(row["body"][cut:]).astype(np.int64) - 1
        rare = sequence < 0
        sequence[rare] = often + np.arange(once)
        per_doc = unpack_ints(row["counts"]).astype(np.int64)
        doc_ends = np.concatenate(([0], np.cumsum(per_doc)))
        token_ends = np.concatenate(([0], np.cumsum(lengths[sequence])))[doc_ends]
        all_ids = pa.array(gather(values, offsets, sequence), pa.int32())
        ids = pa.ipc.open_stream(row["docs"]).read_all().column(0).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(token_ends, pa.int32()), all_ids)
        step = 500
        for at in range(0, len(ids), step):
            yield pa.RecordBatch.from_arrays([ids.slice(at, step), lists.slice(at, step)], ["doc_id", "ids"])
        held = {}
    held.clear()
    release_memory()


def _gathered(docs: DataFrame, path: str, pattern: str, block_chars: int) -> DataFrame:
    """Packed blocks, each after the answers for all its words."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("doc_id", "text").mapInArrow(_explode(pattern, shards, block_chars), _PACKED)
    answered = packed.repartition("dest").mapInArrow(_encode_words(path, pattern), _PACKED)
    return answered.repartition("block").sortWithinPartitions("block", "kind", "shard")


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole ``text``.

    Null and empty texts have an empty list; no special token is looked for or
    added. Every row has its own, repeated ids included. ``vocabulary`` is a
    rank file; ``pattern`` cuts the pre-tokens. Smaller blocks take less memory and
    move more.
    """
    gathered = _gathered(docs, vocabulary or vocabulary_path(), pattern or default_pattern(), block_chars)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return gathered.mapInArrow(_reassemble, schema)


def _decoder(path: str, columns: list[str]):
    """Adds ``decoded`` to batches of ``columns``, among them ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        table = pa.array(by_id, pa.large_binary())
        for batch in batches:
            lists = batch.column(columns.index("ids"))
            ids = lists.flatten()
            tokens = table.take(ids)
            if tokens.null_count > ids.null_count:
                raise ValueError("an id is not in the vocabulary")
            ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
            data = tokens.buffers()[2].to_pybytes() if len(tokens) else b""
            lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            cuts = ends[np.concatenate(([0], np.cumsum(lengths)))].tolist()
            out = [data[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*columns, "decoded"])

    return run


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of the tokens in ``ids``, joined to the token-byte table.

    That table has as many rows as the vocabulary, which the rank file fixes,
    so each task holds it and looks the ids up. A null list gives null; an
    unknown id fails the job.
    """
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])
    columns = [f.name for f in fields]
    return encoded.select(*columns).mapInArrow(_decoder(vocabulary or vocabulary_path(), columns), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of batches (doc_id, ids, decoded), for which the ids are written as decimals."""
    for batch in batches:
        lists, decoded = batch.column(1), batch.column(2)
        numbers = lists.flatten().cast(pa.string())
        ends = np.frombuffer(numbers.buffers()[1], np.int32)[: len(numbers) + 1].astype(np.int64) if len(numbers) else np.zeros(1, np.int64)
        cuts = np.concatenate(([0], np.cumsum(np.array(lists.value_lengths().to_pylist(), np.int64))))
        # Each number and a space after it, of which the last one of a text goes.
        spaced = np.full(int(ends[-1]) + len(numbers), 32, np.uint8)
        if len(numbers):
            keep = np.ones(len(spaced), bool)
            keep[ends[1:] + np.arange(len(numbers))] = False
            spaced[keep] = np.frombuffer(numbers.buffers()[2], np.uint8)[: int(ends[-1])]
        text, starts = spaced.tobytes(), ends[cuts] + cuts
        ids = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(starts.tolist(), starts[1:].tolist())]
        raw = [hashlib.sha256(x.as_py()).hexdigest() for x in decoded]
        columns = [batch.column(0), pa.array(np.diff(cuts)), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) after a round trip through the ids.

    The same steps as ``bpe_encode`` and ``bpe_decode``, the last of them in one worker.
    """
    path = vocabulary_path()
    gathered = _gathered(docs, path, default_pattern(), block_chars)
    decode = _decoder(path, ["doc_id", "ids"])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return gathered.mapInArrow(lambda batches: _digests(decode(_reassemble(batches))), schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
