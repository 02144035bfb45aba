"""Chat formatting into prefix trees.

Each turn is written as ``<|start|>role<|sep|>text<|end|>``. Conversations
that begin with the same turns share the nodes of a tree; the tree is laid out
depth first, so the tokens of a shared turn are emitted once. A node carries
its tokens, their position ids (as if its branch stood alone), its offset in
the layout, and the offset intervals of its ancestors, which its tokens may
attend to besides the earlier tokens of their own node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_columns, read_table, stage

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings that a text may not hold as they are: our marks, and those of widespread chat templates.
CONTROL = r"(<|\[)(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
LOSS_ROLE = "assistant"
#: A node in more conversations than this is dealt out in so many copies where it is joined to them.
HOT, SALTS = 64, 16
#: The template marks stand for themselves; all else is encoded byte by byte by the rank file.
VOCABULARY = "byte_bpe_50k.tiktoken"


def escape(text) -> F.Column:
    r"""One more backslash after the first character of each control string; ``unescape`` takes it away."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {mark: len(ranks) + 1 + k for k, mark in enumerate((START, SEP, END))}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, ts, chain): the turns of each conversation in order, and a hash of all turns up to each.

    Null roles and texts count as empty. Turns of a conversation are ordered by
    ``turn``, nulls first; equal turn numbers by role and text, so that the
    order does not depend on the partitions.
    """
    clean = plain_columns(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    listed = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    own = "md5(concat(length(t.role), ':', t.role, t.text))"
    chain = F.expr(f"aggregate(ts, array(X''), (a, t) -> array_append(a, unhex(md5(concat(element_at(a, -1), unhex({own}))))), a -> slice(a, 2, size(a)))")
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("ts"), chain.alias("chain"))


def _tokens(nodes: DataFrame, vocabulary: str) -> DataFrame:
    """``nodes`` with the formatted turn, its tokens, and the tokens that bear loss as (from, to)."""

    @F.pandas_udf("struct<tokens: array<int>, loss_from: int, loss_to: int>")
    def encode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        mark = {m: enc.encode_single_token(m) for m in (START, SEP, END)}
        for roles, texts in parts:
            rows = []
            for role, text in zip(roles, texts):
                head = [mark[START], *enc.encode_ordinary(role), mark[SEP]]
                body = enc.encode_ordinary(text)
                loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
                rows.append(([*head, *body, mark[END]], *loss))
            yield pd.DataFrame(rows, columns=["tokens", "loss_from", "loss_to"])

    return nodes.withColumn("e", encode(escape(F.col("role")), escape(F.col("text")))).select("*", "e.*").drop("e")


def _spread(users: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Salts for a join by ``key`` on which some keys have many users: (key, salt) for each user's side and the other's.

    Only keys of more than ``HOT`` users get more than one salt.
    """
    counted = users.groupBy(key).agg(F.count("*").alias("users"))
    salts = F.explode(F.when(F.col("users") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return counted.select(key, salts.alias("salt")), counted.where(F.col("users") > HOT).select(key)


def _salted_join(users: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``users`` joined to ``table``, a row for each ``key``; a key that a third of all users have is dealt to many tasks."""
    spread, hot = _spread(users, key)
    drawn = users.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hot", F.lit(True))
    drawn = drawn.join(hot, [key, "salt"], "left").withColumn("salt", F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(0))).drop("hot")
    return drawn.join(table.join(spread, key), [key, "salt"]).drop("salt")


def prefix_tree(turns: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree's nodes and the conversations.

    Nodes: node (hash of all turns up to it), depth, tokens, loss_from and
    loss_to (tokens of this node under the loss mask), offset (of its first
    token in the depth-first layout of all trees), position_ids, ancestors
    (array of (start, stop) intervals of the layout, adjoining ones made one).
    Conversations: conv_id, spots (the offset of each of its turns' nodes). No
    turn, no row.

    Sorted by their hash chains, conversations are in depth-first order; each
    brings the nodes that none before it has, as one run of the layout. All
    work is in proportion to the number of turns.
    """
    listed = conversations(turns).repartitionByRange("chain", "conv_id").withColumn("part", F.spark_partition_id())
    row = F.row_number().over(Window.partitionBy("part").orderBy("chain", "conv_id"))
    ranked = stage(listed.withColumn("rank", F.shiftleft(F.col("part").cast("long"), 40) + row).drop("part"))
    paths = ranked.select("conv_id", "rank", F.posexplode("chain").alias("depth", "node"))

    said = ranked.select("rank", F.posexplode(F.arrays_zip("chain", "ts")).alias("depth", "z")).select(F.col("z.chain").alias("node"), "rank", "depth", "z.ts.role", "z.ts.text")
    # A node's turns are the same in all conversations that reach it: this combines before the shuffle.
    distinct = said.groupBy("node").agg(F.min("rank").alias("owner"), F.min("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = stage(_tokens(distinct, vocabulary or vocabulary_path()).drop("role", "text"))

    sized = nodes.select("node", "owner", "depth", F.size("tokens").cast("long").alias("n"))
    runs = sized.groupBy("owner").agg(F.sum("n").alias("n"), F.min("depth").alias("shared")).withColumn("part", F.shiftright("owner", 40))
    totals = runs.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each range partition
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
    runs = stage(runs.select("owner", "shared", (F.col("before") + F.col("inside")).alias("run")))
    own = F.sum("n").over(Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("own", F.coalesce(own, F.lit(0))).join(runs, "owner")
    placed = stage(placed.select("node", "owner", "depth", "n", "run", "shared", (F.col("run") + F.col("own")).alias("offset")))

    walked = _salted_join(paths, placed.select("node", "offset", "n"), "node", "conv_id")
    walked = walked.groupBy("conv_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "offset", "n"))).alias("way"))
    walked = stage(walked)
    # Intervals that adjoin are one: it starts where the node before ends elsewhere, and stops where the next one starts elsewhere.
    starts = "transform(filter(led, (x, i) -> i = 0 OR led[i - 1].offset + led[i - 1].n <> x.offset), x -> x.offset)"
    stops = "transform(filter(led, (x, i) -> i = size(led) - 1 OR led[i + 1].offset <> x.offset + x.n), x -> x.offset + x.n)"
    merged = F.expr(f"zip_with({starts}, {stops}, (a, b) -> struct(a AS start, b AS stop))").alias("above")
    led = runs.join(walked, runs.owner == walked.rank).select("owner", F.expr("slice(way, 1, shared)").alias("led"))
    above = led.select("owner", merged)
    above = above.withColumn("tokens_above", F.expr("aggregate(above, 0L, (a, x) -> a + x.stop - x.start)"))
    spots = placed.join(above, "owner").select(
        "node",
        "offset",
        F.expr("CASE WHEN offset > run THEN concat(above, array(struct(run AS start, offset AS stop))) ELSE above END").alias("ancestors"),
        (F.col("tokens_above") + F.col("offset") - F.col("run")).alias("first"),
    )
    out = nodes.drop("owner").join(spots, "node").withColumn("position_ids", F.expr("sequence(first, first + size(tokens) - 1)")).drop("first")
    return out, walked.select("conv_id", F.expr("transform(way, x -> x.offset)").alias("spots"))


def read_back(nodes: DataFrame, told: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turns): each conversation's turns from the tree's tokens alone, in order.

    A turn is (at, role, text, formatted, loss), decoded from its node's tokens and loss mask.
    """
    vocabulary = vocabulary or vocabulary_path()

    @F.pandas_udf("struct<formatted: string, loss_at: int, loss_chars: int>")
    def decode(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for tokens, starts, stops in parts:
            rows = []
            for t, a, b in zip(tokens, starts, stops):
                head, body, tail = (enc.decode(part.tolist()) for part in (t[:a], t[a:b], t[b:]))
                rows.append((head + body + tail, len(head), len(body)))
            yield pd.DataFrame(rows, columns=["formatted", "loss_at", "loss_chars"])

    said = nodes.select("offset", decode("tokens", "loss_from", "loss_to").alias("d")).select("offset", "d.*")
    wanted = told.select("conv_id", F.posexplode("spots").alias("at", "offset"))
    found = _salted_join(wanted, said, "offset", "conv_id")
    inner = f"^{re.escape(START)}(?s)(.*?){re.escape(SEP)}(.*){re.escape(END)}$"
    turn = lambda t: F.struct(
        t["at"].alias("at"),
        unescape(F.regexp_extract(t["formatted"], inner, 1)).alias("role"),
        unescape(F.regexp_extract(t["formatted"], inner, 2)).alias("text"),
        t["formatted"].alias("formatted"),
        unescape(t["formatted"].substr(t["loss_at"] + 1, t["loss_chars"])).alias("loss"),
    )
    # One copy of each turn crosses the shuffle; it is taken apart afterwards.
    listed = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "formatted", "loss_at", "loss_chars"))).alias("ts"))
    return listed.select("conv_id", F.transform("ts", turn).alias("turns"))


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = plain_columns(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    nodes, index = prefix_tree(turns.unionByName(extra))
    told = read_back(nodes, index)
    whole = lambda x: F.array_join(F.transform("turns", x), "")
    loss = whole(lambda t: t["loss"])
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole(lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(whole(lambda t: t["formatted"])).cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, regexp_replace(role, '(<|\[)(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS er,
        regexp_replace(text, '(<|\[)(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS et FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(length(er) + length(et) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
