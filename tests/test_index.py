"""The stored index: scores, bounds, phrases and pruning against plain Python over the same tokens."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import runs
from lexiloom.plans import index as ix
from lexiloom.plans import queries as q
from lexiloom.plans import search as s

WORDS = ["red", "ring", "rod", "old", "big", "the", "x"]
BOOSTS = {"name": 2.0, "note": 1.5}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choices(WORDS, weights=[3, 3, 2, 2, 1, 9, 1], k=rng.randint(0, n)))
    return [(k, pick(6), pick(60)) for k in range(400)] + [(1000, None, "only here: rare"), (1001, "", None)]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "id long, name string, note string").repartition(5)
    return ix.write_index(s.postings(df, "id", ["name", "note"]), f"file://{tmp_path_factory.mktemp('index')}/one", 400, shards=8, block_docs=40)


def tokens(rows):
    out = {}
    for k, name, note in rows:
        for f, text in (("name", name), ("note", note)):
            words = (text or "").replace(":", " ").split()
            if words:
                out[k, f] = words
    return out


def word_scores(rows, words):
    toks = tokens(rows)
    n, total, df = Counter(), Counter(), Counter()
    for (_, f), ws in toks.items():
        n[f] += 1
        total[f] += len(ws)
        df.update((w, f) for w in set(ws))
    out = {}
    for (k, f), ws in toks.items():
        for w in set(words) & set(ws):
            idf = math.log(1 + (n[f] - df[w, f] + 0.5) / (df[w, f] + 0.5))
            tf = ws.count(w)
            out[k, f, w] = BOOSTS[f] * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / (total[f] / n[f])))
    return out


def best_field(rows, words):
    sums = defaultdict(Counter)
    for (k, f, _), x in word_scores(rows, words).items():
        sums[k][f] += x
    return {k: max(v.values()) for k, v in sums.items()}


@pytest.mark.parametrize("words", [["red", "ring"], ["the"], ["rare", "x", "nowhere"], ["nowhere"], []])
def test_best_field_scores(stored, rows, words):
    got = {r.doc: r.score for r in stored.best_field(words, BOOSTS).collect()}
    assert got == pytest.approx(best_field(rows, words))


@pytest.mark.parametrize("words", [["red", "ring"], ["the"], ["rare", "x"], ["nowhere"]])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_is_the_sorted_whole(stored, rows, words, k):
    want = sorted(((-round(v, 9), d) for d, v in best_field(rows, words).items()))[:k]
    got = stored.top(words, BOOSTS, k).collect()
    assert [r.doc for r in got] == [d for _, d in want] and [-r.score for r in got] == pytest.approx([x for x, _ in want])


def test_bounds_hold_and_leave_blocks_out(stored, rows):
    scores = best_field(rows, ["red", "ring"])
    groups = {r.doc: r.grp for r in stored.blocks(["red", "ring"]).select("grp", F.explode("docs.doc").alias("doc")).collect()}
    bounds = {r.grp: r.bound for r in stored.bounds(["red", "ring"], BOOSTS).collect()}
    assert all(scores[d] <= bounds[g] for d, g in groups.items())
    third = sorted(scores.values())[-3]
    assert sum(b >= third for b in bounds.values()) < len(bounds)


def test_searches_prune_folders_and_terms(stored):
    plan = stored.blocks(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [(shard" in plan or "PartitionFilters: [shard" in plan
    assert "PushedFilters: [EqualTo(term,red)]" in plan or "In(term" in plan or "EqualTo(term,red)" in plan
    bounds = stored.bounds(["red"], BOOSTS)._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in bounds


def phrase_hits(rows, words, fields, slop):
    """All ways to give each word a place of its own; the places, moved back, lie within the slop."""
    out = set()
    for (k, f), ws in tokens(rows).items():
        if f in fields:
            spots = [[p for p, w in enumerate(ws) if w == word] for word in words]
            for way in product(*spots):
                moved = [p - i for i, p in enumerate(way)]
                if len(set(way)) == len(way) and max(moved) - min(moved) <= slop:
                    out.add((k, f))
                    break
    return out


@pytest.mark.parametrize("words", [["red", "ring"], ["old", "red", "rod"], ["red", "red"], ["the", "big", "the"], ["x"], ["red", "nowhere"]])
@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases(stored, rows, words, slop):
    few = [r for r in rows if r[0] % 7 == 0 or r[0] > 900]
    want = phrase_hits(few, words, ["name", "note"], slop)
    got = {(r.doc, r.field) for r in stored.phrase(words, ["name", "note"], slop).collect() if r.doc % 7 == 0 or r.doc > 900}
    assert got == want


def test_clauses_score_their_best_way(stored, rows):
    asked = [q.clause("red"), q.clause("rod", ("old big",))]
    per = defaultdict(dict)
    for (k, _, w), x in word_scores(rows, ["red", "rod", "old", "big"]).items():
        per[k][w] = max(x, per[k].get(w, 0))
    want = {}
    for k, ws in per.items():
        ways = [sum(ws[w] for w in way) for way in (("rod",), ("old", "big")) if all(w in ws for w in way)]
        if "red" in ws and ways:
            want[k] = ws["red"] + max(ways)
    assert {r.doc: r.score for r in stored.matches(asked, BOOSTS).collect()} == pytest.approx(want)


def test_fields_are_counted_once(stored, rows):
    toks = tokens(rows)
    got = {r.field: (r.n_docs, r.tokens) for r in stored.table("fields").collect()}
    assert got == {f: (sum(g == f for _, g in toks), sum(len(w) for (_, g), w in toks.items() if g == f)) for f in BOOSTS}


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, name string")
    empty = ix.write_index(s.postings(none, "id", ["name"]), f"file://{tmp_path}/none", 0)
    assert empty.best_field(["red"], {"name": 1.0}).count() == 0
    assert empty.top(["red"], {"name": 1.0}, 5).count() == 0
    assert empty.phrase(["red", "ring"], ["name"]).count() == 0


def test_texts_are_stored_without_moving_their_words(spark, rows, stored, tmp_path, monkeypatch):
    """The same index as that of the postings; the only shuffles are those that count ids, terms and fields."""
    df = spark.createDataFrame(rows, "id long, name string, note string").repartition(5)
    plans = []
    run = ix._stored
    monkeypatch.setattr(ix, "_stored", lambda told, *more: plans.append(told._jdf.queryExecution().executedPlan().toString()) or run(told, *more))
    monkeypatch.setattr(ix, "HELD_POSTINGS", 500)
    monkeypatch.setattr(ix, "TEXT_ROWS", 7)
    texts = ix.write_texts(df.persist(), "id", ["name", "note"], f"file://{tmp_path}/texts", shards=8, block_docs=40)
    assert plans and "hashpartitioning" not in plans[0] and "rangepartitioning" not in plans[0]
    docs = lambda index: sorted(map(str, index.table("blocks").select("term", "field", F.explode("docs").alias("d")).select("term", "field", "d.*").collect()))
    assert docs(texts) == docs(stored)
    for name in ("terms", "fields"):
        assert sorted(map(str, texts.table(name).collect())) == sorted(map(str, stored.table(name).collect()))
    assert texts.table("blocks").groupBy("term", "field", "grp").count().where("count > 1").isEmpty()
    assert texts.table("blocks").agg(F.max("n")).first()[0] <= 40


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    df = spark.createDataFrame([("a", "red ring"), ("b", "red"), ("a", "rod red"), (None, "red")], "id string, name string")
    index = ix.write_texts(df, "id", ["name"], f"file://{tmp_path}/same")
    got = {r.doc: (r.tf, r.dl) for r in index.blocks(["red"]).select(F.explode("docs").alias("d")).select("d.*").collect()}
    assert got == {"a": (2, 4), "b": (1, 1)} and index.table("fields").first()["n_docs"] == 2


def test_equal_scores_are_ordered_by_document(spark, tmp_path):
    """Differences in the digits past the ninth, which depend on the order of sums, are no order."""
    heads = "term string, field string, grp long, n long, heads long, tokens long, max_tf int, min_dl long, docs array<struct<doc: long, tf: int, dl: long, positions: array<int>>>, shard int"
    # Of two documents the later one's text is longer by a hair.
    rows = [("red", "name", k, 1, 1, 10**12 + 9 - k, 1, 10**12 + 9 - k, [(k, 1, 10**12 + 9 - k, [0])], 0) for k in range(10)]
    spark.createDataFrame(rows, heads).write.partitionBy("shard").parquet(f"file://{tmp_path}/tie/blocks")
    spark.createDataFrame([("red", "name", 10, 0)], "term string, field string, df long, shard int").write.partitionBy("shard").parquet(f"file://{tmp_path}/tie/terms")
    spark.createDataFrame([("name", 1000, 10**15)], "field string, n_docs long, tokens long").write.parquet(f"file://{tmp_path}/tie/fields")
    index = ix.StoredIndex(spark, f"file://{tmp_path}/tie", "bigint", 1)
    assert [r.doc for r in index.top(["red"], {"name": 1.0}, 3).collect()] == [0, 1, 2]


def test_terms_are_the_runs_of_words(spark):
    """Against all runs, of which those with a character that is no symbol or white space are terms."""
    rng = random.Random(3)
    pool = "ab Z9,.!-#$ \n\t ・゠ーアあ漢한ㄱ゛゜ªºǅʰ̈É½²٣\U0001f600\U00010400\U00020000　 ​\u001f"
    df = spark.createDataFrame([("".join(rng.choices(pool, k=rng.randint(0, 30))),) for _ in range(4000)] + [("",)], "text string")
    plain = F.filter(runs(F.col("text")), lambda t: t.rlike(r"[^\p{javaWhitespace}\p{P}\p{S}]"))
    assert df.where(~plain.eqNullSafe(s.terms_of(F.col("text")))).isEmpty()
