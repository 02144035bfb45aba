"""The typed lattice against all paths, and joined dictionaries against those in memory."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom import api
from lexiloom.operators import analyze as a
from lexiloom.operators import lattice
from lexiloom.operators.rules import HIGHLIGHT, INDEX, SEARCH, Options, analyse
from lexiloom.operators.segment import Dictionaries, best_path, fold, nodes, segment

WORDS = {"충전": -6.0, "전배": -5.5, "배터리": -7.0, "배": -9.0, "터": -9.5, "리": -9.0, "립": -8.0, "스": -15.0, "2리": -7.0, "TV": -8.0, "가": -5.0, "나": -5.0, "가나": -30.0}


def every_path(text, ends, at):
    if at == 0:
        yield []
        return
    for start, tag, score in ends[at]:
        for before in every_path(text, ends, start):
            yield [*before, (start, at, tag, score)]


def allowed(text, path, d):
    for (s, e, tag, _), (s2, e2, tag2, _) in zip(path, path[1:]):
        if tag == tag2 and tag in ("DIGIT", "ALPHA", "SYMBOL"):
            return False
        if tag == tag2 == "WORD" and e - s == e2 - s2 == 1 and fold(text[s:e2]) in d:
            return False
    return not (len(text) > 1 and all(e - s == 1 for s, e, *_ in path) and path[-1][2] in ("WORD", "UNKNOWN"))


def test_best_path_is_best_of_all_paths():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices("충전배터리립스가나은는를에게2TV-", k=rng.randint(1, 8)))
        ends = nodes(text, WORDS.get)
        paths = [p for p in every_path(text, ends, len(text)) if allowed(text, p, WORDS)]
        got = best_path(text, ends, WORDS.__contains__)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
        if not paths:
            assert got == [(0, len(text), False)]
            continue
        most = max(sum(x[3] for x in p) for p in paths)
        shapes = []
        for p in paths:
            if sum(x[3] for x in p) == most:
                merged = []
                for s, e, tag, _ in p:
                    if merged and tag == "UNKNOWN" and not merged[-1][2]:
                        merged[-1] = (merged[-1][0], e, False)
                    else:
                        merged.append((s, e, tag != "UNKNOWN"))
                shapes.append(merged)
        assert got in shapes


def words_of(text, d):
    return [text[a:b] for a, b, _ in segment(text, d)]


def test_rules_of_the_lattice():
    d = Dictionaries(words=WORDS)
    assert words_of("충전배터리", d) == ["충전", "배터리"]
    assert words_of("배터리는", d) == ["배터리", "는"] and segment("배터리은", d)[-1] == (3, 4, False)
    assert words_of("123충전", d) == ["123", "충전"] and words_of("12리", d) == ["1", "2리"]
    assert words_of("AB충전-", d) == ["AB", "충전", "-"]
    assert words_of("가나", d) == ["가나"]  # two words of one character, which are one word together
    assert words_of("배리", d) == ["배리"]  # only words of one character: unknown as a whole
    assert words_of("배리는", d)[-1] == "는"
    assert words_of("", d) == []


def test_segments_by_join(spark):
    rng = random.Random(7)
    chunks = ["".join(rng.choices("충전배터리립스가나은는를2tV-", k=rng.randint(1, 12))) for _ in range(200)] + ["", None, "충전배터리" * 30]
    df = spark.createDataFrame([(c, 1) for c in chunks] * 2, "chunk string, score int").repartition(3)
    words = spark.createDataFrame([(w.lower(), s) for w, s in WORDS.items()] + [("충전", -20.0)], "word string, score double")
    got = {r.chunk: r.words for r in lattice.segments(df, words).collect()}
    d = Dictionaries(words=WORDS)
    assert got == {c: words_of(c, d) for c in chunks if c is not None}


SOURCE = """
    ('1', NULL, 'red,crimson', 'SYNONYM'), ('2', 'widget', 'gizmo x-1,round thing', 'SYNONYM'), ('3', 'CM', NULL, 'UNIT'), ('4', 'KG', NULL, 'UNIT'), ('5', 'old', NULL, 'STOP'),
    ('6', 'ring', NULL, 'USER'), ('7', 'plate', 'disc,old,flat', 'COMPOUND'), ('8', '립 스테이크', NULL, 'SPACE'), ('9', '스테이크', NULL, 'USER'), ('10', '12345', NULL, 'STOP'), ('11', '1234567', NULL, 'STOP'),
    ('12', NULL, 'CM,센티', 'UNIT_SYNONYM'), ('13', 'and', NULL, 'STOP'), ('14', 'A-1/b', NULL, 'STOP'), ('15', '스테', NULL, 'USER'), ('16', 'ab', NULL, 'STOP'), ('17', '1.52', NULL, 'STOP'), ('18', 'thing', 'part one', 'SYNONYM')
"""
TEXTS = [
    "Brand#13 red plate 24cm", "립스테이크는 10cmx12cm", "old 12,345 and 1,234,567cm", "a-1/b x", "12-345 / 1.5-2", "a-b", "widget widgets WIDGET", "스테이크2kg 15센티", None, "", "  ",
    "thing-thing/thing 100:20", "ring-old_ring", "x" * 50 + " plate", "일이삼사오 스테 립 스테이크",
]


def as_rows(found):
    return [(t.term, t.type, t.start, t.stop, t.pos_inc, t.synonyms, [(e.term, e.type, e.synonyms) for e in t.extras]) for t in found]


@pytest.fixture(scope="module")
def both(spark):
    source = spark.sql(f"SELECT * FROM VALUES {SOURCE} AS v(id, keyword, value, type)")
    return a.load_dictionaries(source), a.load_dictionaries(source, rows=0)


@pytest.mark.parametrize("options", [INDEX, SEARCH, HIGHLIGHT, Options(for_query=True, full_string=True, drop_stop=False)])
def test_joined_dictionaries_give_the_same_tokens(spark, small, both, options):
    memory, table = both
    assert isinstance(memory, Dictionaries) and isinstance(table, lattice.DictionaryTable)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("k"), "text").limit(60)
    part = spark.read.parquet(f"{small}/part.parquet").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_brand", "p_name", F.concat("p_size", F.lit("cm"))).alias("text"))
    own = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    for df in (own.unionByName(own), part, docs):
        got, want = (Counter((r.k, r.text, str(r.tokens)) for r in a.with_tokens(df, "text", x, options).collect()) for x in (table, memory))
        assert got == want


def test_one_text_needs_few_rows(both):
    memory, table = both
    for text in TEXTS:
        for options in (INDEX, SEARCH):
            assert as_rows(analyse(text, table.of_text(text), options)) == as_rows(analyse(text, memory, options))


def test_engine_with_joined_dictionaries(spark, small, tmp_path):
    source = spark.sql(f"SELECT * FROM VALUES {SOURCE} AS v(id, keyword, value, type)")
    part = spark.read.parquet(f"{small}/part.parquet")
    found = []
    for rows in (0, 100):
        engine = api.engine(source, rows=rows)
        stored = engine.store(part, "p_partkey", ["p_name", "p_brand"], f"file://{tmp_path}/index{rows}")
        page = engine.search(part, stored, "p_partkey", "p_name^2,p_brand", "red widget", size=200, highlight={"fields": ["p_name"]})
        found.append([(r.p_partkey, r.p_name, round(r.score, 9)) for r in page.collect()])
        assert engine.total(stored, "p_name,p_brand", "red widget") == len(found[-1])
        assert engine.is_loaded()
    assert found[0] == found[1] and len(found[0]) > 0
    scores = [s for *_, s in found[0]]
    assert scores == sorted(scores, reverse=True)
