"""The library's surface, sources and sinks."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lexiloom import analysis_queries, api
from lexiloom.functions import text
from lexiloom.operators import analyze as a
from lexiloom.operators import dictionaries as d
from lexiloom.operators.rules import Options, analyse
from lexiloom.operators.segment import Dictionaries
from lexiloom.plans import mapping
from lexiloom.plans import pages
from lexiloom.plans import queries as q
from lexiloom.plans import search as s
from lexiloom.sources import records
from lexiloom.streaming.ingest import ingest_stream

SOURCE = [
    ("1", None, "LG,엘지", "SYNONYM"), ("2", "집업", "zip up", "SYNONYM"), ("3", "CM", None, "UNIT"), ("4", None, "TB,테라", "UNIT_SYNONYM"), ("5", "TB", None, "UNIT"),
    ("6", "판매", None, "STOP"), ("7", "노트북", None, "USER"), ("8", "립 스테이크", None, "SPACE"), ("9", "테니스화", "테니스,신발", "COMPOUND"), ("10", "LG", "100", "MAKER"),
]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(SOURCE, "id string, keyword string, value string, type string")


@pytest.fixture(scope="module")
def engine(source):
    return api.engine(source)


def test_number_cases(spark):
    good = "1 123 1234 12345 1,234 1,234,567 12,345,678 1.2 1.234 1.234.567 100:100 1,234:5,678".split()
    df = spark.createDataFrame([(w,) for w in [*good, "1,2,3,4"]], "w string")
    assert [r.w for r in df.where(text.is_number(F.col("w"))).collect()] == good


def test_analysis_and_expansion(engine, spark):
    assert engine.is_loaded()
    assert engine.synonyms("LG") == ["엘지"] and engine.synonyms("nothing") == []
    told = engine.expand_keywords("LG 노트북 1TB 판매")
    assert told[0]["type"] == "FULL_STRING" and [t["term"] for t in told[1:]] == ["LG", "노트북", "1TB"] and told[3]["synonyms"] == ["1테라"]
    df = spark.createDataFrame([(1, "테니스화 ab12-cd 판매"), (2, None)], "id long, name string")
    row = engine.analyze(df, "name", for_query=False, drop_stop=False).orderBy("id").first()
    assert row.detail.stop == ["판매"] and "ab12-cd" in row.detail.model and "테니스화" in row.detail.compound
    maps = spark.createDataFrame([({"a": "립스테이크", "b": " "},)], "fields map<string,string>")
    assert engine.multi_analyze(maps).first().terms == {"a": ["립", "스테이크"]}


def test_search_page(engine, spark):
    table = spark.createDataFrame([(1, "LG 노트북 15Z960", "Y", 5), (2, "엘지 노트북", "Y", 9), (3, "LG TV", "Y", 1), (4, "노트북 LG", "N", 3)], "id long, name string, shown string, rank int")
    postings = engine.index(table, "id", ["name"])
    asked = {"function_score": {"query": {"bool": {"must": {"match": {"name": "x"}}, "filter": {"term": {"shown": "Y"}}}}, "functions": [{"filter": {"range": {"rank": {"gt": 6}}}, "weight": 50}], "boost_mode": "sum"}}
    rows = engine.search(table, postings, "id", "name^2", "LG 노트북", asked, highlight={"fields": ["name"], "pre_tags": ["<em>"], "post_tags": ["</em>"]}).collect()
    assert [(r.id, r._rownum) for r in rows] == [(2, 0), (1, 1)] and rows[1].name == "<em>LG</em> <em>노트북</em> 15Z960"
    assert engine.search(table, postings, "id", "name", "LG 노트북", start=1, size=1).first()._rownum == 1
    other = {"boosting": {"positive": {"range": {"rank": {"gte": 3}}}, "negative": {"term": {"shown": "N"}}, "negative_boost": 0.25}}
    rows = engine.search(table, postings, "id", "name", "no such words", {"function_score": {"query": other}}).collect()
    assert [(r.id, r.score) for r in rows] == [(1, 1.0), (2, 1.0), (4, 0.25)]
    beside = {"function_score": {"query": {"bool": {"must": {"match": {"name": "x"}}, "should": {"term": {"rank": 5}}}}}}
    assert {r.id for r in engine.search(table, postings, "id", "name", "LG 노트북", beside).collect()} == {1, 2, 4}
    built = engine.build_query("name", "LG")["query"]
    assert built["bool"]["must"][0]["bool"]["should"][1]["multi_match"]["query"] == "엘지"
    assert engine.explain("LG 노트북") == {"AND": [{"OR": ["LG", "엘지"]}, "노트북"]} and engine.total(postings, "name", "LG 노트북") == 3


def test_records_in_other_charsets(spark, tmp_path):
    lines = ['[%A%]"가나", [%B%]1', "", "no key", " [%A%]x[%A%]y[%C%]"]
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        for charset in ("EUC-KR", "UTF-8", "UTF-16"):
            (tmp_path / "in" / "a.txt").write_bytes("\r\n".join(lines).encode(charset))
            read = records.read_lines(spark, [str(tmp_path / "in")], charset)
            got = sorted(([*sorted(r.fields.items())] for r in records.parse_records(read).collect()), key=str)
            assert got == [[("A", '"가나", '), ("B", "1")], [("A", "y"), ("C", "")]]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_addresses(spark):
    df = spark.createDataFrame([("http://a/b?x=1%20+2#f",), ("/p",), ("?%zz",)], "u string")
    assert [tuple(r) for r in df.select(text.url_path(F.col("u")), text.url_query(F.col("u"))).collect()] == [("http://a/b", "?x=1 +2#f"), ("/p", ""), ("", None)]


def test_user_queries(spark):
    df = spark.createDataFrame([(1, "a b c", 5), (2, "b c d", 7), (3, None, 9)], "id long, t string, n int")
    ids = lambda query: [r.id for r in df.where(q.predicate(query)).orderBy("id").collect()]
    import base64

    wrapped = base64.b64encode(json.dumps({"term": {"n": 9}}).encode()).decode()
    assert ids({"wrapper": {"query": wrapped}}) == [3]
    assert ids({"match": {"t": {"query": "a d", "operator": "and"}}}) == [] and ids({"match": {"t": "a d"}}) == [1, 2]
    assert ids({"match_phrase": {"t": "b c"}}) == [1, 2] and ids({"boosting": {"positive": {"term": {"n": 5}}, "negative": {}}}) == [1]
    assert ids({"bool": {"should": [{"term": {"n": 5}}, {"term": {"n": 9}}]}}) == [1, 3]
    assert ids({"function_score": {"query": {"range": {"n": {"gte": 7}}}}}) == [2, 3]
    with pytest.raises(ValueError):
        q.predicate({"geo": {}})


def test_dictionaries(source, spark, tmp_path):
    log = spark.createDataFrame([("STOP", "2020-01-01 00:00:00", 7)], "id string, applied_time string, count long")
    built, log = api.compile_dictionaries(source, log, None, "2024-05-06 07:08:09")
    assert {r.id: r["count"] for r in log.collect()}["STOP"] == 1
    api.save_dictionaries(built, str(tmp_path / "d"))
    again = {name: api.read_dictionary(spark, str(tmp_path / "d"), name) for name in built}
    rows = {(r.type, r.keyword, r.value) for r in api.restore_dictionaries(again).collect()}
    assert ("SYNONYM", None, "LG,엘지") in rows and ("SPACE", "립 스테이크", None) in rows and ("COMPOUND", "테니스화", "테니스,신발") in rows
    info = {r.name: r for r in api.dict_info(source, log).collect()}
    assert len(info) == 12 and info["STOP"]["count"] == 1 and info["STOP"].applied_time == "2024-05-06 07:08:09" and info["USER"].kind == "SET"
    system = spark.createDataFrame([("LG", "N", -5.0)], "word string, tag string, prob double")
    assert {(r.type, r.prob) for r in api.dict_find(source, "LG", system).collect()} == {("SYSTEM", -5.0), ("SYNONYM", None), ("MAKER", None)}
    assert api.dict_find(source, "판매").first().type == "STOP"
    some, _ = api.compile_dictionaries(source, log, "stop, unit", "2024-05-06 07:08:09")
    assert set(some) == {"stop", "unit"}
    lines = spark.createDataFrame([("가", "/x/01.N.HIGH.txt"), ("#c", "/x/01.N.HIGH.txt"), ("나", "/x/02.V.ODD.txt")], "value string, path string")
    assert {tuple(r) for r in d.words_by_file(lines).collect()} == {("가", "N", -8.0), ("나", "V", -16.0)}


def test_record_files(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    lines = "[%PRODUCTCODE%]1001[%PRODUCTNAME%]엘지 NOTEBOOK[%REGISTERDATE%]20190301[%PRICE%]990000\n[%PRODUCTCODE%]1002[%PRODUCTNAME%][%REGISTERDATE%]\nno key\n[%A%]1[%A%]2\n"
    (folder / "a.txt").write_bytes(lines.encode("euc-kr"))
    schema = {"PRODUCTCODE": "bigint", "PRODUCTNAME": "string", "REGISTERDATE": "timestamp", "PRICE": "float", "A": "string"}
    api.ingest_text(spark, [str(tmp_path / "in")], str(tmp_path / "out"), schema)
    rows = {r.PRODUCTCODE: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1001].PRODUCTNAME == "엘지 NOTEBOOK" and rows[1001].REGISTERDATE.year == 2019 and rows[1001].PRICE == 990000.0
    assert rows[1002].PRODUCTNAME == "" and rows[1002].REGISTERDATE is None and rows[None].A == "2" and len(rows) == 3
    records.export_text(spark.sql("SELECT 1 AS A, 'x\ty' AS B"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first().value.strip() == "[%A%]1[%B%]x y"
    records.delete_all(spark, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, marks = str(tmp_path / "t"), str(tmp_path / "c")
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"[%A%]{k}\nnothing\n")
        ingest_stream(spark, str(tmp_path / "in"), target, marks, {"A": "int"}).awaitTermination()
        assert spark.read.parquet(target).count() == k


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)
        start, length = int(asked["sn"][0]), int(asked["ln"][0])
        rows = [{"PRODUCTCODE": str(k), "PRODUCTNAME": f"n{k}"} for k in range(start, min(start + length, 36))]
        body = json.dumps({"total_count": 35, "fieldname_list": ["PRODUCTCODE", "PRODUCTNAME"], "result": rows}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_paged_source(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    api.ingest_pages(spark, f"http://127.0.0.1:{server.server_port}/x?y=1", str(tmp_path / "p"), {"PRODUCTCODE": "int", "PRODUCTNAME": "string"}, length=10)
    server.shutdown()
    assert sorted(r.PRODUCTCODE for r in spark.read.parquet(str(tmp_path / "p")).collect()) == list(range(1, 36))
    page = tmp_path / "page.json"
    page.write_text(json.dumps({"total_count": 1, "fieldname_list": ["A"], "result": [{"A": "1"}]}))
    assert records.read_pages(spark, str(page)).first().fields == {"A": "1"}


def test_table_function(spark, engine):
    a.register_udtf(spark, engine.dictionaries)
    rows = spark.sql("SELECT term, type FROM analyze_text('abc-123 10cm', false)").collect()
    assert [(r.term, r.type) for r in rows] == [("abc-123", "MODEL_NAME"), ("abc", "ALPHA"), ("123", "NUMBER"), ("10cm", "UNIT"), ("10", "NUMBER")]


def test_types_of_all_documents(spark, small):
    """Against the rules run outside Spark, with dictionaries written down here."""
    known = Dictionaries(words={"RING": -8.0}, user=frozenset({"RING"}), stop=frozenset({"OLD"}), units=frozenset({"CM", "KG"}), compound={"PLATE": ("disc", "flat")})
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = Counter(t.type for text in texts for t in analyse(text, known))
    got = {r.type: r.times for r in analysis_queries.analyze_documents(spark, small).collect()}
    assert len(texts) >= 200 and got == want and min(got.values()) > 0


def test_segmented_words(spark, small):
    made = spark.createDataFrame([(k, w) for k, w in enumerate(["충전배터리", "침대매트리스는", "가족용텐트", "알수없는말"])], "id long, word string")
    source = spark.createDataFrame([(str(k), w, None, "USER") for k, w in enumerate(["충전", "배터리", "침대", "매트리스", "가족용", "텐트"])], "id string, keyword string, value string, type string")
    told = a.with_tokens(made, "word", api.engine(source).dictionaries).select("id", F.explode("tokens").alias("t")).select("id", "t.term", "t.type", "t.start", "t.stop", "t.pos_inc")
    got = [tuple(r) for r in told.orderBy("id", "start").collect()]
    cut = ["충전 배터리", "침대 매트리스 는", "가족용 텐트", "알수없는말"]
    want = []
    for k, words in enumerate(cut):
        at = 0
        for word in words.split():
            want.append((k, word, "HANGUL", at, at + len(word), 1))
            at += len(word)
    assert got == want


def test_filters_reach_the_scan(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    plan = part.where(q.predicate({"bool": {"filter": [{"term": {"p_type": "PROMO"}}, {"range": {"p_size": {"gt": 5}}}]}})).select("p_partkey")._jdf.queryExecution().toString()
    assert "EqualTo(p_type,PROMO)" in plan and "GreaterThan(p_size,5)" in plan


def test_ties_and_empty_search(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert s.matches(s.postings(empty, "id", ["t"]), [q.clause("a")]).count() == 0
    assert s.bm25(s.postings(empty, "id", ["t"]), ["a"]).count() == 0


def test_parts_with_many_synonyms_are_not_multiplied_out(spark):
    extras = tuple((f"p{k}", tuple(f"p{k}s{j}" for j in range(30)) + ("two words",)) for k in range(12))
    asked = q.clause("whole", ("other name",), extras)
    assert len(asked.words()) == 1 + 2 + 12 * 33 and len(asked.ways()) == 3
    docs = spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(12))), (2, " ".join(f"p{k}" for k in range(11)) + " two x"), (3, " ".join(f"p{k}" for k in range(11)) + " two y words"), (4, "whole"), (5, "name other")], "id long, t string")
    # Numbers are terms of their own, so that words are taken as they are here.
    words = docs.select(F.col("id").alias("doc"), F.lit("t").alias("field"), F.posexplode(F.split("t", " ")).alias("pos", "term"))
    assert {r.doc: r.score for r in s.matches(words, [asked]).collect()} == {1: 12.0, 3: 24.0, 4: 1.0, 5: 2.0}
    tree = q.explain([asked])["AND"][0]["OR"]
    assert tree[:2] == ["whole", {"AND": ["other", "name"]}] and len(tree[2]["AND"]) == 12 and tree[2]["AND"][0]["OR"][-1] == {"AND": ["two", "words"]}
    assert q.query_json([asked], ["t"])["bool"]["must"][0]["bool"]["should"][2]["bool"]["must"][11]["bool"]["should"][0]["multi_match"]["query"] == "p11"


def test_mappings(spark):
    assert len(mapping.PRODUCT_VM.types()) + len(mapping.PRODUCT_VM.copies) == 84 and len(mapping.PRODUCT.types()) + len(mapping.PRODUCT.copies) == 58
    raw = spark.createDataFrame([({"PRODUCTCODE": "1", "PRODUCTNAME": "LG TV", "PRODUCTMAKER": "LG", "LOWESTPRICE": "99", "REGISTERDATE": "20200102", "TOTALCAPACITY": "x"},)], "fields map<string,string>")
    row = mapping.with_copies(records.typed_records(raw, mapping.PRODUCT_VM.types()), mapping.PRODUCT_VM.copies).first()
    assert row.TOTALINDEX == "LG TV LG" and row.LOWESTPRICE == 99 and row.REGISTERDATE.day == 2 and row.TOTALCAPACITY is None and row.MAKER_BRANDKEYWORD == ""


def test_files_without_a_key_in_front_are_left_out(spark, tmp_path):
    good, bad = tmp_path / "in" / "good", tmp_path / "in" / "bad"
    good.mkdir(parents=True)
    bad.mkdir()
    for k in range(3):
        (good / f"{k}.txt").write_text("".join(f"[%A%]{k}-{n}\n" + ("no key in between\n" if n == 5 else "") for n in range(4000)))
        (bad / f"{k}.txt").write_text("a header\n" + "".join(f"[%A%]bad{k}-{n}\n" for n in range(4000)))
    (bad / "empty.txt").write_text("")
    (bad / "blank.txt").write_text("\n[%A%]after a blank line\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # so that files are split
    try:
        for charset in ("UTF-8", "UTF-16"):
            lines = records.accepted_lines(spark, [str(tmp_path / "in")], "UTF-8") if charset == "UTF-8" else None
            if lines is None:
                other = tmp_path / "wide"
                other.mkdir()
                (other / "a.txt").write_bytes("[%A%]1\nx".encode(charset))
                (other / "b.txt").write_bytes("x\n[%A%]2".encode(charset))
                assert [r.value for r in records.accepted_lines(spark, [str(other)], charset).collect()] == ["[%A%]1", "x"]
                continue
            assert lines.rdd.getNumPartitions() > 6
            got = sorted(r.fields["A"] for r in records.parse_records(lines).collect())
            assert got == sorted(f"{k}-{n}" for k in range(3) for n in range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_read_their_ranges_only(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 1013).alias("score"), "id").repartition(9)
    ranked = pages.store_ranked(rows, [F.desc("score"), F.asc("id")], f"{tmp_path}/ranked")
    want = sorted(((k * 7919 % 1013, k) for k in range(3000)), key=lambda r: (-r[0], r[1]))
    assert ranked.total == 3000
    for start, size in ((0, 20), (1490, 40), (2990, 50), (3000, 5), (0, 3000), (7, 0)):
        got = sorted(ranked.page(start, size, ["id"]).collect(), key=lambda r: r._rownum)
        assert [(r.score, r.id, r._rownum, r._sort) for r in got] == [(*w, start + k, [str(w[1])]) for k, w in enumerate(want[start : start + size])]
    plan = ranked.page(1490, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan or "PartitionFilters: [isnotnull(__part" in plan
    assert "Window" not in plan and "Exchange" not in plan
    none = pages.store_ranked(rows.where("false"), [F.asc("id")], f"{tmp_path}/none")
    assert none.total == 0 and none.page(0, 5).count() == 0


def test_best_fragment(spark):
    text = "red one & two <b> ring " + "word " * 30 + "ring red hot Ring " + "end " * 30
    df = spark.createDataFrame([(1, text), (2, "none of them <i>"), (3, None), (4, "")], "id long, t string")
    got = {r.id: r.x for r in df.select("id", s.best_fragment(F.col("t"), ["RED", "ring", "HOT"], 40, "<em>", "</em>").alias("x")).collect()}
    at = text.index("ring red hot") // 40 * 40
    assert "<em>ring</em> <em>red</em> <em>hot</em> <em>Ring</em>" in got[1] or at != text.index("Ring") // 40 * 40
    assert got[2] == "none of them <i>" and got[3] is None and got[4] == ""
    short = s.best_fragment(F.col("t"), ["one"], 23, "[", "]")
    assert df.where("id = 1").select(short.alias("x")).first().x == "red [one] &amp; two &lt;b&gt; ring"


def test_tokens_are_handed_on_in_slices(spark, engine, monkeypatch):
    """A batch of long texts is no longer turned into tokens as a whole, in any shape."""
    import pandas as pd

    made = pd.Series(["a b" * 50, None, "c", "d" * 400, "", "e f"])
    monkeypatch.setattr(a, "HELD_CHARS", 100)
    slices = list(a._in_slices(made))
    assert len(slices) > 1 and [x for s in slices for x in s] == list(made)
    assert all(sum(len(x or "") for x in list(s)[1:]) < 100 for s in slices)
    texts = [("red 10cm, old (ring) " * (k % 7) if k % 5 else None, k) for k in range(200)]
    df = spark.createDataFrame(texts, "text string, k int").coalesce(1)
    got = {r.k: ({t.type: t.times for t in r.types}, [t.type for t in r.tokens]) for r in a.with_type_counts(a.with_tokens(df, "text", engine.dictionaries), "text", engine.dictionaries).collect()}
    want = {k: [t.type for t in analyse(text, engine.dictionaries)] for text, k in texts}
    assert got == {k: (Counter(v), v) for k, v in want.items()}


def test_one_word_pieces_follow_the_rules(monkeypatch):
    """Words with symbols around them skip the rules, which would not change them; pieces that a dictionary has together do not."""
    import random

    from lexiloom.operators import rules

    known = lambda: Dictionaries(words={"RING": -8.0}, user=frozenset({"C#", '"X'}), stop=frozenset({"OLD", "OLD."}), units=frozenset({"CM"}), compound={"PLATE": ("disc", "flat"), "!": ("a", "b")}, space={"AB.": ("a", "b")})
    rng = random.Random(2)
    pool = ["ring", "old", "plate", "!", ".", "#", "c", "-", '"', "x", "10", "cm", "ab", ",", " ", "가", "の", "漢", "é", "_"]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(3000)]
    options = [Options(), Options(for_query=True), Options(for_query=True, full_string=True)]
    got = [analyse(x, known(), o) for x in texts for o in options]
    types = [rules.token_types(x, known(), o) for x in texts for o in options]
    monkeypatch.setattr(rules, "_one_word", lambda found, d: False)
    monkeypatch.setattr(rules, "_stands_alone", lambda word, piece, d: False)
    assert got == [analyse(x, known(), o) for x in texts for o in options] and types == [[t.type for t in x] for x in got]
