"""Every registered query with a DuckDB form against it, on the smallest tables."""

from __future__ import annotations

import pytest

from lexiloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(name, same_as_sql, small):
    assert same_as_sql(catalogue.queries()[name], catalogue.oracle_sql()[name], small) > 0


def test_texts_are_analysed_once_for_listed_tokens(spark, small):
    """The listed tokens of a text, none for a null text or one without tokens, come from one evaluation of the analyser."""
    from lexiloom import analysis_queries as q
    from lexiloom.operators import analyze as a
    from lexiloom.operators.segment import Dictionaries

    rows = spark.createDataFrame([(1, "red 5cm"), (1, "red 5cm"), (None, "old"), (2, None), (3, ""), (4, "...")], "k long, text string")
    listed = q._listed(a.with_tokens(rows, "text", Dictionaries(units=frozenset({"CM"}), stop=frozenset({"OLD"}))), "k")
    red = [(1, "red", "ALPHA", 0, 3, 1), (1, "5cm", "UNIT", 4, 7, 1), (1, "5", "NUMBER", 4, 5, 0)]
    assert sorted(map(tuple, listed.collect())) == sorted(red * 2)
    assert listed.columns == ["k", "term", "type", "start", "stop", "pos_inc"]
    for df in (listed, catalogue.queries()["analyze_index"](spark, small)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_rows_are_dealt_out_before_they_are_analysed(spark, small, monkeypatch):
    """One file's rows go to many tasks, also where many have the same text or the same key, and all of them stay."""
    from pyspark.sql import functions as F

    from lexiloom.operators import analyze as a
    from lexiloom.operators.segment import Dictionaries

    text = F.when(F.col("id") % 5 == 0, "red widget").when(F.col("id") % 50 != 1, F.concat(F.lit("blue x"), F.col("id")))
    key = F.when(F.col("id") % 5 == 2, 7).when(F.col("id") % 50 != 3, F.col("id"))
    rows = spark.range(0, 2000, 1, 1).select(key.alias("k"), text.alias("text"))
    rows = rows.unionByName(rows).coalesce(1)
    # The number of tasks follows that of the rows, whatever the session has for shuffles.
    monkeypatch.setattr(a, "DEALT_ROWS", 500)
    with_conf = [("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "50")]
    before = {name: spark.conf.get(name) for name, _ in with_conf}
    for name, value in with_conf:
        spark.conf.set(name, value)
    try:
        got = a.with_tokens(rows, "text", Dictionaries(), by=["k"]).withColumn("task", F.spark_partition_id()).select("task", "k", "text", F.transform("tokens", lambda t: t["term"]).alias("terms")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    tasks = [sum(r.task == n for r in got) for n in range(8)]
    assert max(tasks) < 1.5 * len(got) / 8 and min(tasks) > 0.5 * len(got) / 8
    order = lambda found: sorted(found, key=str)
    assert order((r.k, r.text) for r in got) == order((r.k, r.text) for r in rows.collect())
    alone = {t: a.analyse(t, Dictionaries()) for t in {r.text for r in got}}
    assert all(r.terms == [t.term for t in alone[r.text]] for r in got)
    plan = catalogue.queries()["analyze_index"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RebalancePartitions")


def test_details_of_dealt_rows(spark, small):
    """Sets of names are the same with and without dealing the rows out, null and repeated ones too; the query does so before analysis."""
    from lexiloom import api

    engine = api.engine(spark.createDataFrame([("1", None, "red,crimson", "SYNONYM"), ("2", "CM", None, "UNIT")], "id string, keyword string, value string, type string"))
    rows = spark.createDataFrame([(1, "red 5cm"), (1, "red 5cm"), (None, "red"), (None, None), (3, ""), (4, None), (5, "..."), (6, "abc-12")], "k long, text string").coalesce(1)
    plain, dealt = (sorted(engine.analyze(rows, "text", by=by).collect(), key=str) for by in ([], ["k"]))
    assert plain == dealt and len(dealt) == 8
    plan = catalogue.queries()["analyze_detail"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("RebalancePartitions")
