"""Versions of compiled dictionaries, and dictionaries in text files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom import api
from lexiloom.operators import dictionaries as d
from lexiloom.operators import versions
from lexiloom.sources import records

WORDS = ["red", "big ring", "rod", "립 스테이크", "cm", "k g", "old"]


def some_rows(rng, n):
    rows = []
    for k in range(n):
        config = rng.choice([c for c in d.CONFIGURED if c.kind != "SYSTEM"])
        keyword = None if "SYNONYM" in config.kind and rng.random() < 0.5 else rng.choice(WORDS)
        rows.append((str(k), keyword, ",".join(rng.sample(WORDS, rng.randint(1, 3))), config.name.upper()))
    return rows


def contents(tables):
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    return {name: sorted((tuple(map(plain, r)) for r in t.select(*sorted(t.columns)).collect()), key=str) for name, t in tables.items()}


def test_changed_keys_give_what_a_full_compile_gives(spark, tmp_path):
    rng = random.Random(3)
    store = versions.DictionaryStore(spark, f"file://{tmp_path}/store")
    assert store.version() is None
    with pytest.raises(ValueError):
        store.tables()
    rows = some_rows(rng, 60)
    seen = []
    for n in range(1, 4):
        source = spark.createDataFrame(rows, versions.SOURCE)
        assert store.compile(source, f"2024-01-0{n} 00:00:00") == n
        want = {c.name: d.compile_dictionary(source, c) for c in d.CONFIGURED if c.kind != "SYSTEM"}
        seen.append(contents(store.tables()))
        assert seen[-1] == contents(want)
        rows = [r for r in rows if rng.random() > 0.2] + [(f"{n}-{r[0]}", *r[1:]) for r in some_rows(rng, 6)]
    assert contents(store.tables(1)) == seen[0]
    # A version without its manifest, as one that was broken off leaves it, is not seen.
    spark.createDataFrame([("x",)], "key string").write.parquet(f"{tmp_path}/store/tables/stop/4")
    assert store.version() == 3 and contents(store.tables()) == seen[2]
    assert store.restore(1, "2024-02-01 00:00:00") == 4 and contents(store.tables()) == seen[0]
    assert sorted(store.source(4).collect()) == sorted(store.source(1).collect())
    assert {r.applied_time for r in store.log().collect()} == {"2024-02-01 00:00:00"}


def test_named_and_unchanged_dictionaries(spark, tmp_path):
    store = versions.DictionaryStore(spark, f"file://{tmp_path}/store")
    rows = [("1", "old", None, "STOP"), ("2", "cm", None, "UNIT")]
    store.compile(spark.createDataFrame(rows, versions.SOURCE), "2024-01-01 00:00:00")
    more = spark.createDataFrame([*rows, ("3", "new", None, "STOP"), ("4", "kg", None, "UNIT")], versions.SOURCE)
    store.compile(more, "2024-01-02 00:00:00", {"stop"})
    got = {n: sorted(r[0] for r in t.collect()) for n, t in store.tables().items() if n in ("stop", "unit")}
    assert got == {"stop": ["new", "old"], "unit": ["cm"]}
    folders = {(r.version, r.name): r.folder for r in store.manifests().collect()}
    assert folders[2, "unit"] == folders[1, "unit"] and folders[2, "stop"] != folders[1, "stop"]
    log = {r.id: (r.applied_time, r["count"]) for r in store.log().collect()}
    assert log["STOP"] == ("2024-01-02 00:00:00", 2) and log["UNIT"] == ("2024-01-01 00:00:00", 1)


def test_log_of_a_stream(spark, tmp_path):
    for n, rows in enumerate([[("A", "2024-01-01", 1), ("B", "2024-01-02", 2)], [("A", "2024-01-03", 5), ("B", "2024-01-01", 9), ("C", "2024-01-01", 3)]]):
        spark.createDataFrame(rows, versions.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(versions.LOG).parquet(f"{tmp_path}/in")
        versions.log_stream(stream, f"{tmp_path}/log", f"{tmp_path}/marks").awaitTermination()
    got = {r.id: (r.applied_time, r["count"]) for r in versions.read_log(spark, f"{tmp_path}/log").collect()}
    assert got == {"A": ("2024-01-03", 5), "B": ("2024-01-02", 2), "C": ("2024-01-01", 3)}


def test_dictionaries_in_text_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "synonym.txt").write_text("# comment\n\nred\tcrimson,scarlet\n\ttv,television\n// more\n립 스테이크\n", encoding="utf-8")
    rows = [(r.keyword, r.value, r.type) for r in records.read_dictionary_lines(spark, [str(folder)], "synonym").orderBy("id").collect()]
    assert rows == [("red", "crimson,scarlet", "SYNONYM"), (None, "tv,television", "SYNONYM"), ("립 스테이크", None, "SYNONYM")]
    (folder / "map.txt").write_text("a\tfirst\n" * 20 + "a\tlast\n")
    built = d.build_map(records.read_dictionary_lines(spark, [str(folder / "map.txt")], "map"))
    assert built.first()["values"] == ["last"]
    (folder / "01.N.HIGH.txt").write_text("가\n#c\n")
    (folder / "0.scored.txt").write_text("나라\tNNG\t-9\n가\tNNG\t-20\n")
    words = api.compile_system(spark, [str(folder / "01.N.HIGH.txt"), str(folder / "0.scored.txt")], str(tmp_path / "system"))
    assert {tuple(r) for r in words.collect()} == {("가", "N", -8.0), ("나라", "N", -9.0)}
    restored = api.restore_table({"stop": d.build_set(spark.createDataFrame([("old",)], "keyword string"))}, str(tmp_path / "restored"))
    assert [(r.keyword, r.type) for r in restored.collect()] == [("old", "STOP")]
