"""Importance resampling, token counts and the source audit against SQL, the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import re
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lexiloom.llm import divergence, piece_counts, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, rank int, `e` string"
REST = (1, "k", 2, 3, "e")
WORDS = ["the", "cat", "Émile", "x1", "ñandú", "A", "b-c", "日本"]


def rows_of(texts):
    return [(k, t, "en", f"s{k % 3}", *REST) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    texts = ["", " \t\n", "one", "one two", None, "x" * 3000, "the cat sat\n" * 300, "Ünïcödé Ärger ñandú " * 30, "1 2 3 !!"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    rows = rows_of(texts)
    rows += [rows[20], rows[20], rows[0], (None, "no id at all, none " * 9, None, None, None, None, None, None, None), (7, "same id, other text", "", None, *REST)]
    rows += [(99, None, "fr", "s0", *REST), (100, "le chat", "fr", "s1", *REST), (101, "solo", "de", None, *REST)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    rows = [("i1", "the cat and Émile"), ("i2", None), ("i3", ""), ("i4", "x1 ñandú the cat sat")]
    return spark.createDataFrame(rows, "item_id string, text string").withColumn("doc_id", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 11 ----------------------------------------------------------------------


def features(text):
    lower = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
    return len(ws), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_sample(docs, targets):
    told = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, bs in told for b in bs), Counter(b for x in targets for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    scored = []
    for d, n, bs in told:
        weight = sum(gain[b] for b in bs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0], r[2]))
    places = {}
    for k, r in enumerate(drawn[: 5 * len(drawn) // 100], 1):
        places.setdefault(r, []).append(k)
    return Counter((d, n, w, sc, places[d, m, n, w, sc].pop() if places.get((d, m, n, w, sc)) else None) for d, m, n, w, sc in scored)


def test_resample_matches_sql(spark, small, same_as_sql):
    assert same_as_sql(resample.op11_resample, resample.ORACLE_SQL, small) == 200


@pytest.mark.parametrize("targets", ["target", "none"])
def test_resample_on_odd_rows(odd, target, none, targets):
    other = target if targets == "target" else none
    got = Counter(tuple(r) for r in resample.importance_sample(odd, other).collect())
    assert got == brute_sample([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in other.collect()])


def test_resample_of_nothing(none, target):
    assert resample.importance_sample(none, target).count() == 0


def test_resample_stays_in_the_jvm(odd, target):
    plan = resample.importance_scores(odd, target)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_ranks_run_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 977).alias("score"), "id", F.lit("x").alias("at"), F.lit(1).alias("before"), F.lit(2).alias("part")).repartition(7)
    got = resample.ranked(rows, [F.desc("score"), F.asc("id")], "place")
    assert got.columns == [*rows.columns, "place"]
    want = sorted(((k % 977, k) for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.score, r.id) for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.select("place").collect()) == list(range(1, 5001))


# -- 12 ----------------------------------------------------------------------

PIECES = public_tokenizers.path(piece_counts.MODEL)


def test_no_piece_crosses_a_space():
    model = SentencePieceProcessor(model_file=PIECES)
    assert not [p for p in map(model.id_to_piece, range(model.get_piece_size())) if piece_counts.MARK in p.lstrip(piece_counts.MARK)]


def test_counts_are_the_librarys(odd, spark, small):
    model = SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        got = Counter(tuple(r) for r in piece_counts.token_counts(docs, PIECES, limit=100).collect())
        counts = [len(model.encode(t)) for _, t in texts]
        assert got == Counter((d, len(t.encode()), n, n > 100) for (d, t), n in zip(texts, counts))


def test_counts_of_strange_texts():
    model = SentencePieceProcessor(model_file=PIECES)
    parts = [" ", "  ", "▁", "a", "<s>", "</s>", "<unk>", "<0x0A>", "\n", "\t", " ", "　", "é", "é", "ﬁ", "日本", "🙂", "\x00", "12", "word", ".", "x" * 70, "​"]
    rng, lengths = random.Random(9), piece_counts.Lengths(open(PIECES, "rb").read(), {})
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert piece_counts.token_count(text, lengths) == len(model.encode(text)), repr(text)


def test_cache_is_bounded_and_keeps_the_table(monkeypatch):
    monkeypatch.setattr(piece_counts, "CACHE_SIZE", 10)
    lengths = piece_counts.Lengths(open(PIECES, "rb").read(), {"the": 1})
    text = " ".join(f"w{k}" for k in range(500)) + " the " + "y" * 100
    assert piece_counts.token_count(text, lengths) == len(SentencePieceProcessor(model_file=PIECES).encode(text))
    assert len(lengths) <= 11 and "the" in lengths


def test_table_of_frequent_lengths(odd):
    table = piece_counts.unpacked(piece_counts.frequent_lengths(odd, open(PIECES, "rb").read()))
    assert table["the"] == 1 and len(table) <= piece_counts.TABLE_SIZE


def test_counts_of_nothing(none):
    assert piece_counts.token_counts(none, PIECES).count() == 0


# -- 13 ----------------------------------------------------------------------


def brute_audit(docs, top, least):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    told = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(table))) for t, lang, source in docs]
    seen, counts, langs = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, _, ws in told:
        seen.update((lang, w) for w in set(ws))
    for lang, source, ws in told:
        keep = [w for w in ws if seen[lang, w] >= least]
        counts[lang, source].update(keep)
        langs[lang].update(keep)
    p = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
    f = lambda a, b: (a - b) * (a - b) // b
    out = set()
    for (lang, source), own in counts.items():
        kept, n, total = langs[lang], sum(own.values()), sum(langs[lang].values())
        v = len(kept)
        pairs = []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                m = sum(theirs.values())
                pairs.append((-sum(f(p(own[w], n, v), p(theirs[w], m, v)) for w in kept), other))
        speak = [(-f(p(c, n, v), p(kept[w], total, v)), w) for w, c in own.items() if p(c, n, v) > p(kept[w], total, v)]
        for part, found in (("pair", pairs), ("term", sorted(speak, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)}
    return out


@pytest.mark.parametrize("top", [1, 3, 200])
@pytest.mark.parametrize("least", [1, 3])
def test_audit_on_odd_rows(odd, top, least):
    got = [tuple(r) for r in divergence.source_audit(odd, top, least).collect()]
    want = brute_audit([(r.text, r.lang, r.source) for r in odd.collect()], top, least)
    assert len(got) == len(want) and set(got) == want


def test_audit_of_many_terms_stops_early_and_right(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    rows = []
    for k in range(300):
        source = rng.choice("pqrs")
        own = words[ord(source) % 7 :: 7]
        rows.append((k, " ".join(rng.choices(words, k=30) + rng.choices(own[:40], k=rng.randint(0, 30))), "en", source, *REST))
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(divergence, "COUNTED_AT_ONCE", 50)
    got = [tuple(r) for r in divergence.source_audit(docs, 20, 3).collect()]
    assert set(got) == brute_audit([(r[1], r[2], r[3]) for r in rows], 20, 3) and len(got) == 4 * 3 + 4 * 20


def test_audit_matches_sql(small, same_as_sql):
    assert same_as_sql(divergence.op13_source_audit, divergence.ORACLE_SQL, small) > 0


def test_audit_of_nothing(none):
    assert divergence.source_audit(none).count() == 0
