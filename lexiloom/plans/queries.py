"""Keyword queries as small values, their JSON form, and user filters as column expressions."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import split_spaces


@dataclass(frozen=True)
class Clause:
    """What one keyword asks for: any of the alternatives, each all of its words, or all of the parts, each in any of its ways.

    ``literal`` is the keyword as it was typed.
    """

    literal: str
    alternatives: tuple[tuple[str, ...], ...]
    parts: tuple[tuple[tuple[str, ...], ...], ...] = ()

    def ways(self) -> list[tuple[tuple[tuple[str, ...], ...], ...]]:
        """All ways to hold, each as parts that must all hold in one of their ways; their number is that of the words."""
        return [((a,),) for a in self.alternatives] + ([self.parts] if self.parts else [])

    def words(self) -> list[str]:
        return [w for way in self.ways() for part in way for option in part for w in option]


def clause(term: str, synonyms: tuple[str, ...] = (), extras: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> Clause:
    """A keyword, or one of its synonyms (each all of its words), or all of its parts (each of them, or one of its synonyms)."""
    ways = [(term,), *(tuple(s.split()) for s in synonyms)]
    parts = tuple(tuple(dict.fromkeys(w for w in ((part,), *(tuple(o.split()) for o in others)) if w)) for part, others in extras)
    if parts and all(len(p) == 1 for p in parts):
        ways.append(tuple(w for p in parts for w in p[0]))
        parts = ()
    return Clause(term, tuple(dict.fromkeys(w for w in ways if w)), parts)


def clauses(tokens: list[dict]) -> list[Clause]:
    """One clause for each analysed token; the token of the whole text is passed over."""
    listed = lambda x: () if x is None else tuple(x)
    parts = lambda t: tuple((e["term"], listed(e.get("synonyms"))) for e in listed(t.get("extras")))
    return [clause(t["term"], listed(t.get("synonyms")), parts(t)) for t in tokens if t["type"] != "FULL_STRING"]


def parse_fields(fields: str) -> dict[str, float]:
    """``A,B^300000`` as boosts by field; what is no number counts as 1."""
    out = {}
    for part in filter(None, (p.strip() for p in fields.split(","))):
        name, _, boost = part.partition("^")
        try:
            out[name] = float(boost) if boost else 1.0
        except ValueError:
            out[name] = 1.0
    return out


def query_json(asked: list[Clause], fields: list[str], analyzer: str = "whitespace") -> dict:
    """The boolean query: all clauses must hold, each of them over any of the fields."""
    match = lambda word: {"multi_match": {"query": word, "fields": fields, "analyzer": analyzer}}
    way = lambda words: match(words[0]) if len(words) == 1 else {"bool": {"must": [match(w) for w in words]}}
    any_of = lambda ways: ways[0] if len(ways) == 1 else {"bool": {"should": ways}}
    parts = lambda c: [{"bool": {"must": [any_of([way(o) for o in part]) for part in c.parts]}}] if c.parts else []
    return {"bool": {"must": [any_of([way(a) for a in c.alternatives] + parts(c)) for c in asked]}}


def explain(asked: list[Clause]) -> dict:
    """The tree of words in short: lists of AND and OR."""
    way = lambda words: words[0] if len(words) == 1 else {"AND": list(words)}
    any_of = lambda ways: ways[0] if len(ways) == 1 else {"OR": ways}
    parts = lambda c: [{"AND": [any_of([way(o) for o in part]) for part in c.parts]}] if c.parts else []
    return {"AND": [any_of([way(a) for a in c.alternatives] + parts(c)) for c in asked]}


def written(tokens: Column, fields: list[str], analyzer: str = "whitespace") -> Column:
    """struct<query, tree>: the JSON forms of the queries that a column of analysed tokens asks for."""

    @F.pandas_udf("struct<query: string, tree: string>")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        short = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
        for rows in parts:
            asked = [clauses([dict(t) for t in row]) if row is not None else [] for row in rows]
            yield pd.DataFrame({"query": [short(query_json(a, fields, analyzer)) for a in asked], "tree": [short(explain(a)) for a in asked]})

    return forms(tokens)


def _words(field: str) -> Column:
    return split_spaces(F.coalesce(F.col(field).cast("string"), F.lit("")))


def _any_word(field: str, text: str, operator: str = "or") -> Column:
    asked = F.array(*[F.lit(w) for w in text.split()])
    return F.arrays_overlap(_words(field), asked) if operator == "or" else F.size(F.array_except(asked, _words(field))) == 0


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _listed(x) -> list:
    return x if isinstance(x, list) else [x]


def predicate(query: dict) -> Column:
    """The rows that a user's JSON query matches, as a filter that reaches the scan where it can.

    Kinds: term, terms, terms_set, range, match, match_phrase, multi_match,
    query_string, simple_query_string, bool, boosting, function_score, wrapper.
    """
    (kind, body), = query.items()
    if kind == "term":
        (field, value), = body.items()
        return F.col(field) == (value["value"] if isinstance(value, dict) else value)
    if kind == "terms":
        (field, values), = ((k, v) for k, v in body.items() if k != "boost")
        return F.col(field).isin(values)
    if kind == "terms_set":
        (field, spec), = body.items()
        asked = F.array(*[F.lit(t) for t in spec["terms"]])
        return F.size(F.array_intersect(_words(field), asked)) >= int(spec.get("minimum_should_match", len(spec["terms"])))
    if kind == "range":
        (field, bounds), = body.items()
        column = F.col(field)
        signs = {"gte": column.__ge__, "gt": column.__gt__, "lte": column.__le__, "lt": column.__lt__}
        return _all([signs[k](v) for k, v in bounds.items() if k in signs])
    if kind == "match":
        (field, spec), = body.items()
        return _any_word(field, spec["query"], spec.get("operator", "or").lower()) if isinstance(spec, dict) else _any_word(field, str(spec))
    if kind == "match_phrase":
        (field, spec), = body.items()
        text = " ".join((spec["query"] if isinstance(spec, dict) else spec).split())
        return F.contains(F.concat(F.lit(" "), F.array_join(_words(field), " "), F.lit(" ")), F.lit(f" {text} "))
    if kind == "multi_match":
        return _any([_any_word(f, body["query"], body.get("operator", "or").lower()) for f in parse_fields(",".join(body["fields"]))])
    if kind in ("query_string", "simple_query_string"):
        names = list(parse_fields(",".join(body.get("fields") or [body["default_field"]])))
        return _any([_any_word(f, body["query"], body.get("default_operator", "or").lower()) for f in names])
    if kind == "bool":
        needed = [predicate(q) for k in ("must", "filter") for q in _listed(body.get(k, []))]
        wanted = [predicate(q) for q in _listed(body.get("should", []))]
        refused = [~F.coalesce(predicate(q), F.lit(False)) for q in _listed(body.get("must_not", []))]
        return _all([*needed, *refused, *([_any(wanted)] if wanted and not needed else [])])
    if kind == "boosting":
        return predicate(body["positive"])
    if kind == "function_score":
        return predicate(body["query"]) if "query" in body else F.lit(True)
    if kind == "wrapper":
        return predicate(json.loads(base64.b64decode(body["query"])))
    raise ValueError(f"unknown kind of query: {kind}")


def function_score(score: Column, query: dict) -> Column:
    """``score`` with the weights of the functions whose filters hold, by the query's score_mode and boost_mode."""
    functions = [(predicate(f["filter"]) if "filter" in f else F.lit(True), float(f["weight"])) for f in query.get("functions", [])]
    hit = [F.coalesce(p, F.lit(False)) for p, _ in functions]
    if not functions:
        return score
    if query.get("score_mode", "multiply") == "sum":
        weight = reduce(lambda a, b: a + b, [F.when(h, F.lit(w)).otherwise(F.lit(0.0)) for h, (_, w) in zip(hit, functions)])
    else:
        weight = reduce(lambda a, b: a * b, [F.when(h, F.lit(w)).otherwise(F.lit(1.0)) for h, (_, w) in zip(hit, functions)])
    weight = F.when(_any(hit), weight).otherwise(F.lit(1.0))
    modes = {"sum": score + weight, "multiply": score * weight, "replace": weight, "avg": (score + weight) / 2, "max": F.greatest(score, weight), "min": F.least(score, weight)}
    return modes[query.get("boost_mode", "multiply")]


def replaces_analysed(query: dict | None) -> bool:
    """Whether a user's query stands for the analysed one: a function_score whose inner query is no bool does."""
    return "function_score" in (query or {}) and "bool" not in query["function_score"].get("query", {})


def constant_score(query: dict) -> Column:
    """1 for each row, and a boosting query's negative_boost where its negative query holds too."""
    if not query.get("boosting", {}).get("negative"):
        return F.lit(1.0)
    refused = F.coalesce(predicate(query["boosting"]["negative"]), F.lit(False))
    return F.when(refused, F.lit(float(query["boosting"]["negative_boost"]))).otherwise(F.lit(1.0))


def merge_user_query(analysed: Column, query: dict | None) -> Column:
    """The analysed query's rows with a function_score's own filters.

    The inner bool's ``must`` gives way to the analysed query, beside which its
    ``should`` need not hold. An inner query of another kind takes the analysed one's place.
    """
    if replaces_analysed(query):
        return predicate(query)
    inner = (query or {}).get("function_score", {}).get("query", {})
    rest = {k: v for k, v in inner.get("bool", {}).items() if k in ("filter", "must_not")}
    return analysed & predicate({"bool": rest}) if rest else analysed
