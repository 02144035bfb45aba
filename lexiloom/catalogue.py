"""Registered queries over the driver's tables, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import hangul, text
from lexiloom.operators import dictionaries as d
from lexiloom.operators import versions
from lexiloom.plans import index as ix
from lexiloom.plans import mapping, pages
from lexiloom.plans import queries as q
from lexiloom.plans import search as s
from lexiloom.sources import records as r
from lexiloom.sources.shared import shared_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None, lists: tuple[str, ...] = ()):
    """Registers a query with its SQL. Columns named in ``lists`` are written as comma-joined strings by both."""

    def add(function):
        def flat(spark, sf_dir):
            return function(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in lists})

        _QUERIES[function.__name__] = flat if lists else function
        if sql and lists:
            _SQL[function.__name__] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, ',') AS {c}" for c in lists)}) FROM ({sql})"
        elif sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lexiloom import analysis_queries

    return dict(_QUERIES) | analysis_queries.queries()


def oracle_sql() -> dict[str, str]:
    from lexiloom import analysis_queries

    return dict(_SQL) | analysis_queries.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: RE2 form of the run pattern: its classes can't be intersected, so other letters come after the scripts' blocks.
_RUNS = r"([가-힣]+|[ㄱ-ㆎ]+|[\x{3040}-\x{30ff}]+|[\x{4e00}-\x{9fff}]+|\p{Lo}+|[\p{Lu}\p{Ll}]+|\p{Nd}+|[\p{P}\p{S}]+|[\t-\r\x1c-\x20\x{2028}\x{2029}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{205f}\x{3000}]+|[^\t-\r\x1c-\x20\p{Lo}\p{Lu}\p{Ll}\p{Nd}\p{P}\p{S}]+)"
_TERM = r"[^\t-\r\x1c-\x20\p{P}\p{S}]"
_FOLD = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


# -- characters and strings ---------------------------------------------------


@_register(f"""
    SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '{_RUNS}', 1)) AS run FROM documents) GROUP BY run
""")
def char_runs(spark, sf_dir):
    """All class runs of all documents with their counts; counted in the tasks first."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.explode(text.runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count("*").alias("times"))


@_register(f"""
    SELECT p_partkey, string_agg(term || ':' || spot || ':' || (spot + length(term)), ' ' ORDER BY spot) AS tokens FROM (
        SELECT p_partkey, run AS term, coalesce(sum(length(run)) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM (
            SELECT p_partkey, unnest(regexp_extract_all(p_brand || ' ' || p_name, '{_RUNS}', 1)) AS run, generate_subscripts(regexp_extract_all(p_brand || ' ' || p_name, '{_RUNS}', 1), 1) AS i FROM part))
    WHERE NOT regexp_full_match(term, '\\s+') GROUP BY p_partkey
""")
def token_offsets(spark, sf_dir):
    """Class runs with their offsets."""
    part = _table(spark, sf_dir, "part").select("p_partkey", text.typed_runs(F.concat_ws(" ", "p_brand", "p_name")).alias("t"))
    return part.select("p_partkey", F.array_join(F.transform("t", lambda t: F.concat_ws(":", t["term"], t["start"], t["stop"])), " ").alias("tokens"))


@_register(f"""
    SELECT CASE WHEN regexp_full_match(run, '[\\p{{Lu}}\\p{{Ll}}]+') THEN 'ALPHA' WHEN regexp_full_match(run, '\\p{{Nd}}+') THEN 'NUMBER' WHEN regexp_full_match(run, '[\\p{{P}}\\p{{S}}]+') THEN 'SYMBOL'
        WHEN regexp_full_match(run, '[\\t-\\r\\x1c-\\x20]+') THEN 'WHITESPACE' ELSE 'OTHER' END AS class, count(*) AS times, CAST(sum(length(run)) AS BIGINT) AS chars
    FROM (SELECT unnest(regexp_extract_all(text, '{_RUNS}', 1)) AS run FROM conversations) GROUP BY 1
""")
def class_of_run(spark, sf_dir):
    """How many runs and characters of each class there are."""
    rows = _table(spark, sf_dir, "conversations").select(F.explode(text.runs(F.col("text"))).alias("run"))
    kind = text.char_class(F.col("run"))
    named = F.when(kind.isin("ALPHA", "NUMBER", "SYMBOL", "WHITESPACE"), kind).otherwise("OTHER")
    return rows.groupBy(named.alias("class")).agg(F.count("*").alias("times"), F.sum(F.length("run")).alias("chars"))


@_register(r"""
    SELECT word, CASE WHEN regexp_full_match(word, '[\p{Lu}\p{Ll}\p{Nd}]+') AND regexp_matches(word, '\p{Nd}') AND regexp_matches(word, '[\p{Lu}\p{Ll}]') THEN 'ALPHANUM'
        WHEN regexp_full_match(word, '[\p{Lu}\p{Ll}\p{Nd}][\p{Lu}\p{Ll}\p{Nd}\p{P}\p{S}]*') AND regexp_matches(word, '[\p{P}\p{S}]') THEN 'ASCII'
        WHEN regexp_full_match(word, '[\p{Lu}\p{Ll}]+') THEN 'ALPHA' WHEN regexp_full_match(word, '\p{Nd}+') THEN 'NUMBER' WHEN regexp_full_match(word, '[\p{P}\p{S}]+') THEN 'SYMBOL' ELSE 'UNCATEGORIZED' END AS type
    FROM (SELECT DISTINCT unnest(list_concat(string_split(p_brand, ' '), string_split(p_name, ' '))) AS word FROM part UNION SELECT DISTINCT unnest(string_split(url, '/')) FROM pages) WHERE word <> ''
""")
def term_types(spark, sf_dir):
    part, pages = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "pages")
    words = part.select(F.explode(F.concat(F.split("p_brand", " "), F.split("p_name", " "))).alias("word")).unionByName(pages.select(F.explode(F.split("url", "/")).alias("word")))
    return words.where("word <> ''").distinct().select("word", text.term_type(F.col("word")).alias("type"))


_CASES = "('1'), ('123'), ('1234'), ('12345'), ('1,234'), ('1,234,567'), ('12,345,678'), ('1.2'), ('1.234'), ('1.234.567'), ('100:100'), ('1,234:5,678'), ('1,2,3,4'), (''), (':'), ('a1'), ('1:2:3')"


@_register(rf"""
    SELECT word, regexp_matches(word, '{text.NUMBER_PATTERN}') AS is_number FROM (
        SELECT * FROM (VALUES {_CASES}) AS v(word) UNION ALL SELECT DISTINCT printf('%.2f', l_extendedprice) FROM lineitem)
""")
def number_pattern(spark, sf_dir):
    cases = spark.sql(f"SELECT * FROM VALUES {_CASES} AS v(word)")
    prices = _table(spark, sf_dir, "lineitem").select(F.format_string("%.2f", "l_extendedprice").alias("word")).distinct()
    return cases.unionByName(prices).select("word", text.is_number(F.col("word")).alias("is_number"))


@_register("""
    SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '') AS plain, length(format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) AS grouped FROM orders
""")
def comma_strip(spark, sf_dir):
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.strip_commas(grouped).alias("plain"), F.length(grouped).cast("long").alias("grouped"))


@_register("""
    SELECT doc_id, length(rtrim(text, ' ')) BETWEEN 1 AND 63 AS has_full, CASE WHEN length(rtrim(text, ' ')) BETWEEN 1 AND 63 THEN rtrim(text, ' ') END AS full_string FROM documents
""")
def full_string_gate(spark, sf_dir):
    full = text.full_string(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", full.isNotNull().alias("has_full"), full.alias("full_string"))


@_register(r"""
    SELECT c_custkey, replace(trim(c_name), ' ', '') AS squeezed, contains(c_name, ' ') AS spaced, len(list_filter(string_split(c_name || ' x  y', ' '), lambda w: w <> '')) AS words,
        substr(c_name, 3, 4) AS part, '<strong>' || c_mktsegment || '</strong>' AS strong, translate(c_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS folded,
        regexp_matches(c_name, '[#+]') AS marked, regexp_full_match(c_mktsegment, '[\p{Lu}\p{Ll}\p{Nd}]+') AS alnum FROM customer
""")
def string_functions(spark, sf_dir):
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.remove_spaces(F.trim(name)).alias("squeezed"),
        text.has_spaces(name).alias("spaced"),
        F.size(text.split_spaces(F.concat(name, F.lit(" x  y")))).cast("long").alias("words"),
        text.sub_sequence(name, 2, 5).alias("part"),
        text.emphasis(F.col("c_mktsegment")).alias("strong"),
        text.fold(name).alias("folded"),
        text.contains_any(name, "#+").alias("marked"),
        text.is_alnum(F.col("c_mktsegment")).alias("alnum"),
    )


@_register("""
    SELECT o_orderkey, n AS code, chr(CAST(n AS INTEGER)) AS syllable, (n - 44032) // 588 AS i, ((n - 44032) % 588) // 28 AS m, (n - 44032) % 28 AS f, chr(CAST(n AS INTEGER)) AS again
    FROM (SELECT o_orderkey, 44032 + (o_orderkey * 7 + o_custkey) % 11172 AS n FROM orders)
""")
def hangul_elements(spark, sf_dir):
    """A syllable for each order, put together from its elements, taken apart and put together again."""
    orders = _table(spark, sf_dir, "orders")
    made = orders.select("o_orderkey", (F.lit(hangul.FIRST) + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % (hangul.LAST - hangul.FIRST + 1)).alias("code"))
    syllable = hangul.compose(
        F.substr(F.lit(hangul.INITIALS), (F.floor((F.col("code") - hangul.FIRST) / 588) + 1).cast("int"), F.lit(1)),
        F.substr(F.lit(hangul.MEDIALS), (F.floor((F.col("code") - hangul.FIRST) % 588 / 28) + 1).cast("int"), F.lit(1)),
        F.when((F.col("code") - hangul.FIRST) % 28 > 0, F.substr(F.lit(hangul.FINALS), ((F.col("code") - hangul.FIRST) % 28).cast("int"), F.lit(1))).otherwise(F.lit("")),
    )
    c = F.col("syllable")
    split = made.withColumn("syllable", syllable)
    return split.select(
        "o_orderkey",
        "code",
        "syllable",
        (F.instr(F.lit(hangul.INITIALS), hangul.initial(c)) - 1).cast("long").alias("i"),
        (F.instr(F.lit(hangul.MEDIALS), hangul.medial(c)) - 1).cast("long").alias("m"),
        hangul.final_code(c).cast("long").alias("f"),
        hangul.compose(hangul.initial(c), hangul.medial(c), F.coalesce(hangul.final(c), F.lit(""))).alias("again"),
    )


# -- records -------------------------------------------------------------------


def _record_lines(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("PRODUCTCODE"), F.col("o_orderpriority").alias("PRODUCTNAME"), F.date_format("o_orderdate", "yyyyMMdd").alias("REGISTERDATE"), F.col("o_orderstatus").alias("STATUS")
    )
    return orders.select(r.write_record(orders.columns).alias("value"))


@_register("""
    SELECT o_orderkey AS PRODUCTCODE, o_orderpriority AS PRODUCTNAME, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS REGISTERDATE, o_orderstatus AS STATUS, 4 AS fields FROM orders
""")
def record_roundtrip(spark, sf_dir):
    """Rows written as ``[%KEY%]value`` lines and parsed back with their types."""
    parsed = r.parse_records(_record_lines(spark, sf_dir).unionByName(spark.sql("SELECT 'no key here' AS value")))
    columns = r.typed_columns({"PRODUCTCODE": "bigint", "PRODUCTNAME": "string", "REGISTERDATE": "timestamp", "STATUS": "string"})
    return parsed.select(*columns, F.size("fields").alias("fields"))


@_register("SELECT o_orderkey AS PRODUCTCODE, o_orderstatus AS STATUS FROM orders WHERE o_orderstatus <> 'P'")
def rejected_files(spark, sf_dir):
    """Orders written to files by status, read back; files that begin with a line without a key are left out whole."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("PRODUCTCODE"), F.col("o_orderstatus").alias("STATUS"))
    share = F.pmod(F.xxhash64("PRODUCTCODE"), F.lit(8))
    lines = orders.select(F.col("STATUS").alias("folder"), share.alias("share"), F.lit(1).alias("nth"), r.write_record(orders.columns).alias("value"))
    headers = lines.where("folder = 'P'").select("folder", "share").distinct().select("folder", "share", F.lit(0).alias("nth"), F.lit("a header").alias("value"))
    path = shared_dir(spark)
    # A file for each status and share, in which a header comes first.
    dealt = lines.unionByName(headers).repartition("folder", "share").sortWithinPartitions("folder", "share", "nth")
    dealt.select("folder", "share", "value").write.partitionBy("folder", "share").text(path)
    return r.typed_records(r.parse_records(r.accepted_lines(spark, [path])), {"PRODUCTCODE": "bigint", "STATUS": "string"})


@_register("""
    SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS written FROM orders
""")
def date_field(spark, sf_dir):
    day = F.date_format("o_orderdate", r.DATE_FORMAT)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_timestamp(day, F.lit(r.DATE_FORMAT)).alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("written"))


# -- dictionaries --------------------------------------------------------------

#: Every product is a dictionary row whose kind is told by the product's type; these expressions are the same in both engines.
_SOURCE = {
    "id": "CAST(p_partkey AS STRING)",
    "keyword": """CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'SMALL' THEN replace(p_name, ' ', '') WHEN 'LARGE' THEN split_part(p_name, ' ', 1)
        WHEN 'MEDIUM' THEN p_brand ELSE p_name END""",
    "value": """CASE p_type WHEN 'ECONOMY' THEN replace(p_name, ' ', ',') || ',' || p_brand WHEN 'PROMO' THEN p_brand || ',' || split_part(p_name, ' ', 2)
        WHEN 'SMALL' THEN replace(p_name, ' ', ',') WHEN 'LARGE' THEN p_brand || ',' || split_part(p_name, ' ', 2) END""",
    "type": """CASE p_type WHEN 'ECONOMY' THEN 'SYNONYM' WHEN 'PROMO' THEN 'SYNONYM' WHEN 'STANDARD' THEN 'SPACE' WHEN 'SMALL' THEN 'COMPOUND'
        WHEN 'LARGE' THEN 'MAP' ELSE 'STOP' END""",
}
_SOURCE_SQL = f"src AS (SELECT {', '.join(f'{e} AS {name}' for name, e in _SOURCE.items())} FROM part)"
_PAIRS_SQL = f"""
    {_SOURCE_SQL}, one AS (
        SELECT unnest(list_distinct([trim(keyword), replace(trim(keyword), ' ', '')])) AS word, string_split(value, ',') AS vs FROM src WHERE type = 'SYNONYM' AND keyword IS NOT NULL
    ), two AS (SELECT unnest(string_split(value, ',')) AS word, string_split(value, ',') AS vs FROM src WHERE type = 'SYNONYM' AND keyword IS NULL
    ), pairs AS (SELECT DISTINCT word, synonym FROM (SELECT word, unnest(vs) AS synonym FROM one UNION ALL SELECT word, unnest(vs) FROM two) WHERE word <> synonym)
"""
#: Sets grown over words that name the first word, and those that hold one way only.
_CLOSURE_SQL = f"""
    RECURSIVE {_PAIRS_SQL}, found AS (
        SELECT p.word, p.synonym AS other FROM pairs p JOIN pairs b ON p.word = b.synonym AND p.synonym = b.word
        UNION SELECT f.word, p.synonym FROM found f JOIN pairs p ON f.other = p.word JOIN pairs b ON b.word = p.synonym AND b.synonym = f.word WHERE p.synonym <> f.word
    ), sets AS (SELECT word, list_sort(list_append(list(other), word)) AS words FROM found GROUP BY word
    ), single AS (SELECT word, string_agg(synonym, ',' ORDER BY synonym) AS vs FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE b.word = p.synonym AND b.synonym = p.word) GROUP BY word)
"""


def _source(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(*[F.expr(e).alias(name) for name, e in _SOURCE.items()])


def _synonyms(spark, sf_dir):
    return d.of_type(_source(spark, sf_dir), "synonym")


@_register("SELECT DISTINCT replace(trim(word), ' ', '') AS key FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def set_dict(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("keyword"))
    return d.build_set(words)


@_register(f"WITH {_SOURCE_SQL} SELECT keyword AS key, string_split(arg_max(value, id), ',') AS values FROM src WHERE type = 'MAP' GROUP BY keyword", lists=('values',))
def map_dict(spark, sf_dir):
    return d.build_map(d.of_type(_source(spark, sf_dir), "map"))


@_register(f"WITH {_PAIRS_SQL} SELECT word AS key, list_sort(list(synonym)) AS values FROM pairs GROUP BY word", lists=('values',))
def synonym_dict(spark, sf_dir):
    return d.build_synonyms(_synonyms(spark, sf_dir))


@_register(f"WITH {_PAIRS_SQL} SELECT p.word, p.synonym FROM pairs p JOIN pairs b ON p.word = b.synonym AND p.synonym = b.word")
def synonym_mutual(spark, sf_dir):
    return d.mutual_pairs(d.synonym_pairs(_synonyms(spark, sf_dir)))


@_register(f"WITH {_PAIRS_SQL} SELECT DISTINCT word FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE b.word = p.synonym AND b.synonym = p.word)")
def synonym_one_way(spark, sf_dir):
    return d.one_way_words(d.synonym_pairs(_synonyms(spark, sf_dir)))


@_register(f"WITH {_CLOSURE_SQL} SELECT word, words FROM sets", lists=('words',))
def synonym_two_way_sets(spark, sf_dir):
    return d.two_way_sets(d.synonym_pairs(_synonyms(spark, sf_dir)))


@_register(f"""
    WITH {_SOURCE_SQL}, w AS (SELECT unnest(list_concat([trim(coalesce(keyword, ''))], string_split(coalesce(value, ''), ','))) AS w FROM src WHERE type = 'SYNONYM')
    SELECT DISTINCT word FROM (SELECT unnest(list_concat([w], string_split(w, ' '))) AS word FROM w) WHERE word <> ''
""")
def synonym_words(spark, sf_dir):
    return d.word_set(_synonyms(spark, sf_dir))


@_register("""
    WITH built AS (SELECT a.p_type AS key, b.p_type AS value FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_type <> b.p_type UNION SELECT p_type, p_brand FROM part),
    keys AS (SELECT DISTINCT key FROM built), each AS (SELECT DISTINCT key, value FROM built WHERE value IN (SELECT key FROM keys)),
    kept AS (SELECT value AS key FROM each GROUP BY value HAVING count(DISTINCT key) = (SELECT count(*) - 1 FROM keys))
    SELECT key, list_sort(list(value)) AS values FROM each WHERE key IN (SELECT key FROM kept) AND value IN (SELECT key FROM kept) GROUP BY key
""", lists=('values',))
def synonym_cliques(spark, sf_dir):
    """Types of products that all other types share a name with."""
    part = _table(spark, sf_dir, "part")
    named = part.select("p_name", F.col("p_type").alias("key")).distinct()
    shared = named.join(named.withColumnRenamed("key", "value"), "p_name").where("key <> value").select("key", "value")
    pairs = shared.unionByName(part.select(F.col("p_type").alias("key"), F.col("p_brand").alias("value")))
    return d.mutual_cliques(pairs.groupBy("key").agg(F.collect_set("value").alias("values")))


@_register(f"WITH {_SOURCE_SQL} SELECT DISTINCT regexp_replace(trim(keyword), '\\s', '', 'g') AS key, string_split(trim(keyword), ' ') AS values FROM src WHERE type = 'SPACE'", lists=('values',))
def space_dict(spark, sf_dir):
    return d.build_space(d.of_type(_source(spark, sf_dir), "space"))


@_register(f"WITH {_SOURCE_SQL} SELECT DISTINCT keyword AS key, string_split(value, ',') AS values FROM src WHERE type = 'COMPOUND'", lists=('values',))
def compound_dict(spark, sf_dir):
    return d.build_compound(d.of_type(_source(spark, sf_dir), "compound"))


@_register("SELECT p_name AS key, CAST(p_partkey AS VARCHAR) AS id, string_split(p_brand || ',' || p_type, ',') AS values FROM part", lists=('values',))
def custom_dict(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return d.build_custom(part.select(F.col("p_name").alias("keyword"), F.col("p_partkey").cast("string").alias("id"), F.concat_ws(",", "p_brand", "p_type").alias("value")))


@_register("SELECT p_type AS key, list_sort(list(DISTINCT p_name)) AS values FROM part GROUP BY p_type", lists=('values',))
def invert_dict(spark, sf_dir):
    part = _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.collect_set("p_type").alias("values"))
    return d.invert(part)


@_register("""
    SELECT word, tag, CAST(max(prob) AS DOUBLE) AS prob FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, 'N' AS tag, -13.0 AS prob FROM part
        UNION ALL SELECT * FROM (VALUES ('ring', 'N', -8.0), ('ring', 'V', -16.0), ('rod', 'N', -16.0)) AS v(word, tag, prob)) GROUP BY word, tag
""")
def noun_injection(spark, sf_dir):
    system = spark.sql("SELECT * FROM VALUES ('ring', 'N', -8.0D), ('ring', 'V', -16.0D), ('rod', 'N', -16.0D) AS v(word, tag, prob)")
    return d.inject_nouns(system, set_dict(spark, sf_dir), "MID")


@_register("""
    WITH lines AS (SELECT unnest(list_append(string_split(p_name, ' '), substr(p_brand, 1, 1))) AS word, p_type, -p_size AS score FROM part),
    tagged AS (SELECT word, CASE p_type WHEN 'ECONOMY' THEN 'N' WHEN 'LARGE' THEN 'N' WHEN 'MEDIUM' THEN 'V' WHEN 'PROMO' THEN 'J' WHEN 'STANDARD' THEN 'XPN' END AS tag, score FROM lines)
    SELECT word, tag, CAST(max(CASE WHEN length(word) = 1 AND score > -13 THEN -16 ELSE score END) AS DOUBLE) AS prob FROM tagged WHERE tag IS NOT NULL AND (length(word) > 1 OR tag = 'N') GROUP BY word, tag
""")
def scored_words(spark, sf_dir):
    """Lines of word, tag and score, among comments and blank lines, read into the system dictionary."""
    tags = F.create_map(*[F.lit(x) for pair in {"ECONOMY": "NNG", "LARGE": "NNP", "MEDIUM": "VV", "PROMO": "JKS", "SMALL": "ZZ", "STANDARD": "XPN"}.items() for x in pair])
    words = F.explode(F.concat(F.split("p_name", " "), F.array(F.substring("p_brand", 1, 1)))).alias("word")
    part = _table(spark, sf_dir, "part").select(words, F.element_at(tags, F.col("p_type")).alias("tag"), (-F.col("p_size")).cast("string").alias("score"))
    told = part.select(F.concat_ws("\t", "word", "tag", "score").alias("value"))
    noise = part.select(F.concat(F.lit("# "), "word").alias("value")).unionByName(part.select(F.lit("").alias("value"))).unionByName(part.select(F.col("word").alias("value")))
    return d.scored_words(told.unionByName(noise))


_APPLIED = "CASE o_orderstatus WHEN 'F' THEN 'STOP' WHEN 'O' THEN 'SYNONYM' ELSE 'SPACE' END"


@_register(f"""
    WITH {_SOURCE_SQL}, c AS (SELECT type AS name, count(*) AS n FROM src GROUP BY type),
    log AS (SELECT {_APPLIED} AS name, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS applied_time, count(*) AS applied_count FROM orders GROUP BY 1)
    SELECT v.name, v.kind, coalesce(n, 0) AS count, applied_time, coalesce(applied_count, 0) AS applied_count
    FROM (VALUES {', '.join(f"('{c.name.upper()}', '{c.kind}')" for c in d.CONFIGURED)}) AS v(name, kind) LEFT JOIN c ON c.name = v.name LEFT JOIN log ON log.name = v.name
""")
def dict_info(spark, sf_dir):
    """Each dictionary with its rows and with what an apply log says of it."""
    log = _table(spark, sf_dir, "orders").groupBy(F.expr(_APPLIED).alias("id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("applied_time"), F.count("*").alias("count"))
    return d.dictionary_info(_source(spark, sf_dir), log)


@_register(f"WITH {_SOURCE_SQL} SELECT * FROM src WHERE keyword = 'widget' OR list_contains(string_split(coalesce(value, ''), ','), 'widget')")
def dict_find(spark, sf_dir):
    return d.find_word(_source(spark, sf_dir), "widget")


@_register("SELECT DISTINCT word AS key FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) < 8 AND word NOT IN (SELECT DISTINCT lower(p_type) FROM part)")
def dict_diff(spark, sf_dir):
    return d.difference(set_dict(spark, sf_dir), _table(spark, sf_dir, "part").select(F.lower("p_type").alias("key")).distinct())


@_register("""
    SELECT CAST(user_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS applied_time, event_id AS count FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) = 1
""")
def apply_log_upsert(spark, sf_dir):
    """The latest row of each id."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("applied_time"), F.col("event_id").alias("count"))
    return d.upsert_log(events.where("count % 2 = 0"), events.where("count % 2 <> 0"))


@_register(f"""
    SELECT p_partkey, word, CASE WHEN {_FOLD.format('word')} IN ('RED', 'WIDGET') THEN 'x' END AS mark FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
""")
def folded_lookup(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return d.lookup(words, spark.sql("SELECT * FROM VALUES ('Red', 'x'), ('wIdGet', 'x') AS v(key, mark)"))


@_register(f"""
    SELECT p_partkey, word FROM (SELECT p_partkey, unnest(list_append(string_split(p_name, ' '), p_brand)) AS word FROM part)
    WHERE {_FOLD.format('word')} NOT IN ('RED', 'OLD') AND {_FOLD.format('word')} NOT IN (SELECT {_FOLD.format('p_brand')} FROM part WHERE p_type = 'MEDIUM')
""")
def stop_filter(spark, sf_dir):
    """Words of names and brands without the stop words: two words, and brands that the table makes stop words."""
    words = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("word"))
    more = spark.sql("SELECT * FROM VALUES ('a', 'red', NULL, 'STOP'), ('b', 'old', NULL, 'STOP') AS v(id, keyword, value, type)")
    stops = d.compile_dictionary(_source(spark, sf_dir).unionByName(more), d.DictionaryConfig("stop", "SET")).select(text.fold(F.col("key")).alias("stop"))
    return words.join(stops, text.fold(F.col("word")) == F.col("stop"), "left_anti")


@_register(f"WITH {_CLOSURE_SQL} SELECT DISTINCT CAST(NULL AS VARCHAR) AS keyword, array_to_string(words, ',') AS value FROM sets UNION ALL SELECT word, vs FROM single")
def dict_restore(spark, sf_dir):
    config = d.DictionaryConfig("synonym", "SYNONYM")
    return d.restore_rows(d.compile_dictionary(_source(spark, sf_dir), config), config).select("keyword", "value")


@_register(f"WITH {_PAIRS_SQL} SELECT word AS key, list_sort(list(synonym)) AS values FROM pairs GROUP BY word", lists=('values',))
def dictionary_versions(spark, sf_dir):
    """Synonyms after a second version, for which only the keys of changed rows were compiled anew."""
    source = _source(spark, sf_dir)
    # Before, rows of small sizes had other values.
    earlier = source.join(_table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("id"), "p_brand"), "id", "left")
    earlier = earlier.withColumn("value", F.when(F.col("p_brand").isNotNull(), F.concat_ws(",", F.lit("other"), "p_brand")).otherwise(F.col("value")))
    store = versions.DictionaryStore(spark, shared_dir(spark))
    store.compile(earlier, "2024-01-01 00:00:00", {"synonym"})
    store.compile(source, "2024-01-02 00:00:00", {"synonym"})
    return store.tables()["synonym"]


# -- search --------------------------------------------------------------------

_NAMES = "names AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS term FROM part)"


@_register(f"""
    SELECT p_partkey AS doc, 'p_name' AS field, unnest(string_split(p_name, ' ')) AS term, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part
    UNION ALL SELECT p_partkey, 'p_type', p_type, 0 FROM part
""")
def postings(spark, sf_dir):
    return s.postings(_table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"]).withColumn("pos", F.col("pos").cast("long"))


def _found(spark, sf_dir, asked, boosts=None):
    part = _table(spark, sf_dir, "part")
    return s.matches(s.postings(part, "p_partkey", list(boosts or {"p_name": 1.0})), asked, boosts)


@_register(f"WITH {_NAMES} SELECT doc, CAST(2 AS DOUBLE) AS score FROM names WHERE term IN ('red', 'widget') GROUP BY doc HAVING count(DISTINCT term) = 2")
def search_and(spark, sf_dir):
    """Products with both words."""
    return _found(spark, sf_dir, [q.clause("red"), q.clause("widget")])


@_register(f"WITH {_NAMES} SELECT doc, CAST(2 AS DOUBLE) AS score FROM names GROUP BY doc HAVING bool_or(term = 'red') AND bool_or(term IN ('widget', 'gizmo'))")
def search_synonyms(spark, sf_dir):
    return _found(spark, sf_dir, [q.clause("red"), q.clause("widget", ("gizmo", "round thing"))])


@_register(f"WITH {_NAMES} SELECT doc, CAST(2 AS DOUBLE) AS score FROM names GROUP BY doc HAVING bool_or(term = 'ringrod') OR (bool_or(term IN ('ring', 'bolt')) AND bool_or(term = 'hot'))")
def search_extras(spark, sf_dir):
    """A word or all of its parts, one of which has a synonym."""
    return _found(spark, sf_dir, [q.clause("ringrod", (), (("ring", ("bolt",)), ("hot", ())))])


@_register(f"WITH {_NAMES} SELECT doc, CAST(max(CASE WHEN term = 'PROMO' THEN 3 ELSE 1 END) AS DOUBLE) AS score FROM (SELECT * FROM names UNION ALL SELECT p_partkey, p_type FROM part) WHERE term IN ('PROMO', 'ring') GROUP BY doc")
def search_boosts(spark, sf_dir):
    return _found(spark, sf_dir, [q.clause("PROMO", ("ring",))], q.parse_fields("p_name,p_type^3"))


@_register("""
    SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_size IN (1, 2, 3, 5, 8, 9, 11, 13, 16, 19, 21, 24, 25, 28) AND p_retailprice >= 900 AND p_retailprice < 1500 AND NOT list_contains(string_split(p_name, ' '), 'old')
        AND (list_contains(string_split(p_name, ' '), 'ring') OR list_contains(string_split(p_name, ' '), 'rod') OR list_contains(string_split(p_name, ' '), 'widget'))
""")
def user_filters(spark, sf_dir):
    """A JSON filter of term, terms, range, match and bool; the plain comparisons reach the Parquet scan."""
    query = {"bool": {"must": [{"term": {"p_type": "PROMO"}}, {"match": {"p_name": "ring rod widget"}}], "filter": [{"terms": {"p_size": [1, 2, 3, 5, 8, 9, 11, 13, 16, 19, 21, 24, 25, 28]}}, {"range": {"p_retailprice": {"gte": 900, "lt": 1500}}}], "must_not": {"match": {"p_name": "old"}}}}
    return _table(spark, sf_dir, "part").where(q.predicate(query)).select("p_partkey", "p_name")


@_register("""
    SELECT p_partkey, (list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'ring')) AS phrase, len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'hot'])) >= 2 AS set_of, p_name = 'red ring' AS whole FROM part
""")
def user_text_queries(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        q.predicate({"query_string": {"query": "red ring", "fields": ["p_name"], "default_operator": "AND"}}).alias("phrase"),
        q.predicate({"terms_set": {"p_name": {"terms": ["red", "ring", "hot"], "minimum_should_match": 2}}}).alias("set_of"),
        q.predicate({"match_phrase": {"p_name": "red ring"}}).alias("whole"),
    )


@_register("""
    SELECT p_partkey, CAST(1.0 + CASE WHEN p_size > 25 THEN 10 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 5 ELSE 0 END + CASE WHEN NOT (p_size > 25) AND p_type <> 'PROMO' THEN 1 ELSE 0 END AS DOUBLE) AS score FROM part
""")
def function_score(spark, sf_dir):
    query = {"functions": [{"filter": {"range": {"p_size": {"gt": 25}}}, "weight": 10}, {"filter": {"term": {"p_type": "PROMO"}}, "weight": 5}], "score_mode": "sum", "boost_mode": "sum"}
    return _table(spark, sf_dir, "part").select("p_partkey", q.function_score(F.lit(1.0), query).alias("score"))


@_register(f"""
    WITH {_NAMES}, f AS (SELECT doc FROM names WHERE term IN ('red', 'widget') GROUP BY doc HAVING count(DISTINCT term) = 2)
    SELECT p_partkey, p_name FROM part JOIN f ON doc = p_partkey WHERE p_type = 'PROMO'
""")
def user_query_merge(spark, sf_dir):
    """A function_score's own filters with the analysed query in place of its ``must``."""
    user = {"function_score": {"query": {"bool": {"must": {"match": {"p_name": "unused"}}, "filter": {"term": {"p_type": "PROMO"}}}}}}
    part = _table(spark, sf_dir, "part").where(q.merge_user_query(F.lit(True), user))
    return part.join(search_and(spark, sf_dir), F.col("p_partkey") == F.col("doc")).select("p_partkey", "p_name")


@_register("""
    SELECT p_partkey, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS INTEGER) AS _rownum, [CAST(p_partkey AS VARCHAR)] AS _sort FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 10
""", lists=('_sort',))
def topk_paging(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return s.page(part, [F.col("p_retailprice").desc(), F.col("p_partkey")], 10, 15, ["p_partkey"])


@_register("""
    SELECT l_orderkey, l_linenumber, l_extendedprice, n - 1 AS _rownum, concat_ws(',', l_orderkey, l_linenumber) AS _sort FROM (
        SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
    WHERE n > (SELECT count(*) * 5 // 6 FROM lineitem) AND n <= (SELECT count(*) * 5 // 6 FROM lineitem) + 25
""")
def deep_page(spark, sf_dir):
    """A page far down a sorted table, from the ranges that it lies in."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    ranked = pages.store_ranked(items, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], shared_dir(spark))
    found = ranked.page(ranked.total * 5 // 6, 25, ["l_orderkey", "l_linenumber"])
    return found.drop("l_partkey").withColumn("_sort", F.array_join("_sort", ","))


@_register(f"WITH {_NAMES} SELECT count(DISTINCT doc) AS total FROM names WHERE term = 'red'")
def total_hits(spark, sf_dir):
    return s.total(_found(spark, sf_dir, [q.clause("red")]))


@_register("SELECT p_partkey, regexp_replace(p_name, '\\b(red|widget)\\b', '<b>\\1</b>', 'g') AS marked FROM part")
def highlight(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", s.highlight(F.col("p_name"), ["RED", "widget"]).alias("marked"))


_SHOWN = ("THE", "THING", "ANEA", "THANEDBLE")


@_register(f"""
    WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUNS}', 1)) AS run, generate_subscripts(regexp_extract_all(text, '{_RUNS}', 1), 1) AS i FROM documents),
    o AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot, {_FOLD.format('run')} AS folded,
        replace(replace(replace(run, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM r),
    f AS (SELECT doc_id, spot // 120 AS k, count(DISTINCT folded) FILTER (folded IN {_SHOWN}) AS score, string_agg(CASE WHEN folded IN {_SHOWN} THEN '<b>' || safe || '</b>' ELSE safe END, '' ORDER BY i) AS piece FROM o GROUP BY ALL),
    b AS (SELECT doc_id, piece FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1)
    SELECT doc_id, coalesce(trim(piece, ' '), text) AS shown FROM documents LEFT JOIN b USING (doc_id)
""")
def best_fragments(spark, sf_dir):
    """The piece of each document with the most of four words."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", s.best_fragment(F.col("text"), ["the", "thing", "anea", "thanedble"], 120).alias("shown"))


@_register("SELECT p_name AS name, p_brand AS brand FROM part UNION ALL SELECT s_name, NULL FROM supplier")
def multi_index(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return s.many([part, _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))])


@_register(f"""
    WITH t AS (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(text, '{_RUNS}', 1), lambda x: regexp_matches(x, '{_TERM}'))) AS term FROM documents),
    dl AS (SELECT doc, count(*) AS dl FROM t GROUP BY doc), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    tf AS (SELECT doc, term, count(*) AS tf FROM t WHERE term IN ('the', 'thing', 'oning') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc), w GROUP BY doc
""")
def bm25(spark, sf_dir):
    docs = s.postings(_table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return s.bm25(docs, ["the", "thing", "oning"]).withColumn("score", F.round("score", 6))


_STORED: dict[tuple[str, str, str], ix.StoredIndex] = {}


def _stored(spark, sf_dir, name: str, key: str, fields: list[str]) -> ix.StoredIndex:
    """The stored index of one table, built once for a session."""
    known = (spark.sparkContext.applicationId, sf_dir, name)
    if known not in _STORED:
        _STORED[known] = ix.write_texts(_table(spark, sf_dir, name), key, fields, shared_dir(spark))
    return _STORED[known]


def _stored_documents(spark, sf_dir):
    return _stored(spark, sf_dir, "documents", "doc_id", ["text", "source", "lang"])


def _stored_parts(spark, sf_dir):
    return _stored(spark, sf_dir, "part", "p_partkey", ["p_name", "p_brand", "p_type"])


def _best_field_sql(table: str, key: str, boosts: dict[str, float], words: list[str]) -> str:
    """SQL for t(doc, field, term), and for sc(doc, term, field, s): each word's BM25 score in each field."""
    tokens = " UNION ALL ".join(
        f"SELECT {key} AS doc, '{f}' AS field, CAST({b} AS DOUBLE) AS boost, unnest(list_filter(regexp_extract_all({f}, '{_RUNS}', 1), lambda x: regexp_matches(x, '{_TERM}'))) AS term FROM {table}" for f, b in boosts.items()
    )
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
        t AS ({tokens}), dl AS (SELECT doc, field, count(*) AS dl FROM t GROUP BY ALL), w AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY field),
        tf AS (SELECT doc, field, boost, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY ALL), df AS (SELECT term, field, count(*) AS df FROM tf GROUP BY ALL),
        sc AS (SELECT doc, term, field, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (term, field) JOIN dl USING (doc, field) JOIN w USING (field)),
        best AS (SELECT doc, max(s) AS score FROM (SELECT doc, field, sum(s) AS s FROM sc GROUP BY ALL) GROUP BY doc)"""


_DOC_BOOSTS, _DOC_WORDS = {"text": 1.5, "source": 2.0, "lang": 1.0}, ["the", "thing", "src", "7", "de"]
_PART_BOOSTS, _PART_WORDS = {"p_name": 1.5, "p_brand": 0.5, "p_type": 2.0}, ["red", "widget", "PROMO", "13"]


@_register(f"WITH {_best_field_sql('documents', 'doc_id', {'text': 1.0}, ['the', 'thing', 'oning'])} SELECT doc, round(score, 6) AS score FROM best")
def bm25_stored(spark, sf_dir):
    """BM25 of all documents with one of three words, from those words' blocks of the stored index."""
    return _stored_documents(spark, sf_dir).best_field(["the", "thing", "oning"], {"text": 1.0}).withColumn("score", F.round("score", 6))


@_register(f"WITH {_best_field_sql('documents', 'doc_id', _DOC_BOOSTS, _DOC_WORDS)} SELECT doc, round(score, 6) AS score FROM best")
def best_field_documents(spark, sf_dir):
    """The best of three boosted fields, each with its own length statistics."""
    return _stored_documents(spark, sf_dir).best_field(_DOC_WORDS, _DOC_BOOSTS).withColumn("score", F.round("score", 6))


@_register(f"WITH {_best_field_sql('part', 'p_partkey', _PART_BOOSTS, _PART_WORDS)} SELECT doc, round(score, 6) AS score FROM best")
def best_field_parts(spark, sf_dir):
    return _stored_parts(spark, sf_dir).best_field(_PART_WORDS, _PART_BOOSTS).withColumn("score", F.round("score", 6))


@_register(f"WITH {_best_field_sql('documents', 'doc_id', _DOC_BOOSTS, _DOC_WORDS)} SELECT doc, round(score, 6) AS score FROM best ORDER BY round(score, 9) DESC, doc LIMIT 40")
def top_documents(spark, sf_dir):
    """The 40 best documents, for which most groups are left out by their bounds."""
    return _stored_documents(spark, sf_dir).top(_DOC_WORDS, _DOC_BOOSTS, 40).withColumn("score", F.round("score", 6))


@_register(f"""
    WITH {_best_field_sql('part', 'p_partkey', _PART_BOOSTS, ['red', 'widget', 'gizmo', 'hot', 'ring'])},
    one AS (SELECT doc, term, max(s) AS s FROM sc GROUP BY ALL), wide AS (SELECT doc, max(s) FILTER (term = 'red') AS red, max(s) FILTER (term = 'widget') AS widget, max(s) FILTER (term = 'gizmo') AS gizmo, max(s) FILTER (term = 'hot') + max(s) FILTER (term = 'ring') AS hot_ring FROM one GROUP BY doc)
    SELECT doc, round(greatest(red, hot_ring) + greatest(widget, gizmo), 6) AS score FROM wide WHERE greatest(red, hot_ring) IS NOT NULL AND greatest(widget, gizmo) IS NOT NULL
""")
def search_stored(spark, sf_dir):
    """Clauses with synonyms of one and two words, scored by relevance, from the stored index."""
    asked = [q.clause("red", ("hot ring",)), q.clause("widget", ("gizmo",))]
    return _stored_parts(spark, sf_dir).matches(asked, _PART_BOOSTS).withColumn("score", F.round("score", 6))


def _phrase_sql(words: list[str], slop: int) -> str:
    """All places of each word, moved back by its place in the phrase, within the slop of each other."""
    tokens = f"SELECT doc_id AS doc, list_filter(regexp_extract_all(text, '{_RUNS}', 1), lambda x: regexp_matches(x, '{_TERM}')) AS ws FROM documents"
    joins = " ".join(f"JOIN p p{k} ON p{k}.doc = p0.doc AND p{k}.term = '{w}' AND abs(p{k}.pos - {k} - p0.pos) <= {slop}" for k, w in enumerate(words) if k)
    moved = ", ".join(f"p{k}.pos - {k}" for k in range(len(words)))
    return f"""
        WITH t AS ({tokens}), p AS (SELECT doc, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM t)
        SELECT DISTINCT p0.doc, 'text' AS field FROM p p0 {joins} WHERE p0.term = '{words[0]}' AND greatest({moved}) - least({moved}) <= {slop}"""


_PHRASE, _LOOSE = ["thanedble", "the", "anea", "Eriner"], ["and", "the", "thing"]


@_register(_phrase_sql(_PHRASE, 0))
def phrase_exact(spark, sf_dir):
    """Documents with four words in a row, by the positions in the postings."""
    return _stored_documents(spark, sf_dir).phrase(_PHRASE, ["text"])


@_register(_phrase_sql(_LOOSE, 4))
def phrase_sloppy(spark, sf_dir):
    """Documents with three words in order or nearly so."""
    return _stored_documents(spark, sf_dir).phrase(_LOOSE, ["text"], 4)


@_register("""
    WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_brand AS s FROM part), m AS (SELECT *, '","fields":["p_name"],"analyzer":"whitespace"}}' AS rest, '{"multi_match":{"query":"' AS head FROM w)
    SELECT p_partkey, '{"bool":{"must":[{"bool":{"should":[' || head || a || rest || ',{"bool":{"must":[' || head || s || rest || ',' || head || 'new' || rest || ']}}]}},' || head || b || rest || ']}}' AS query,
        '{"AND":[{"OR":["' || a || '",{"AND":["' || s || '","new"]}]},"' || b || '"]}' AS tree FROM m
""")
def query_json(spark, sf_dir):
    """The JSON forms of a search for each product's two words, the first with a synonym of two words."""
    part = _table(spark, sf_dir, "part")
    tokens = F.transform(F.split("p_name", " "), lambda w, k: F.struct(w.alias("term"), F.lit("ALPHA").alias("type"), F.when(k == 0, F.array(F.concat(F.col("p_brand"), F.lit(" new")))).otherwise(F.array().cast("array<string>")).alias("synonyms")))
    both = q.written(tokens, ["p_name"])
    return part.select("p_partkey", both["query"].alias("query"), both["tree"].alias("tree"))


@_register(r"""
    SELECT page_id, regexp_extract_all(url, '[A-Za-z0-9]+(?:[-./&][A-Za-z0-9]+)*') AS chunks, len(list_filter(regexp_extract_all(url, '[A-Za-z0-9]+(?:[-./&][A-Za-z0-9]+)*'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))) AS models FROM pages
""", lists=('chunks',))
def model_name_candidates(spark, sf_dir):
    """Chunks of letters and digits joined by single connectors; those with both are model names."""
    chunks = text.connected_chunks(F.col("url"))
    both = F.filter(chunks, text.letters_and_digits)
    return _table(spark, sf_dir, "pages").select("page_id", chunks.alias("chunks"), F.size(both).cast("long").alias("models"))


@_register("SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS everything, concat_ws(' ', p_brand, p_type) AS maker, CASE WHEN length(p_name) <= 9 THEN p_name END AS exact_name FROM part")
def copied_fields(spark, sf_dir):
    """Fields gathered into searchable ones, and the variant for exact comparison."""
    part = mapping.with_copies(_table(spark, sf_dir, "part"), {"everything": ("p_name", "p_brand", "p_type"), "maker": ("p_brand", "p_type", "not_there")})
    return part.select("p_partkey", "everything", "maker", mapping.exact(F.col("p_name"), 9).alias("exact_name"))


@_register("SELECT page_id, regexp_extract(url, '^[^?#]*') AS plain, regexp_replace(regexp_extract(url, '[?].*'), '%20', ' ', 'g') AS asked FROM pages")
def url_parameters(spark, sf_dir):
    """Addresses and their decoded parameters."""
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", text.url_path(url).alias("plain"), text.url_query(url).alias("asked"))
