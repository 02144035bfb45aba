"""Main text of web pages by templates deduced for each host.

A page is a sequence of tokens: the opening and closing of its containers,
told apart by their paths, and its texts. Tokens of a host that have the same
occurrence vector over the host's pages are an equivalence class; Spark groups
them by the vector's hash, so no page list is gathered. A class of enough
tokens on enough of the host's pages is valid; the valid classes are the host's
template, and the path of the main one among their containers is its slot for
the article. Containers that hold each other are nested by their paths; classes
are not tested for nesting in each other. What the template repeats within
the slot stays, as an article may be on many pages; only where no container is
told apart as the slot do the texts between repeated ones remain.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, read_table, row_key, stage

#: A class needs so many tokens, so many pages, and this share of its host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.5
#: A container without a telling name is the main one if it holds this share of a host's text.
MAIN_SHARE = 0.6
#: Up to so many template entries (about 100 bytes each) all templates are broadcast; beyond, pages are joined to them.
BROADCAST_ENTRIES = 500_000
SALTS = 16

# Element names of the HTML standard.
MAIN_TAGS = frozenset("article main".split())
SKIPPED_TAGS = frozenset("head title nav footer aside form button select menu dialog iframe svg".split())
CONTAINER_TAGS = frozenset("html body div section table ul ol dl figure header blockquote fieldset details".split()) | MAIN_TAGS | SKIPPED_TAGS
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th caption figcaption summary hr address legend option".split()) | CONTAINER_TAGS
# Common words of web pages that name what is not the article, as parts of class and id. The second set also names layouts
# around an article, so an article or main element inside such a container counts again.
SKIPPED_NAMES = frozenset(
    "ad adbox ads adsense advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr login menu modal nav navbar"
    " navigation newsletter notice notices pager pagination popup promo related replies reply responses share sharing signup skip social sponsor sponsored subscribe toolbar".split()
)
LAYOUT_NAMES = frozenset("banner form header masthead search sidebar topbar widget".split())
HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none", re.I)

#: Containers nested deeper than this have the path of the one at this depth; what they skip is skipped all the same.
DEEPEST = 512

# A tag ends before the next one begins, so that marks that are never closed cost no more than their own length.
_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})>|<[!?/][^<>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """A container's name in paths, and how surely its own name tells that it is not the article's: 0 not at all, 1 it may still hold the article, 2 surely."""
    by_tag = 1 if tag == "form" else 2 if tag in SKIPPED_TAGS else 0
    if not attributes.strip():
        return tag, by_tag
    names = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMED.findall(attributes)}
    label = ".".join([tag, *names.get("class", "").split()])
    label = "main" if names.get("role") == "main" else label
    if tag in ("html", "body"):
        return label, 0
    parts = {w for k in ("class", "id") for w in re.split(r"[^a-z0-9]+", names.get(k, ""))}
    if parts & SKIPPED_NAMES or HIDDEN.search(attributes) or names.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search"):
        return label, 2
    return label, by_tag if tag in MAIN_TAGS or by_tag or not parts & LAYOUT_NAMES else 1


def parse(page: str) -> Iterator[tuple[str, str, bool]]:
    """Events (kind, value, skipped): "open" and "close" with a container's path, "text" with a piece of text, "block" at block borders.

    ``skipped`` holds inside what is not the article's by tag, class, id or
    being hidden. A page's header is skipped, an article's own header is not.
    Closing tags without an opening one are passed over; containers left open end with their parent.
    """
    stack: list[tuple[str, str, int, bool]] = []
    held: Counter[str] = Counter()
    path, level, block, at = "", 0, 0, 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], max(level, block) > 0
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                yield "text", " ", max(level, block) > 0
            continue
        tag = tag.lower()
        if tag == "br":
            yield "text", " ", max(level, block) > 0
        elif tag in CONTAINER_TAGS:
            block = 0
            if m[2]:
                if not held[tag]:
                    yield "block", "", level > 0
                while held[tag]:
                    own, before, was, named = stack.pop()
                    held[own] -= 1
                    yield ("close", path, level > 0) if named else ("block", "", level > 0)
                    path, level = before, was
                    if own == tag:
                        break
            else:
                label, sure = _label(tag, m[4])
                inside = any(held[main] for main in MAIN_TAGS)
                if tag == "header" and not inside:
                    sure = 2
                elif sure == 1 and inside and tag != "form":
                    sure = 0
                named = len(stack) < DEEPEST
                stack.append((tag, path, level, named))
                held[tag] += 1
                level = 0 if tag in MAIN_TAGS and not sure and level == 1 else max(level, sure)
                if named:
                    path = f"{path}>{label}"
                    yield "open", path, level > 0
                else:
                    yield "block", "", level > 0
        elif tag in BLOCK_TAGS:
            block = 2 if not m[2] and m[4].strip() and _label(tag, m[4])[1] == 2 else 0
            yield "block", "", max(level, block) > 0
    if at < len(page):
        yield "text", page[at:], max(level, block) > 0
    while stack:
        _, before, was, named = stack.pop()
        yield ("close", path, level > 0) if named else ("block", "", level > 0)
        path, level = before, was


def _clean(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], bool]]:
    """(text, open containers, skipped) of each block that is not empty, in page order."""
    pieces: list[str] = []
    open_paths: list[str] = []
    held = False
    for kind, value, skipped in parse(page):
        if kind == "text":
            if pieces and skipped != held:
                pieces.append(" ")
            pieces.append(value)
            held = skipped
            continue
        if pieces and (text := _clean(pieces)):
            yield text, tuple(open_paths), held
        pieces = []
        if kind == "open":
            open_paths.append(value)
        elif kind == "close":
            open_paths.pop()
    if pieces and (text := _clean(pieces)):
        yield text, tuple(open_paths), held


def token_hash(kind: str, value: str) -> int:
    number = xxhash.xxh64_intdigest(f"{kind}{value}".encode("utf-8", "replace"))
    return number - (1 << 64) if number >> 63 else number


def page_tokens(page: str) -> list[dict]:
    """The page's tokens: hash, occurrences, first place, path of a container (else null), characters of text in it that could be the article's."""
    count, first, paths, inside = Counter(), {}, {}, Counter()
    for k, (kind, value, _) in enumerate(parse(page)):
        if kind in ("open", "close"):
            token = token_hash(kind, value)
            count[token] += 1
            first.setdefault(token, k)
            if kind == "open":
                paths[token] = value
    for k, (text, open_paths, skipped) in enumerate(blocks(page)):
        token = token_hash("text", text)
        count[token] += 1
        first.setdefault(token, k)
        if not skipped:
            for path in set(open_paths):
                inside[path] += len(text)
    return [{"token": t, "times": n, "place": first[t], "path": paths.get(t), "chars": inside.get(paths.get(t), 0)} for t, n in count.items()]


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), row_key("html").alias("body"))


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, pages, main, repeated): of each host, its number of pages, the path of its main container, and its repeated texts.

    ``main`` is null where no class is valid; ``repeated`` has the hashes of the texts
    in valid classes. Pages without a host share the empty one.
    """

    @F.pandas_udf("array<struct<token: long, times: int, place: int, path: string, chars: long>>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in parts:
            yield pd.Series([page_tokens(h or "") for h in htmls])

    hosted = _with_host(pages)
    # Pages of a host with the same text are one page, or an article of many addresses would look like the template.
    copied = hosted.groupBy("host", "body").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    hosted = hosted.join(few(stage(copied)), ["host", "body"], "left").where("first IS NULL OR first = page")
    each = hosted.select("host", "page", F.inline(tokens("html")))
    sign = F.xxhash64("page", "times")
    # Rows that are repeated cancel out in the first half of the vector, not in the second.
    vector = F.struct(F.bit_xor(sign).alias("x"), F.sum(sign.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    vectors = each.groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.sum("times").alias("total"),
        vector.alias("vector"),
        F.sum("place").alias("places"),
        F.max("path").alias("path"),
        F.sum("chars").alias("chars"),
    )
    sizes = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = vectors.where(f"support >= {LEAST_PAGES}").join(sizes, "host").where(f"support >= {LEAST_SHARE} * pages")
    # A class has the tokens of one page at most, since each of its pages has all of them.
    classes = frequent.groupBy("host", "pages", "support", "total", "vector").agg(F.collect_list(F.struct("places", "token", "path", "chars")).alias("members"))
    classes = classes.where(f"size(members) >= {LEAST_TOKENS}")
    members = classes.select("host", "pages", "support", F.explode("members").alias("m")).select("host", "pages", "support", "m.*")
    # Containers nest by their paths.
    whole = F.max("chars").over(Window.partitionBy("host"))
    named = members.withColumn("whole", whole).withColumn("tag", F.regexp_extract("path", r">([a-z0-9]+)[^>]*$", 1))
    rank = F.when(F.col("tag").isin(*MAIN_TAGS), F.lit(2)).when(F.col("chars") >= MAIN_SHARE * F.col("whole"), F.lit(1)).otherwise(F.lit(0))
    depth = F.size(F.split("path", ">"))
    named = named.withColumn("rank", F.when(F.col("path").isNotNull() & (F.col("chars") > 0), rank).otherwise(F.lit(0)))
    # The main container: one with a telling name, the outermost and fullest of these; else the innermost that has most of the text.
    best = F.max(F.when(F.col("rank") > 0, F.struct("rank", F.when(F.col("rank") == 2, -depth).otherwise(depth).alias("d"), "chars", "path")))
    return named.groupBy("host").agg(F.max("pages").alias("pages"), best.getField("path").alias("main"), F.collect_set(F.when(F.col("path").isNull(), F.col("token"))).alias("repeated"))


def main_text(page: str | None, main: str | None, repeated: frozenset) -> str:
    """The main text of a page by its host's template; by the page's own containers where that does not fit.

    Texts that the template repeats are dropped only where it has no main container inside the body, since
    an article may be on many pages of a host.
    """
    found = list(blocks(page or ""))
    usable = [(text, open_paths) for text, open_paths, skipped in found if not skipped]
    telling = lambda path: re.match(r"[a-z0-9]+", path.rpartition(">")[2])[0] in MAIN_TAGS
    if main is not None:
        inside = [text for text, open_paths in usable if main in open_paths]
        if inside and telling(main):
            return "\n".join(inside)
    own = [text for text, open_paths in usable if any(telling(p) for p in open_paths)]
    if own:
        return "\n".join(own)
    inside = [text for text, open_paths in usable if main in open_paths] if main is not None else []
    if inside and re.match(r"[a-z0-9]+", main.rpartition(">")[2])[0] not in ("html", "body"):
        return "\n".join(inside)
    rest = inside or [text for text, _ in usable]
    return "\n".join(text for text in rest if token_hash("text", text) not in repeated)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages(page_id, url, html)``.

    Null and empty pages have an empty text. Pages with a null url, or one
    without a host, are taken as pages of one nameless host. Repeated rows each get a row.
    Pages are read whole, in time linear in their length however deep their containers nest.
    """

    @F.pandas_udf("string")
    def extract(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, mains, repeats in parts:
            yield pd.Series([main_text(h, m, frozenset(() if r is None else r)) for h, m, r in zip(htmls, mains, repeats)], dtype=object)

    templates = stage(host_templates(pages))
    entries = templates.agg(F.sum(1 + F.size("repeated"))).first()[0] or 0
    hosted = _with_host(pages)
    if entries <= BROADCAST_ENTRIES:
        joined = hosted.join(F.broadcast(templates), "host", "left")
    else:
        salted = hosted.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
        spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", extract("html", "main", "repeated").alias("text"))


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(read_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
