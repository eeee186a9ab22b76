"""Links out of raw web pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Anchors, result blocks and the entities of plain text.
ANCHOR = r"""(?is)(<a\b[^>]*?\bhref\s*=\s*["'][^"']+["'][^>]*>.*?</a>)"""
HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""
TAG = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
RESULT_CLASS = "result__title"
# Elements that have no content and no closing tag.
VOID = "area base br col embed hr img input link meta source track wbr".split()
# What a page is cut into: comments, scripts and styles whole, tags (quoted values may hold `>`), text.
TOKEN = (
    r"""(?is)(<!--.*?-->|<(?:script|style)\b[^>]*+>.*?</(?:script|style)\s*>"""
    r"""|</?[a-z](?:[^>"']++|"[^"]*"|'[^']*')*+>|<![^>]*+>|[^<]++|<)"""
)
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9:-]*)"
ATTRIBUTE = r"""(?s)([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
ENTITY = r"(?s)(&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&(?:lt|gt|quot|apos|amp|nbsp);|[^&]+|&)"
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&", "&nbsp;": "\u00a0"}
EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def unescape(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def decode_entities(text: Column) -> Column:
    """Common named and all numeric entities, once; what names no character becomes U+FFFD."""

    def sign(part: Column) -> Column:
        digits = F.regexp_extract(part, "([0-9a-fA-F]+);?$", 1)
        base = F.when(F.lower(F.substring(part, 3, 1)) == "x", 16).otherwise(10)
        code = F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        code = F.when(known, code).otherwise(0xFFFD)
        made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(F.startswith(part, F.lit("&#")) & (F.length(part) > 2), made).otherwise(part)
        for entity, character in NAMED.items():
            out = F.when(part == entity, character).otherwise(out)
        return out

    parts = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, sign), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, with or without quotes; null where there is none."""
    inside = F.regexp_replace(F.regexp_replace(tag, r"^<[a-zA-Z][a-zA-Z0-9:-]*", ""), r"/?>$", "")
    names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2))
    at = F.array_position(names, name)
    return F.when(at > 0, decode_entities(F.regexp_replace(F.get(values, (at - 1).cast("int")), r"""^["']|["']$""", "")))


def result_blocks(html: Column, result_class: str) -> Column:
    """array<struct<i, href, label>> of a page's elements of a class, in page order.

    One fold over the tokens of the page. A block is open until the closing tag of its own element:
    tags of the same name inside it are counted, so elements that are never closed (as `p`) don't end
    or extend it; without a closing tag it reaches to the end of the page. Blocks may lie in one
    another. href and label are those of the first anchor inside: null without one, or without an
    address; the label is its text up to its closing tag.
    """
    none = F.lit(None).cast("string")
    entry = "struct<i:int,name:string,depth:int,stage:int,href:string,label:string>"
    start = F.struct(
        F.lit(0).alias("n"),
        F.array().cast(f"array<{entry}>").alias("open"),
        F.array().cast("array<struct<i:int,href:string,label:string>>").alias("done"),
    )

    def parsed(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
        skipped = F.startswith(token, F.lit("<!")) | name.isin("script", "style")
        closing = F.startswith(token, F.lit("</"))
        kind = F.when(skipped, "skip").when(name == "", "text").when(closing, "close").otherwise("open")
        empty = name.isin(VOID) | F.endswith(token, F.lit("/>"))
        own = F.array_contains(F.split(F.coalesce(attribute(token, "class"), F.lit("")), r"\s+"), result_class)
        return F.struct(
            kind.alias("kind"),
            name.alias("name"),
            ((kind == "open") & empty).alias("is_empty"),
            ((kind == "open") & own).alias("is_result"),
            F.when((kind == "open") & (name == "a"), attribute(token, "href")).alias("href"),
            F.when(kind == "text", decode_entities(token)).alias("text"),
        )

    def step(state: Column, t: Column) -> Column:
        opens, closes = t["kind"] == "open", t["kind"] == "close"

        def seen(o: Column) -> Column:
            same = t["name"] == o["name"]
            depth = F.when(opens & same & ~t["is_empty"], o["depth"] + 1).when(closes & same, o["depth"] - 1)
            anchor = t["name"] == "a"
            begins = opens & anchor & (o["stage"] == 0)
            ends = closes & anchor & (o["stage"] == 1)
            label = F.when((o["stage"] == 1) & (t["kind"] == "text"), F.concat(o["label"], t["text"]))
            return F.struct(
                o["i"].alias("i"),
                o["name"].alias("name"),
                depth.otherwise(o["depth"]).alias("depth"),
                F.when(begins, 1).when(ends, 2).otherwise(o["stage"]).alias("stage"),
                F.when(begins, t["href"]).otherwise(o["href"]).alias("href"),
                label.otherwise(o["label"]).alias("label"),
            )

        after = F.transform(state["open"], seen)
        ended = F.transform(F.filter(after, lambda o: o["depth"] == 0), _entry)
        fresh = F.array(
            F.struct(
                state["n"].alias("i"), t["name"].alias("name"), F.lit(1).alias("depth"), F.lit(0).alias("stage"),
                none.alias("href"), F.lit("").alias("label"),
            )
        )
        still = F.filter(after, lambda o: o["depth"] > 0)
        begun = t["is_result"] & ~t["is_empty"]
        moved = F.struct(
            (state["n"] + F.when(t["is_result"], 1).otherwise(0)).alias("n"),
            F.when(begun, F.concat(still, fresh)).otherwise(still).alias("open"),
            F.concat(state["done"], ended).alias("done"),
        )
        # Most of a page lies outside of all blocks.
        return F.when(t["is_result"] | (F.size(state["open"]) > 0), moved).otherwise(state)

    tokens = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1)), parsed)
    blocks = F.aggregate(
        tokens, start, step, lambda s: F.concat(s["done"], F.transform(s["open"], _entry))
    )
    return F.array_sort(blocks)


def _entry(o: Column) -> Column:
    return F.struct(o["i"].alias("i"), o["href"].alias("href"), o["label"].alias("label"))


def result_links(
    pages: DataFrame, key: str, html: str = "html", result_class: str = RESULT_CLASS, limit: int | None = None
) -> DataFrame:
    """(key, position, url, name) of the first link of each result block, in page order.

    `limit` keeps the first blocks of a page, with or without a link. A link without text is named by
    its address. Pages that never name the class are not scanned; null pages have no blocks.
    """
    named = pages.filter(F.contains(F.col(html), F.lit(result_class)))
    blocks = result_blocks(F.col(html), result_class)
    if limit is not None:
        blocks = F.filter(blocks, lambda b: b["i"] < limit)
    linked = F.filter(blocks, lambda b: F.coalesce(b["href"], F.lit("")) != "")
    links = named.select(F.col(key), F.posexplode(linked).alias("position", "_b"))
    name = F.regexp_replace("_b.label", EDGE, "")
    return links.select(
        key, "position", F.col("_b.href").alias("url"), F.when(name == "", F.col("_b.href")).otherwise(name).alias("name")
    )


def page_links(
    pages: DataFrame,
    key: str,
    html: str = "html",
    result_class: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(key, position, url, name) of a page's links, in page order.

    `result_class` keeps the first link of each block of that class (`result_links`); `limit`
    keeps the first ones of each page, as a search asks for.
    """
    if result_class is not None:
        return result_links(pages, key, html, result_class, limit)
    found = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1))
    if limit is not None:
        found = F.slice(found, 1, limit)
    links = pages.select(F.col(key), F.posexplode(found).alias("position", "anchor"))
    url = unescape(F.regexp_extract("anchor", HREF, 1))
    label = F.trim(unescape(F.regexp_replace("anchor", TAG, "")))
    return links.select(
        key, "position", url.alias("url"), F.when(label == "", url).otherwise(label).alias("name")
    )


def web_candidates(links: DataFrame) -> DataFrame:
    """Links as catalog candidates of the source `web`."""
    return links.select(
        F.col("url").alias("id"),
        "name",
        F.lit("web").alias("source"),
        F.lit("").alias("description"),
        "url",
        F.lit(0.5).alias("relevance_score"),
    )
