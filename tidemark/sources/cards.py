"""Readers of shops that show cards in pages, and of those that list codes first and products after.

A page is scanned once, tag by tag, with a stack of what is open; a card is an element of a class or a tag, and comes
as its texts, each with the classes and item names it stands under, and its links. What a shop calls a price or a name
is then an expression over these.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.title import canonical_title
from .listings import reject_reason

CARD = "struct<place: int, closed: boolean, links: array<string>, texts: array<struct<under: string, text: string>>>"
# Fixed values of HTML: elements without an end, those whose text is no markup, and those that end where another of
# their kind begins.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
IMPLIED = frozenset(("p", "li", "tr", "td", "th", "option", "dt", "dd"))
SCOPES = frozenset(("ul", "ol", "table", "select", "dl", "div", "article", "section", "body"))
# Fixed values of one shop's feed: what it calls available, its codes of bare drives, of enclosures, and their names.
AVAILABLE = ("instock", "lowstock")
BARE, ENCLOSURE = r"^R(WD\d{2,4}[A-Z]{4})$", r"^R?WDB[A-Z]"
ENCLOSURE_TITLE = r"\b(?:my book|my passport|elements)\b"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!.*?>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-a-zA-Z0-9]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def scan(page: str, tag: str | None, wanted: str | None, decoded: bool = True) -> list[tuple]:
    """(place, closed, links, texts) of the cards of a page, in the order in which they begin. Unless ``decoded``, texts
    and attributes are as the page writes them, entities and all."""
    plain = html.unescape if decoded else str
    stack: list[tuple[str, str, dict | None]] = []  # tag, what texts stand under, the card that it is
    cards: list[dict] = []
    raw = None

    def close(depth: int, own: bool) -> None:
        while len(stack) > depth:
            *_, card = stack.pop()
            if card is not None:
                card["closed"] = own and len(stack) == depth

    for m in _TOKEN.finditer(page):
        ends, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if raw is not None:
            raw = None if name == raw and ends else raw
            if raw is None:
                close(max(i for i, x in enumerate(stack) if x[0] == name), True)
            continue
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                text = plain(m[0])
                for i, (_, _, card) in enumerate(stack):
                    if card is not None:
                        card["texts"].append((" ".join(u for _, u, _ in stack[i + 1 :] if u), text))
            continue
        if ends:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                close(at, True)
            continue
        if name in IMPLIED:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in SCOPES), None)
            if at is not None and stack[at][0] == name:
                close(at, False)
        said = {a.lower(): plain(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)}
        classes = said.get("class", "").split()
        if said.get("href"):
            for _, _, card in stack:
                if card is not None:
                    card["links"].append(said["href"])
        if name in VOID or attributes.endswith("/"):
            continue
        card = None
        if (tag is None or name == tag) and (wanted is None or wanted in classes):
            card = {"closed": False, "links": [], "texts": []}
            cards.append(card)
        stack.append((name, " ".join([name, *(f".{c}" for c in classes), *([f"@{said['itemprop']}"] if said.get("itemprop") else [])]), card))
        raw = name if name in RAW else None
    return [(i, c["closed"], c["links"], c["texts"]) for i, c in enumerate(cards)]


def cards_of(page: Column, tag: str | None = None, wanted: str | None = None, decoded: bool = True) -> Column:
    """array<CARD> of a page: its elements of a tag, a class, or both. A card that the page leaves open, or whose end
    another element forces, isn't ``closed``. A null page has none. ``decoded``: whether entities are read."""

    @F.pandas_udf(f"array<{CARD}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("place", "closed", "links", "texts")
        for batch in batches:
            yield pd.Series([[dict(zip(names, (*c[:3], [{"under": u, "text": t} for u, t in c[3]]), strict=True)) for c in scan(p, tag, wanted, decoded)] if p is not None else [] for p in batch], dtype=object)

    return found(page)


def text_under(card: Column, part: str) -> Column:
    """All text of a card below an element (``p``), a class (``.price``) or an item name (``@name``), as it stands."""
    hit = F.filter(card["texts"], lambda t: F.array_contains(F.split(t["under"], " "), part))
    return F.array_join(F.transform(hit, lambda t: t["text"]), "")


def first_text(card: Column, part: str) -> Column:
    """The first text below it that isn't blank, trimmed."""
    hit = F.filter(card["texts"], lambda t: F.array_contains(F.split(t["under"], " "), part) & (F.trim(t["text"]) != ""))
    return F.trim(F.get(hit, F.lit(0))["text"])


def shop_cards(pages: DataFrame, page: str = "html", wanted: str = "v-product", price: str = ".product_productprice", link: str = "-p/") -> DataFrame:
    """Listings of a shop's category pages, one a card with a product link: key, href, title, price, and ``reject`` (no
    readable price). The title is the item's name, else the first text of a link."""
    rest = [c for c in pages.columns if c != page]
    rows = pages.select(*rest, F.explode(cards_of(F.col(page), wanted=wanted)).alias("c"))
    href = F.get(F.filter(F.col("c.links"), lambda x: F.contains(x, F.lit(link))), F.lit(0))
    digits = F.regexp_replace(text_under(F.col("c"), price), "[^0-9.]", "")
    rows = rows.withColumn("href", href).where(F.col("href").isNotNull())
    key = F.regexp_extract("href", rf"{re.escape(link)}([^/]+)\.htm", 1)
    return rows.select(
        *rest,
        F.col("c.place").alias("place"),
        F.col("c.closed").alias("closed"),
        F.when(key != "", key).otherwise(F.col("href")).alias("source_listing_key"),
        "href",
        F.coalesce(first_text(F.col("c"), "@name"), first_text(F.col("c"), "a"), F.lit("")).alias("title"),
        digits.try_cast("decimal(10,2)").alias("price"),
    ).withColumn("reject", reject_reason({"no_price": F.col("price").isNull()}))


def searched_codes(searches: DataFrame, ending: str, body: str = "body") -> DataFrame:
    """(code): product codes that any search page lists, each once, of those that end in ``ending``."""
    said = F.from_json(F.col(body), "struct<products: array<struct<code: string>>>")
    return searches.select(F.explode(said["products"]["code"]).alias("code")).where(F.endswith("code", F.lit(ending))).distinct()


def product_options(products: DataFrame, codes: DataFrame, body: str = "body") -> DataFrame:
    """Listings of the products that a search has found, one a variant: key, title, price, stock_status, mpn, and
    ``reject`` for what can't be one: no list of variants, no record, no key, no price.

    ``products``: code and the product's ``body``; a code is met once. The maker's number is read from codes of bare
    drives only: an enclosure's drive is nobody's word.
    """
    rest = [c for c in products.columns if c != body]
    rows = products.join(codes, "code", "left_semi").withColumn("_options", F.get_json_object(body, "$.variantOptions")).where(F.col("_options").isNotNull())
    listed = F.startswith(F.trim("_options"), F.lit("["))
    each = F.when(listed, F.from_json("_options", "array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.withColumn("title", F.coalesce(F.get_json_object(body, "$.name"), F.lit(""))).select(*rest, "title", listed.alias("_listed"), F.posexplode(each).alias("variant_no", "_v"))
    v = F.from_json("_v", "struct<code: string, saleable: boolean, priceData: struct<value: string>, stock: struct<stockLevelStatus: string>>")
    rows = rows.withColumn("_o", F.when(F.startswith(F.ltrim("_v"), F.lit("{")), v)).withColumn("_t", canonical_title(F.col("title")))
    key = F.col("_o.code")
    bare = F.nullif(F.regexp_extract(key, BARE, 1), F.lit(""))
    stock = F.when(F.coalesce("_o.saleable", F.lit(False)) & F.lower("_o.stock.stockLevelStatus").isin(*AVAILABLE), "in_stock").otherwise("out_of_stock")
    price = F.col("_o.priceData.value").try_cast("decimal(10,2)")
    checks = {"variants": ~F.col("_listed"), "record": F.col("_o").isNull(), "no_key": key.isNull(), "no_price": price.isNull()}
    rows = rows.withColumn("reject", reject_reason(checks))
    fine = F.col("reject").isNull()
    return rows.select(*rest, "variant_no", key.alias("source_listing_key"), "title", price.alias("price"), F.when(fine, stock).alias("stock_status"), F.when(~key.rlike(ENCLOSURE) & ~F.col("_t").rlike(ENCLOSURE_TITLE), bare).alias("mpn"), "reject")
