"""Table jobs over JSON documents and HTML pages."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.columns import quality, shorten, thousands
from marketlake.schemas import ITEM_DOC, QUOTE_DOC, SNAPSHOT_DOC


def snapshot_items(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Market snapshots: one row per item that has data, named by its envelope."""
    return (
        docs.select(F.from_json(column, SNAPSHOT_DOC).alias("doc"))
        # Outer, as a plain explode would test the map for entries first, and for
        # that parse the text once more. Its empty rows have no data either.
        .select(F.col("doc.worldName").alias("world_name"), F.explode_outer("doc.items"))
        .where(F.col("value.hasData"))
        .select(
            "world_name",
            F.col("key").try_cast("int").alias("item_id"),
            F.col("value.listingsCount").alias("listings_count"),
            F.col("value.averagePrice").alias("average_price"),
            F.col("value.regularSaleVelocity").alias("sale_velocity"),
        )
    )


def live_quotes(
    docs: DataFrame,
    listings: int = 5,
    sales: int = 3,
    column: str = "doc",
    currency: str = "gil",
) -> DataFrame:
    """First listings and sales of a quote document, with a text report.

    ``docs`` holds (item_name, world, doc). Absent numbers count as 0 and an
    absent flag as normal quality.
    """

    def number(field: Column) -> Column:
        return F.coalesce(field, F.lit(0))

    def head(array: Column, n: int) -> Column:
        return F.slice(F.coalesce(array, F.array()), 1, n)

    doc = F.from_json(column, QUOTE_DOC)
    quoted = docs.withColumn("_doc", doc).select(
        "item_name",
        "world",
        F.transform(
            head(F.col("_doc.listings"), listings),
            lambda x: F.struct(
                quality(x["hq"]).alias("quality"),
                number(x["quantity"]).alias("quantity"),
                number(x["pricePerUnit"]).alias("price_per_unit"),
                number(x["total"]).alias("total"),
            ),
        ).alias("listings"),
        F.transform(
            head(F.col("_doc.recentHistory"), sales),
            lambda x: F.struct(
                quality(x["hq"]).alias("quality"),
                number(x["quantity"]).alias("quantity"),
                number(x["pricePerUnit"]).alias("price_per_unit"),
            ),
        ).alias("recent_sales"),
    )

    # The wording of the report.
    listing_lines = F.transform(
        "listings",
        lambda x: F.concat(
            F.lit("  "), x["quality"], F.lit(" x"), x["quantity"].cast("string"),
            F.lit(" @ "), thousands(x["price_per_unit"]),
            F.lit(f" {currency} (total: "), thousands(x["total"]), F.lit(f" {currency})"),
        ),
    )
    sale_lines = F.transform(
        "recent_sales",
        lambda x: F.concat(
            F.lit("  "), x["quality"], F.lit(" x"), x["quantity"].cast("string"),
            F.lit(" sold @ "), thousands(x["price_per_unit"]), F.lit(f" {currency}"),
        ),
    )
    subject = F.concat("item_name", F.lit(" on "), "world")
    full = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("Live listings for "), subject, F.lit(":"))),
            listing_lines,
            F.when(
                F.size("recent_sales") > 0, F.concat(F.array(F.lit("Recent sales:")), sale_lines)
            ).otherwise(F.array().cast("array<string>")),
        ),
        "\n",
    )
    none = F.concat(F.lit("No current listings for "), subject, F.lit("."))
    return quoted.withColumn("report", F.when(F.size("listings") > 0, full).otherwise(none))


def item_details(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Details of an item document, with a text report.

    ``docs`` holds (item_id, item_name, doc). Fields sit under ``fields`` or at
    the top; the category is an object with a name, or a bare value.
    """
    docs = docs.withColumn("_doc", F.from_json(column, ITEM_DOC))

    def field(name: str) -> Column:
        return F.when(F.col("_doc.fields").isNotNull(), F.col(f"_doc.fields.{name}")).otherwise(
            F.col(f"_doc.{name}")
        )

    category = field("ItemUICategory")
    category_name = (
        F.when(category.isNull(), "Unknown")
        .when(
            category.startswith("{"),
            F.coalesce(F.get_json_object(category, "$.Name"), F.lit("Unknown")),
        )
        .otherwise(category)
    )
    flag = field("CanBeHq")
    details = docs.select(
        "item_id",
        "item_name",
        category_name.alias("category"),
        F.coalesce(field("LevelItem"), F.lit("?")).alias("item_level"),
        F.coalesce(field("LevelEquip"), F.lit("?")).alias("equip_level"),
        # Any value but the empty ones counts as true.
        F.coalesce(~flag.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False)).alias(
            "can_be_hq"
        ),
        F.coalesce(field("Description"), F.lit("No description available.")).alias("description"),
    )
    # The wording of the report.
    report = F.concat_ws(
        "\n",
        F.concat("item_name", F.lit(" (ID: "), F.col("item_id").cast("string"), F.lit(")")),
        F.concat(F.lit("  Category: "), "category"),
        F.concat(F.lit("  Item Level: "), "item_level"),
        F.concat(F.lit("  Equip Level: "), "equip_level"),
        F.concat(F.lit("  Can be HQ: "), F.when(F.col("can_be_hq"), "Yes").otherwise("No")),
        F.concat(F.lit("  Description: "), shorten(F.col("description"))),
    )
    return details.withColumn("report", report)


# Where a news page keeps its entries, their titles and dates. A
# selector is a tag name, or a class name after a dot.
ENTRY = ".news__list--link"
LIST = ".news__list"
TITLES = (".news__list--title", "p")
DATES = ("time", ".news__list--time")

# Elements without content, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})


def page_headlines(
    pages: DataFrame, n: int = 8, lists: str | None = LIST, titles: tuple[str, ...] = TITLES
) -> DataFrame:
    """(page_id, position, title, date) of the first ``n`` entries of each page.

    Entries are the list items with a class of their own, or else those anywhere
    inside a list region (on the page if ``lists`` is None), nested ones included.
    Pages without any give no rows; ``headline_report`` names them.
    """
    return (
        _headlines(pages, n, lists, titles)
        .select("page_id", F.posexplode("headlines").alias("pos", "h"))
        .select("page_id", (F.col("pos") + 1).alias("position"), "h.title", "h.date")
    )


def headline_report(
    pages: DataFrame,
    n: int = 8,
    lists: str | None = LIST,
    titles: tuple[str, ...] = TITLES,
    heading: str = "Latest news:",
) -> DataFrame:
    """(page_id, report): the headlines as text, or a note that none were found."""

    def line(h: Column) -> Column:
        date = F.when(h["date"] != "", F.concat(F.lit(" ("), h["date"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("  - "), h["title"], date)

    lines = F.array_join(F.transform("headlines", line), "\n")
    report = F.concat(F.lit(f"{heading}\n"), lines)
    none = F.lit("Could not parse the news page. The page structure may have changed.")
    return _headlines(pages, n, lists, titles).select(
        "page_id", F.when(F.size("headlines") > 0, report).otherwise(none).alias("report")
    )


def _headlines(
    pages: DataFrame, n: int, lists: str | None, titles: tuple[str, ...]
) -> DataFrame:
    """(page_id, headlines): an array of (title, date) per page; empty for NULL."""

    # Patterns cannot follow nested elements, hence a parser; pages go to it in Arrow batches.
    @F.pandas_udf("array<struct<title: string, date: string>>")
    def read(html: pd.Series) -> pd.Series:
        return html.map(lambda page: _News(page or "", n, lists, titles).headlines())

    return pages.select("page_id", read("html").alias("headlines"))


class _News(HTMLParser):
    """The first ``n`` entries of one page, read in one pass.

    An end tag closes the nearest open element of its name and all inside it; one
    without a start is ignored.
    """

    def __init__(self, page: str, n: int, lists: str | None, titles: tuple[str, ...]):
        super().__init__()
        self.n, self.lists, self.titles = n, lists, titles
        self.own, self.listed = [], []
        #: open elements as (tag, inside a list region), and how many there are of each tag
        self.open, self.count = [], Counter()
        #: what the open elements began, as (depth, entry) and (depth, text): few, as entries are
        self.entries, self.texts = [], []
        self.text = []
        self.feed(page)
        self.close()
        self._flush()

    def handle_starttag(self, tag, attrs):
        self._flush()
        names = {tag, *(f".{c}" for c in (dict(attrs).get("class") or "").split())}
        around = bool(self.open) and self.open[-1][1]
        if tag in VOID:
            return
        depth = len(self.open)
        for _, entry in self.entries:
            for selector in names.intersection(self.titles + DATES) - entry.keys():
                entry[selector] = []
                self.texts.append((depth, entry[selector]))
        if tag == "li":
            kinds = [self.own] * (ENTRY in names) + [self.listed] * (around or self.lists is None)
            wanting = [kind for kind in kinds if len(kind) < self.n]
            if wanting:
                self.entries.append((depth, {}))
            for kind in wanting:
                kind.append(self.entries[-1][1])
        self.open.append((tag, around or self.lists in names))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self.count[tag]:
            return
        closed = None
        while closed != tag:
            closed = self.open.pop()[0]
            self.count[closed] -= 1
        for begun in (self.entries, self.texts):
            while begun and begun[-1][0] >= len(self.open):
                begun.pop()

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._flush()

    def _flush(self):
        piece = "".join(self.text).strip()
        self.text.clear()
        if piece and not (self.open and self.open[-1][0] in HIDDEN):
            for _, text in self.texts:
                text.append(piece)

    def headlines(self) -> list[dict[str, str]]:
        def first(entry: dict, selectors: tuple[str, ...], missing: str) -> str:
            return next(("".join(entry[s]) for s in selectors if s in entry), missing)

        return [
            {"title": first(e, self.titles, "Unknown"), "date": first(e, DATES, "")}
            for e in self.own or self.listed
        ]
