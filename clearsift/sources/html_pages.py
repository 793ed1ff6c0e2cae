"""HTML pages as tables: links of a listing page, records of article pages, blocks of text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from clearsift.functions.dates_numbers import parse_date

_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("pos", T.IntegerType())])
_RECORD = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("date", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("narrative", T.StringType())]
)
_RECORD_ARROW = pa.struct([("title", pa.string()), ("date", pa.string()), ("blocks", pa.list_(pa.string())), ("narrative", pa.string())])


@udtf(returnType=_LINK)
class PageLinks:
    """The links of a page, each address once, at its first place."""

    def eval(self, html: str):
        from html.parser import HTMLParser

        found: list[str] = []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag == "a":
                    found.extend(v or "" for k, v in attrs if k == "href")

        reader = Reader()
        reader.feed(html or "")
        reader.close()
        first: dict[str, int] = {}
        for i, href in enumerate(found):
            first.setdefault(href, i)
        for href, i in first.items():
            yield href, i


#: How a listing page's cards are marked, what an article's address and a card's date look like, and the
#: mark of a link to an archive.
CARD_CLASS, ARTICLE_ADDRESS, CARD_DATE = "news-card-h-alt", re.compile(r"/articles/\d+-"), re.compile(r"^\d{2}/\d{2}/\d{4}$")
_ARCHIVE = re.compile(r"\[\s*arsip[^\]]*\]", re.IGNORECASE)
_CARD = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("date", T.StringType()), T.StructField("title", T.StringType())])


@udtf(returnType=_CARD)
class ListingRows:
    """The articles of a listing page in its order, each address once: place, address, date as written, title."""

    def eval(self, html: str):
        from html.parser import HTMLParser

        cards: list[dict] = []

        class Reader(HTMLParser):
            depth, in_span = 0, False

            def handle_starttag(self, tag, attrs):
                a = dict(attrs)
                if tag == "div":
                    if self.depth:
                        self.depth += 1
                    elif CARD_CLASS in (a.get("class") or "").split():
                        self.depth = 1
                        cards.append({"href": None, "date": None, "title": None})
                if not self.depth:
                    return
                card = cards[-1]
                if tag == "a" and card["href"] is None and ARTICLE_ADDRESS.search(a.get("href") or ""):
                    card["href"] = a["href"]
                if tag == "img" and card["title"] is None:
                    card["title"] = a.get("alt") or ""
                self.in_span = tag == "span"

            def handle_endtag(self, tag):
                self.in_span = False
                if tag == "div" and self.depth:
                    self.depth -= 1

            def handle_data(self, data):
                if self.depth and self.in_span and cards[-1]["date"] is None and CARD_DATE.match(data.strip()):
                    cards[-1]["date"] = data.strip()

        reader = Reader()
        reader.feed(html or "")
        reader.close()
        seen: set[str] = set()
        for card in cards:
            if card["href"] and card["href"] not in seen:
                seen.add(card["href"])
                yield len(seen) - 1, card["href"], card["date"], card["title"] or ""


def listing_rows(pages: DataFrame, site: str) -> DataFrame:
    """(url, date, title, pos) of listing pages (html): whole addresses, dates as dates."""
    register_table_functions(pages.sparkSession)
    rows = pages.sparkSession.sql("SELECT l.* FROM {pages} p, LATERAL listing_rows(p.html) l", pages=pages)
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(site), F.col("href")))
    return rows.select(url.alias("url"), parse_date(F.col("date")).alias("date"), "title", "pos")


def _read_article(html: str | None) -> dict:
    """Title (h1), date (time), blocks (leaf p, blockquote, li inside the article) and sections by heading."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.title, self.date, self.blocks, self.sections = "", None, [], {}
            self.inside, self.kind, self.parts, self.heading, self.seen_article = 0, None, [], "", False

        def _close(self):
            text = " ".join("".join(self.parts).split())
            if self.kind == "h1" and text and not self.title:
                self.title = text
            elif self.kind in ("h2", "h3", "h4") and text:
                self.heading = text.lower().strip(" :[]=")
            elif self.kind in ("p", "blockquote", "li") and text and self.inside:
                text = _ARCHIVE.sub("", text).strip()
                if not text:
                    self.kind, self.parts = None, []
                    return
                self.blocks.append(text)
                self.sections[self.heading] = f"{self.sections.get(self.heading, '')} {text}".strip()
            self.kind, self.parts = None, []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
                self.seen_article = True
            if tag == "time" and self.date is None:
                self.date = dict(attrs).get("datetime")
            if tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "li", "div", "section", "article"):
                self._close()
                self.kind = tag

        def handle_endtag(self, tag):
            if tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "li", "div", "section", "article"):
                self._close()
            if tag == "article" and self.inside:
                self.inside -= 1

        def handle_data(self, data):
            self.parts.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    if not reader.title or not reader.seen_article:
        return {"title": None, "date": None, "blocks": None, "narrative": None}
    narrative = next((v for k, v in reader.sections.items() if k in ("narasi", "narrative")), None)
    return {"title": reader.title, "date": reader.date, "blocks": reader.blocks, "narrative": narrative}


#: Pages whose records are handed on at once.
PAGES_AT_ONCE = 128


@F.arrow_udf(_RECORD)
def article_record(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The record of an article page; all null without a heading or an article. Of a batch, however many rows it has, a few
    pages and their records are Python objects at a time."""
    for batch in html:
        for at in range(0, len(batch), PAGES_AT_ONCE):
            yield pa.array([_read_article(x.as_py()) for x in batch.slice(at, PAGES_AT_ONCE)], _RECORD_ARROW)


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("listing_rows", ListingRows)
