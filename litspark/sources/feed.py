"""Atom feeds as a source: paging, parsing, normalising, filtering."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.text import DAY_END, DAY_START, FEED_DATES, FEED_WORDS, collapse, in_dates, links, paper_id

API = "https://export.arxiv.org/api/query"

_TEXT = T.StringType()
ENTRY = T.StructType([
    T.StructField("id", _TEXT), T.StructField("title", _TEXT), T.StructField("summary", _TEXT),
    T.StructField("published", _TEXT), T.StructField("updated", _TEXT),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", _TEXT)]))),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", _TEXT)]))),
])
FEED = T.StructType([T.StructField("entry", T.ArrayType(ENTRY))])


def query_string(keyword: str, date_from: str | None = None, date_to: str | None = None) -> str:
    """Search string of the feed; a date in another form than YYYY-MM-DD raises ValueError."""
    quoted = FEED_WORDS.format(keyword.replace('"', ""))
    if not (date_from and date_to):
        return quoted
    day = lambda d: datetime.strptime(d, "%Y-%m-%d").strftime("%Y%m%d")
    return quoted + FEED_DATES.format(day(date_from) + DAY_START, day(date_to) + DAY_END)


def normalised(entry: Column) -> list[Column]:
    """The columns of a paper from a parsed entry."""
    key = paper_id(collapse(entry.id))
    return [
        key.alias("arxiv_id"),
        collapse(entry.title).alias("title"),
        F.transform(F.coalesce(entry.author, F.array()), lambda a: collapse(a["name"])).alias("authors"),
        collapse(entry.summary).alias("abstract"),
        collapse(entry.published).alias("published"),
        collapse(entry.updated).alias("updated"),
        F.filter(F.transform(F.coalesce(entry.category, F.array()), lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != "").alias("categories"),
        *links(key),
    ]


def parse_entries(df: DataFrame, xml: str) -> DataFrame:
    """A paper per row of single <entry> elements; absent elements give empty strings. Other columns stay."""
    parsed = df.withColumn("_e", F.from_xml(F.col(xml), ENTRY, {"rowTag": "entry"}))
    rest = [c for c in df.columns if c != xml]
    return parsed.select(*rest, *normalised(F.col("_e")))


def parse_pages(df: DataFrame, xml: str) -> DataFrame:
    """A paper per entry of feed pages, in the order of page and entry."""
    parsed = df.withColumn("_f", F.from_xml(F.col(xml), FEED, {"rowTag": "feed"}))
    rest = [c for c in df.columns if c != xml]
    return parsed.select(*rest, F.posexplode("_f.entry").alias("place", "_e")).select(*rest, "place", *normalised(F.col("_e")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Papers of feed files, split at their entries, so that a file may be large."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    return raw.select(*normalised(F.struct(*[F.col(c) for c in ENTRY.names])))


def http_get(user_agent: str, timeout: int = 60) -> Callable[[str], str]:
    def get(url: str) -> str:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode("utf-8")

    return get


class FeedClient:
    """Pages of a search, one request at a time with a pause between them."""

    def __init__(self, get: Callable[[str], str], pause: float = 3.0, clock=time.monotonic, sleep=time.sleep) -> None:  # noqa: ANN001
        self.get, self.pause, self.clock, self.sleep, self.last = get, pause, clock, sleep, None

    def pages(self, keyword: str, date_from: str | None, date_to: str | None, most: int = 100, page: int = 100) -> Iterator[tuple[int, str]]:
        """(start, xml): until enough entries came, or a page came short."""
        start = 0
        while start < most:
            want = min(page, most - start)
            if self.last is not None:
                self.sleep(max(0.0, self.pause - (self.clock() - self.last)))
            self.last = self.clock()
            query = {"search_query": query_string(keyword, date_from, date_to), "start": start, "max_results": want, "sortBy": "submittedDate", "sortOrder": "descending"}
            xml = self.get(f"{API}?{urllib.parse.urlencode(query)}")
            got = xml.count("<entry")
            if got:
                yield start, xml
            if got < want:
                return
            start += got

    def search(self, spark: SparkSession, keyword: str, date_from: str | None, date_to: str | None, most: int = 100, page: int = 100) -> DataFrame:
        """Papers with their rank from 1, within the dates, at most so many."""
        rows = list(self.pages(keyword, date_from, date_to, most, page))
        papers = parse_pages(spark.createDataFrame(rows, "start long, xml string"), "xml")
        kept = papers.where(in_dates(F.col("published"), date_from, date_to))
        return ranked(kept, "start", "place").where(F.col("rank") <= most).drop("start", "place")


def ranked(papers: DataFrame, *order: str | Column) -> DataFrame:
    """Rank from 1 in the given order, of the papers of one search; the search's limit bounds them."""
    return papers.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
