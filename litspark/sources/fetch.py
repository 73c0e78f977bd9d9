"""Fetching the HTML pages of papers, in partitions, each with a pause between its requests."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where pages are, and answers that ask to stay away.
PAGE = "https://arxiv.org/html/{}"
BLOCKED = (403, 429)
FETCHED = "arxiv_id string, html string, url string, status int, error string"


@dataclass
class HttpPage:
    """(status, final address, text) of an address; answers that aren't a page raise."""

    user_agent: str
    timeout: int = 60

    def __call__(self, url: str) -> tuple[int, str, str]:
        request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            kind = answer.headers.get_content_charset() or "utf-8"
            return answer.status, answer.geturl(), answer.read().decode(kind, "replace")


@dataclass
class PageFetcher:
    """Pages of papers. `clients` partitions ask at the same time, each once in `pause` seconds.

    A paper without a page, or whose request fails, gets a null page with the reason. A client that is told
    to stay away doubles its pause, and after `patience` such answers in a row asks no more.
    """

    get: Callable[[str], tuple[int, str, str]]
    pause: float = 16.0
    clients: int = 1
    patience: int = 3
    page: str = PAGE
    sleep: Callable[[float], None] = field(default=time.sleep)

    def rows(self, ids: Iterator[str]) -> Iterator[tuple]:
        pause, refused, first = self.pause, 0, True
        for key in ids:
            if refused >= self.patience:
                yield key, None, None, None, "not asked: the server refuses requests"
                continue
            if not first:
                self.sleep(pause)
            first = False
            try:
                status, url, html = self.get(self.page.format(key))
                error = None if status < 400 else f"HTTP {status}"
            except urllib.error.HTTPError as e:
                status, url, html, error = e.code, None, None, f"HTTP {e.code}"
            except (OSError, ValueError) as e:
                status, url, html, error = None, None, None, str(e)[:300]
            refused = refused + 1 if status in BLOCKED else 0
            pause = pause * 2 if status in BLOCKED else self.pause
            yield key, html if error is None else None, url, status, error

    def fetch(self, papers: DataFrame) -> DataFrame:
        """(arxiv_id, html, url, status, error) of each different arxiv_id; a null one is left out."""
        names = [c.split()[0] for c in FETCHED.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in self.rows(key for b in batches for key in b["arxiv_id"]):
                yield pd.DataFrame([row], columns=names).astype({"status": "Int32"})

        ids = papers.where(F.col("arxiv_id").isNotNull()).select("arxiv_id").distinct()
        return ids.repartition(self.clients, "arxiv_id").mapInPandas(run, FETCHED)
