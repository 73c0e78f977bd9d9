"""Text functions as Columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks in the sense of Unicode text processing, separators \x1c to \x1f included.
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TERM = r"[A-Za-zА-Яа-я0-9_-]{3,}"

# Head, marker and tail of pruned text.
PRUNE_AT, PRUNE_HEAD, PRUNE_TAIL = 6000, 3500, 1500
PRUNE_MARK = ("\n\n[... ", " characters omitted from working context; canonical artifact retained ...]\n\n")
# Heading terms that make a section important.
IMPORTANT_HEADINGS = (
    "abstract", "introduction", "method", "methodology", "approach", "experiment",
    "result", "evaluation", "discussion", "conclusion", "limitation", "ablation",
)
# Form of the feed's search string, and what follows the days of a range.
FEED_WORDS, FEED_DATES, DAY_START, DAY_END = 'all:"{}"', " AND submittedDate:[{} TO {}]", "0000", "2359"
#: Shortest section that is kept.
SECTION_LEAST = 120


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends; null as an empty string."""
    return F.trim(F.regexp_replace(or_empty(c), f"{BLANKS}+", " "))


def clean(c: Column) -> Column:
    """Page text without logo macros and runs of empty lines."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\\uselogo"), F.lit("")), "\n{3,}", "\n\n"))


def safe_id(c: Column) -> Column:
    """An id as a path segment."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def terms(question: Column) -> Column:
    """Lower-case search terms of a question in order, repeated ones included."""
    return F.transform(F.regexp_extract_all(or_empty(question), F.lit(TERM), F.lit(0)), F.lower)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def haystack(*parts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[or_empty(p) for p in parts]))


def score(text: Column, words: Sequence[str]) -> Column:
    """Summed occurrences of terms in a text that is in lower case.

    The text is bound to a variable: in a filter its expression would be evaluated once for each term.
    """
    if not words:
        return F.lit(0).cast("long")

    def total(x: Column) -> Column:
        found = occurrences(x, F.lit(words[0]))
        for w in words[1:]:
            found = found + occurrences(x, F.lit(w))
        return found

    return F.get(F.transform(F.array(text), total), F.lit(0))


def tokens(c: Column) -> Column:
    """Estimated model tokens: characters by 3.2, at least one."""
    return F.greatest(F.lit(1), (F.length(c) / F.lit(3.2)).cast("int"))


def clamp(c: Column, default: float = 0.5) -> Column:
    """A confidence in [0, 1]; what is no number counts as the default."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def prune(c: Column, most: int = PRUNE_AT, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL) -> Column:
    """Long text as its head, a note of what is left out, and its tail."""
    left_out = (F.length(c) - head - tail).cast("string")
    short = F.concat(F.substring(c, 1, head), F.lit(PRUNE_MARK[0]), left_out, F.lit(PRUNE_MARK[1]), F.right(c, F.lit(tail)))
    return F.when(F.length(c) <= most, c).otherwise(short)


def section_score(heading: Column, first: Column) -> Column:
    """Ten for each important term in a heading, two for the first section."""
    h = F.lower(or_empty(heading))
    total = F.when(first, 2).otherwise(0)
    for term in IMPORTANT_HEADINGS:
        total = total + F.when(h.contains(term), 10).otherwise(0)
    return total


def compact_date(c: Column, end: bool = False) -> Column:
    return F.concat(F.date_format(F.to_date(c, "yyyy-MM-dd"), "yyyyMMdd"), F.lit(DAY_END if end else DAY_START))


def feed_query(keyword: Column, date_from: Column, date_to: Column) -> Column:
    """Search string of the feed; dates count only where both are given."""
    form = lambda x, *c: F.format_string(x.replace("{}", "%s"), *c)
    words = form(FEED_WORDS, F.replace(keyword, F.lit('"'), F.lit("")))
    given = (or_empty(date_from) != "") & (or_empty(date_to) != "")
    dates = form(FEED_DATES, compact_date(date_from), compact_date(date_to, True))
    return F.when(given, F.concat(words, dates)).otherwise(words)


def paper_id(link: Column) -> Column:
    """The id in a link: its last segment, without the version of new-style ids."""
    last = F.element_at(F.split(F.regexp_replace(link, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"^(\d{4}\.\d+)v\d+$", "$1")


def links(arxiv_id: Column, host: str = "https://arxiv.org") -> list[Column]:
    return [F.concat(F.lit(f"{host}/{kind}/"), arxiv_id).alias(f"{kind}_url") for kind in ("abs", "pdf", "html")]


def in_dates(published: Column, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Whether a day lies between inclusive bounds, as strings; a missing one passes an upper bound only."""
    day = F.substring(or_empty(published), 1, 10)
    keep = F.lit(True)
    if date_from:
        keep = keep & (day >= date_from)
    if date_to:
        keep = keep & (day <= date_to)
    return keep
