import pytest
from pyspark.sql import functions as F

from litspark.sources import feed, html, replies

ENTRY = (
    "<entry><id>http://arxiv.org/abs/{id}</id><updated>2026-08-20T00:00:00Z</updated><published>{day}T00:00:00Z</published>"
    "<title>Agent\n  Memory Test</title><summary>A paper &amp; more.</summary><author><name>Alice</name></author><author><name> Bob </name></author>"
    '<category term="cs.AI"/><category term=""/></entry>'
)


def page(*entries):
    return '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entries) + "</feed>"


def test_feed_entry(spark):
    xml = page(ENTRY.format(id="2608.12345v1", day="2026-08-20"), "<entry><id>x/hep-th/9901001v1</id></entry>")
    got = feed.parse_pages(spark.createDataFrame([(xml,)], "xml string"), "xml").collect()
    a, b = got
    assert (a["arxiv_id"], a["title"], a["authors"], a["abstract"], a["categories"]) == ("2608.12345", "Agent Memory Test", ["Alice", "Bob"], "A paper & more.", ["cs.AI"])
    assert a["html_url"] == "https://arxiv.org/html/2608.12345"
    assert (b["arxiv_id"], b["title"], b["authors"], b["published"], b["categories"]) == ("9901001v1", "", [], "", [])


def test_query_string():
    assert feed.query_string('a "b"', "2026-01-01", "2026-02-01") == 'all:"a b" AND submittedDate:[202601010000 TO 202602012359]'
    assert feed.query_string("a", None, "2026-02-01") == 'all:"a"'
    with pytest.raises(ValueError):
        feed.query_string("a", "01.02.2026", "2026-02-01")


def test_paging_filters_and_waits(spark):
    pages = [page(*[ENTRY.format(id=f"2608.{i:05d}v1", day=f"2026-08-{20 - i:02d}") for i in range(k, k + n)]) for k, n in ((0, 2), (2, 2), (4, 1))]
    urls, slept, now = [], [], [0.0]
    client = feed.FeedClient(lambda u: urls.append(u) or pages[len(urls) - 1], 3.0, lambda: now[0], slept.append)
    got = client.search(spark, "agents", "2026-08-17", "2026-08-19", most=10, page=2).orderBy("rank").collect()
    assert [(r["rank"], r["published"][:10]) for r in got] == [(1, "2026-08-19"), (2, "2026-08-18"), (3, "2026-08-17")]
    assert len(urls) == 3 and "start=4" in urls[2] and slept == [3.0, 3.0]


PAGE = """<html><head><title>Tab</title><script>var a;</script></head><body><main><h1>Outer</h1><article>
<h1 class="ltx_title ltx_title_document"> The  Title </h1>
<section class="ltx_section"><h2>1 Intro</h2><p>{long} first</p><section class="ltx_subsection"><h3>1.1</h3><p>nested</p></section></section>
<section class="ltx_section"><h2>Short</h2><p>too short</p></section>
<section class="ltx_appendix"><h2>Appendix</h2><p>{long}</p></section></article></main></body></html>"""


def test_page():
    long = "word " * 40
    title, text, sections = html.read_page(PAGE.format(long=long))
    assert title == "The Title"
    assert [(h, "nested" in t, lv) for h, t, lv in sections] == [("1 Intro", False, 2)]
    assert "nested" in text and "var a" not in text and "Outer" not in text


def test_page_without_marks():
    assert html.read_page(None) == ("", "", [])
    assert html.read_page("<title>Only</title><p>a<br>b</p>")[0] == "Only"
    kept = html.read_page("<main><section><h1>A</h1>" + "x" * 119 + "</section></main>")[2]
    assert len(kept) == 1 and html.read_page("<main><section>" + "x" * 119 + "</section></main>")[2] == []


REPLY = '{"summary": " s ", "datasets": ["d"], "evidence": [{"claim": "c", "confidence": "0.7"}, {"claim": ""}, {"claim": " ", "confidence": 1.7, "tags": ["t"]}, {"result": "r"}]}'


def read(spark, reply):
    return replies.parse(spark.createDataFrame([("k", reply)], "key string, reply string"), "reply")


def test_reply_within_prose(spark):
    x = read(spark, f"Here:\n{REPLY}\nDone")
    m = replies.memory(x, "key").first()
    assert (m["summary"], m["method"], m["datasets"], m["limitations"]) == ("s", "", ["d"], [])
    e = replies.evidence(x, "key").orderBy("place").collect()
    assert [(r["claim"], r["evidence_type"], r["confidence"], r["tags"]) for r in e] == [("c", "claim", 0.7, []), ("", "claim", 1.0, ["t"])]


def test_reply_without_json(spark):
    assert read(spark, "no {braces} here").first()["parsed"] is None
    with pytest.raises(Exception, match="no JSON"):
        replies.strict(read(spark, "nothing")).collect()


def test_loosely_typed_reply():
    got = replies.coerce('x {"summary": null, "datasets": "ab", "evidence": ["no", {"claim": 5, "confidence": "high", "tags": [1]}, {"claim": "n", "confidence": NaN}]}')
    assert got["summary"] == "None" and got["datasets"] == ["a", "b"]
    assert [(e["claim"], e["confidence"], e["tags"]) for e in got["evidence"]] == [("5", 0.5, ["1"]), ("n", 1.0, [])]
    assert replies.coerce("[1]") is None and replies.coerce("nothing") is None


def test_coerce_in_spark(spark):
    df = spark.createDataFrame([(REPLY,), ("none",)], "r string").coalesce(1)
    a, b = df.select(replies.coerce_udf(F.col("r")).alias("p")).collect()
    assert a["p"]["summary"] == "s" and len(a["p"]["evidence"]) == 2 and b["p"]["summary"] is None


def test_deeply_nested_pages():
    from litspark.sources.html import read_page

    title, text, sections = read_page("<article><h1>T</h1>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>")
    assert title == "T" and text.split() == ["T", "deep"] and sections == []


def test_both_forms_of_the_search_string_agree(spark):
    from pyspark.sql import functions as F

    from litspark.functions.text import feed_query
    from litspark.sources.feed import query_string

    rows = [('a "b" c', "2026-08-01", "2026-08-20"), ("x", None, "2026-08-20"), ("", "2026-01-31", "2026-02-01"), ("%s {}", None, None)]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    got = [r["q"] for r in df.select(feed_query(F.col("k"), F.col("a"), F.col("b")).alias("q")).collect()]
    assert got == [query_string(*r) for r in rows]
