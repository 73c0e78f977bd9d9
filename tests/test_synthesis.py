import pytest
from pyspark.sql import functions as F

from litspark import catalogue
from litspark.operators import synthesis as S


def tables(spark, n):
    links = spark.createDataFrame([(1, f"p{i:04d}", None if i % 7 == 0 else i % 5) for i in range(n)], "collection_id long, paper_id string, rank int")
    papers = spark.createDataFrame([(f"p{i:04d}", f"t{i}", None if i % 11 == 0 else f"{2000 + i % 9}-01-{1 + i % 28:02d}") for i in range(n)], "arxiv_id string, title string, published string")
    memory = spark.createDataFrame([(f"p{i:04d}", "s" * 50) for i in range(n)], "paper_id string, summary string")
    evidence = spark.createDataFrame([(k * 40_000, f"p{k % n:04d}", f"c{k}", None) for k in range(2 * n)], "id long, paper_id string, claim string, result string")
    return links, papers, memory, evidence


def test_texts_above_the_bound_of_a_context_are_whole(spark):
    n = 600
    links, papers, memory, evidence = tables(spark, n)
    got = S.whole_summaries(links, papers, memory).first()
    rank, date = (lambda i: (0, 0) if i % 7 == 0 else (1, i % 5)), (lambda i: "" if i % 11 == 0 else f"{2000 + i % 9}-01-{1 + i % 28:02d}")
    order = sorted(sorted(sorted(range(n)), key=date, reverse=True), key=rank)
    want = "\n\n".join(f"[arXiv:p{i:04d}] t{i}\n" + "s" * 50 for i in order)
    assert (got["n"], got["chars"], got["text"]) == (n, len(want), want) and len(want) > 20_800
    got = S.whole_evidence_texts(links, papers, evidence).first()
    want = "\n".join(f"[arXiv:p{k % n:04d}] c{k} :: " for k in range(2 * n))
    assert (got["n"], got["text"]) == (2 * n, want) and len(want) > 20_800


@pytest.mark.parametrize("name", ["synthesis_summaries", "synthesis_evidence_text"])
def test_every_collection_has_a_text(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.1")
    assert df.count() == 64 and df.where("text IS NULL").isEmpty() and df.agg(F.max("chars")).first()[0] > 20_800
