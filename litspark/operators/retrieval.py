"""Scoped lexical retrieval over papers, their memory and their evidence.

A record's score counts the question's terms in title, abstract, summary and claims. No term holds a blank
or a bar, so none can match across two claims: the counts are summed claim by claim, pre-aggregated before
the shuffle, and a paper with very many claims costs no more than its rows. Claims are put into one text
for the papers that are returned only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import TERM, haystack, occurrences, or_empty, score, strip, terms

#: Claims are joined in runs of so many consecutive ids first.
RUN = 1 << 16


def question_terms(question: str) -> list[str]:
    return [t.lower() for t in re.findall(TERM, question)]


def claim_texts(evidence: DataFrame, separator: str = " | ") -> DataFrame:
    """(paper_id, claims): all claims of a paper in order of their id, null where it has none.

    Runs of ids are joined first, so the order of a paper's very many claims isn't sorted out in one task.
    """
    runs = evidence.where("claim IS NOT NULL").groupBy("paper_id", F.floor(F.col("id") / RUN).alias("run"))
    parts = runs.agg(F.expr(f"listagg(claim, '{separator}') WITHIN GROUP (ORDER BY id)").alias("part"))
    return parts.groupBy("paper_id").agg(F.expr(f"listagg(part, '{separator}') WITHIN GROUP (ORDER BY run)").alias("claims"))


def in_collection(papers: DataFrame, links: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    ids = collections.where(F.col("name") == name).select(F.col("id").alias("collection_id"))
    members = links.join(F.broadcast(ids), "collection_id", "left_semi").select(F.col("paper_id").alias("arxiv_id"))  # one name, one row
    return papers.join(members, "arxiv_id", "left_semi")


def in_cell(papers: DataFrame, assignments: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    ids = cells.where(F.col("name") == name).select(F.col("id").alias("cell_id"))
    members = assignments.join(F.broadcast(ids), "cell_id", "left_semi").select(F.col("paper_id").alias("arxiv_id"))  # one name, one row
    return papers.join(members, "arxiv_id", "left_semi")


def scored(papers: DataFrame, memory: DataFrame, evidence: DataFrame, words: Sequence[str]) -> DataFrame:
    """(arxiv_id, title, abstract, summary, score) of all papers; score is 0 where no term occurs."""
    claims = evidence.select("paper_id", score(F.lower(or_empty("claim")), words).alias("s")).where("s > 0").groupBy("paper_id").agg(F.sum("s").alias("_claims"))
    own = papers.select("arxiv_id", "title", "abstract")
    with_memory = own.join(memory.select("paper_id", "summary"), own.arxiv_id == F.col("paper_id"), "left").drop("paper_id")
    return with_memory.join(claims, F.col("arxiv_id") == F.col("paper_id"), "left").select(
        "arxiv_id",
        "title",
        "abstract",
        "summary",
        (score(haystack("title", "abstract", "summary"), words) + F.coalesce("_claims", F.lit(0))).cast("long").alias("score"),
    )


def top(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """The best candidates that hold a term, ties by id; a limit of 0 gives none."""
    return candidates.where("score > 0").orderBy(F.desc("score"), F.asc("arxiv_id")).limit(limit)


def search(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """The best candidates; where none holds a term, those that have a summary, in order of their id.

    Candidates that hold a term come before all others, so the first `limit` rows of both kinds decide which
    kind is returned: the candidates are read once.
    """
    named = strip(or_empty("summary")) != ""
    first = candidates.where((F.col("score") > 0) | named).orderBy(F.desc("score"), F.asc("arxiv_id")).limit(limit)
    most = F.max("score").over(Window.partitionBy(F.lit(0)))  # over at most `limit` rows
    return first.withColumn("_most", most).where("score > 0 OR _most = 0").drop("_most").orderBy(F.desc("score"), F.asc("arxiv_id"))


def search_many(questions: DataFrame, papers: DataFrame, memory: DataFrame, evidence: DataFrame, limit: int = 8, fallback: bool = False) -> DataFrame:
    """(question_id, arxiv_id, score, place) of the best candidates of each question (question_id, question), in one pass over the texts.

    The different terms of all questions are one array, which every task gets; texts yield a count per term
    they hold, the counts are joined to the questions by term, and only a question's best are shuffled. With
    fallback, a question none of whose terms occurs gets papers that have a summary, in order of their id.
    """
    asked = questions.select("question_id", F.explode(terms(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    every = F.broadcast(asked.agg(F.collect_set("term").alias("_terms")))  # one row
    found = lambda text: F.explode(F.filter(F.transform("_terms", lambda t: F.struct(t.alias("term"), occurrences(text, t).alias("n"))), lambda x: x.n > 0))
    claims = evidence.select("paper_id", F.lower(or_empty("claim")).alias("_text")).crossJoin(every).select("paper_id", found(F.col("_text")).alias("x"))
    own = papers.join(memory.select("paper_id", "summary"), F.col("arxiv_id") == F.col("paper_id"), "left")
    mine = own.select("arxiv_id", haystack("title", "abstract", "summary").alias("_text")).crossJoin(every).select("arxiv_id", found(F.col("_text")).alias("x"))
    known = claims.join(papers.select(F.col("arxiv_id").alias("paper_id")), "paper_id", "left_semi")
    counts = mine.union(known).groupBy("arxiv_id", F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n"))
    total = counts.join(asked, "term").groupBy("question_id", "arxiv_id").agg(F.sum(F.col("n") * F.col("times")).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("arxiv_id"))
    best = total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("question_id", "arxiv_id", "score", "place")
    if not fallback:
        return best
    summarised = own.where(strip(or_empty("summary")) != "").orderBy("arxiv_id").limit(limit).select("arxiv_id")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("arxiv_id"))  # over at most `limit` rows
    instead = F.broadcast(summarised.select("arxiv_id", F.lit(0).cast("long").alias("score"), place.alias("place")))
    without = questions.select("question_id").join(best.select("question_id"), "question_id", "left_anti")
    return best.union(without.crossJoin(instead).select("question_id", "arxiv_id", "score", "place"))


def record_text(most: int = 3000) -> Column:
    """A returned record as it stands in the prompt."""
    return F.concat(
        F.lit("[arXiv:"), F.col("arxiv_id"), F.lit("]\nTITLE: "), or_empty("title"), F.lit("\nSUMMARY: "), or_empty("summary"),
        F.lit("\nABSTRACT: "), F.substring(or_empty("abstract"), 1, most), F.lit("\nEVIDENCE: "), or_empty("claims"),
    )


def prompt(found: DataFrame, evidence: DataFrame, question: str, reduce: Callable[[DataFrame], DataFrame] = lambda e: e) -> DataFrame:
    """One row: the prompt over the records found, at most as many as the search's limit.

    The records are found once and kept as local rows. Evidence is narrowed to them before it is reduced to
    one row per id, where it has repeated ones.
    """
    found = found.sparkSession.createDataFrame(found.collect(), found.schema)  # at most `limit` rows
    few = F.broadcast(found.select(F.col("arxiv_id").alias("paper_id")))
    claims = claim_texts(reduce(evidence.join(few, "paper_id", "left_semi")))
    records = found.join(claims, F.col("arxiv_id") == F.col("paper_id"), "left").select("score", "arxiv_id", record_text().alias("record"))
    joined = F.expr("listagg(record, '\\n\\n') WITHIN GROUP (ORDER BY score DESC, arxiv_id)")
    return records.agg(F.concat(F.lit(f"QUESTION:\n{question}\n\nRETRIEVED RECORDS:\n\n"), F.coalesce(joined, F.lit(""))).alias("prompt"))
