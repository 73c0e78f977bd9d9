"""Assembling model contexts under a token budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import or_empty, strip, tokens

TOTAL, RESERVE, LEAST = 8000, 1500, 1000

# Texts of the task blocks.
SUMMARY_TASK = "Create a faithful structured summary of this scientific paper. Do not invent facts."
SYNTHESIS_TASK = (
    "Synthesize the literature. Separate consensus, contradictions, limitations and open questions. "
    "Ground conclusions in the supplied evidence."
)


def input_budget(total: int = TOTAL, reserve: int = RESERVE) -> int:
    return max(LEAST, total - reserve)


def block(name: Column | str, text: Column, priority: Column | int, required: bool = False) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    priority = F.lit(priority) if isinstance(priority, int) else priority
    return F.struct(name.alias("name"), or_empty(text).alias("text"), priority.cast("int").alias("priority"), F.lit(required).alias("required"))


def rendered(name: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n["), name, F.lit("]\n"), strip(text))


def pack(blocks: Column, budget: int) -> Column:
    """struct<used, names, text> of the blocks that fit.

    Required blocks come first and are always taken, then the others by priority, ties as given. A block
    that doesn't fit is skipped as a whole and later ones are still tried.
    """
    order = F.array_sort(
        F.transform(
            blocks,
            lambda b, i: F.struct(
                (~b.required).alias("optional"), (-b.priority).alias("back"), i.alias("at"), b["name"].alias("name"), rendered(b["name"], b.text).alias("text")
            ),
        )
    )
    priced = F.transform(order, lambda b: b.withField("cost", tokens(b.text)))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("names"), F.lit("").alias("text"))

    def take(done: Column, b: Column) -> Column:
        more = F.struct(
            (done.used + b.cost).alias("used"), F.concat(done.names, F.array(b["name"])).alias("names"), F.concat(done.text, b.text).alias("text")
        )
        return F.when(~b.optional | (done.used + b.cost <= budget), more).otherwise(done)

    return F.aggregate(priced, start, take, lambda done: F.struct(done.used, done.names, strip(done.text).alias("text")))


def paper_blocks(title: Column, abstract: Column, sections: Column | None = None, goal: Column | None = None) -> Column:
    """Blocks of a paper's summary; sections: array<struct<heading, text>> in their order of choice."""
    fixed = [block("TASK", F.lit(SUMMARY_TASK), 100, True), block("TITLE", title, 100, True), block("ABSTRACT", abstract, 95, True)]
    if goal is not None:
        fixed.append(block("RESEARCH_GOAL", goal, 90))
    out = F.array(*fixed)
    if sections is None:
        return out
    named = F.transform(
        F.coalesce(sections, F.array().cast("array<struct<heading:string,text:string>>")),
        lambda s, i: block(F.concat(F.lit("SECTION_"), F.lpad((i + 1).cast("string"), 2, "0"), F.lit("_"), F.substring(or_empty(s.heading), 1, 60)), s.text, 80 - i),
    )
    return F.concat(out, named)


def synthesis_blocks(goal: Column, summaries: Column, evidence: Column, previous: Column) -> Column:
    return F.array(
        block("TASK", F.lit(SYNTHESIS_TASK), 100, True),
        block("RESEARCH_GOAL", goal, 100, True),
        block("PREVIOUS_SYNTHESIS", previous, 70),
        block("PAPER_SUMMARIES", summaries, 85),
        block("EVIDENCE", evidence, 90),
    )
