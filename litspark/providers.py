"""Text generation for summaries, syntheses and answers."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litspark.functions.text import strip

SUMMARY_MOST, ANSWER_MOST = 2200, 3000

# Instructions of the three tasks.
SUMMARY_SYSTEM = (
    "You are a scientific paper analyst. Stay strictly grounded in the supplied paper text. "
    "If information is absent, use empty strings/lists. Return valid JSON only."
)
SYNTHESIS_SYSTEM = (
    "You synthesize scientific literature. Never convert a single paper into consensus. Explicitly distinguish "
    "supporting evidence, contradictions, uncertainty, methodological limitations and open questions."
)
ANSWER_SYSTEM = "Answer only from the retrieved scientific records. Cite claims inline with [arXiv:ID]. If the records are insufficient, say so."
SUMMARY_SUFFIX = """

Return JSON with exactly these top-level fields:
{
  "summary": "compact but informative summary, 120-250 words",
  "research_question": "",
  "method": "",
  "datasets": [],
  "baselines": [],
  "main_results": [],
  "limitations": [],
  "evidence": [
    {
      "claim": "atomic claim supported by the paper",
      "evidence_type": "experiment|ablation|theory|observation|benchmark|claim",
      "result": "result or measurement if stated",
      "section": "section heading if known",
      "quote": "short supporting excerpt, max 30 words; empty if unavailable",
      "confidence": 0.0,
      "tags": []
    }
  ]
}
Do not add markdown fences.
"""
SYNTHESIS_SUFFIX = """

Write a compact synthesis with these headings:
1. Current picture
2. Strongest recurring findings
3. Contradictions / boundary conditions
4. Methodological weaknesses
5. Open questions
6. Papers that matter most
Use arXiv IDs when available. Do not invent evidence.
"""


# Options of requests to the model server.
TEMPERATURE, WINDOW = 0.1, 8192


class ProviderError(RuntimeError):
    pass


class Provider(Protocol):
    name: str

    def generate(self, prompt: str, system: str = "", json_mode: bool = False) -> str: ...


# The text after the first [ABSTRACT], up to the next marker of capitals, digits and underscores.
_ABSTRACT = r"(?s)^.*?\[ABSTRACT\](.*?)(?:\n\n\[[A-Z0-9_]+\]\n.*)?\z"


def abstract_of(prompt: Column) -> Column:
    """The abstract in a packed context, as a Column; empty where there is none."""
    return strip(F.regexp_extract(prompt, _ABSTRACT, 1))


def extract(prompt: Column, json_mode: bool = False) -> Column:
    """What the extractive provider answers, as a Column."""
    abstract = abstract_of(prompt)
    if not json_mode:
        return F.substring(abstract, 1, ANSWER_MOST)
    nothing = F.array().cast("array<string>")
    lists = [nothing.alias(c) for c in ("datasets", "baselines", "main_results", "limitations", "evidence")]
    return F.to_json(
        F.struct(F.substring(abstract, 1, SUMMARY_MOST).alias("summary"), F.lit("").alias("research_question"), F.lit("").alias("method"), *lists)
    )


class Extractive:
    """Answers with the abstract of the context; needs no model."""

    name = "extractive-fallback"

    def generate(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        found = re.match(_ABSTRACT.replace(r"\z", r"\Z"), prompt)
        abstract = found[1].strip() if found else ""
        if not json_mode:
            return abstract[:ANSWER_MOST]
        data: dict = {"summary": abstract[:SUMMARY_MOST], "research_question": "", "method": ""}
        data |= {c: [] for c in ("datasets", "baselines", "main_results", "limitations", "evidence")}
        return json.dumps(data, ensure_ascii=False)


class Ollama:
    """A local model server."""

    name = "ollama"

    def __init__(self, url: str, model: str, timeout: int = 600) -> None:
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=3) as r:  # noqa: S310
                return 200 <= r.status < 400
        except (urllib.error.URLError, OSError, ValueError):
            return False

    def generate(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        talk = [{"role": "system", "content": system}] if system else []
        body: dict = {
            "model": self.model, "messages": [*talk, {"role": "user", "content": prompt}], "stream": False, "think": False,
            "options": {"temperature": TEMPERATURE, "num_ctx": WINDOW},
        }
        if json_mode:
            body["format"] = "json"
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
            message = json.load(r).get("message") or {}
        for part in ("content", "thinking"):
            if text := (message.get(part) or "").strip():
                return text
        raise ProviderError(f"the model returned an empty answer with fields {sorted(message)}")


def provider(kind: str, model: str, url: str) -> Provider:
    """extractive, ollama, or auto: the server if it answers, else extractive."""
    if kind == "extractive":
        return Extractive()
    if kind not in ("ollama", "auto"):
        raise ProviderError(f"unknown provider: {kind}")
    server = Ollama(url, model)
    if server.available():
        return server
    if kind == "ollama":
        raise ProviderError(f"no model server at {url}")
    return Extractive()


#: How often a client asks again where the model failed, and the pause before, in seconds.
RETRIES, RETRY_PAUSE = 2, 2.0


def asked(of: Provider, prompt: str, system: str, json_mode: bool, sleep=time.sleep) -> str:  # noqa: ANN001
    for left in reversed(range(RETRIES + 1)):
        try:
            return of.generate(prompt, system, json_mode)
        except (ProviderError, OSError, ValueError):
            if not left:
                raise
            sleep(RETRY_PAUSE)
    raise AssertionError


def generate(df: DataFrame, prompt: str, of: Provider, system: str = "", json_mode: bool = False, keep_errors: bool = False) -> DataFrame:
    """Add column `reply`: as a Column for the extractive provider, else by a client in each partition.

    With keep_errors a row for which the model fails gets a null reply and the reason in column `error`;
    without it the failure ends the query.
    """
    if isinstance(of, Extractive):
        out = df.withColumn("reply", extract(F.col(prompt), json_mode))
        return out.withColumn("error", F.lit(None).cast("string")) if keep_errors else out

    def one(p: str) -> tuple[str | None, str | None]:
        try:
            return asked(of, p, system, json_mode), None
        except Exception as e:  # noqa: BLE001
            if not keep_errors:
                raise
            return None, str(e)[:1000] or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(p) for p in b[prompt]]
            b = b.assign(reply=[r for r, _ in got])
            yield b.assign(error=[e for _, e in got]) if keep_errors else b

    kind = StructType(list(df.schema.fields)).add("reply", "string")
    return df.mapInPandas(run, kind.add("error", "string") if keep_errors else kind)
