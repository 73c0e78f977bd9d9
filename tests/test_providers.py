import pytest
from pyspark.sql import functions as F

from litspark import providers as P

PROMPTS = [
    "[TASK]\nx\n\n[TITLE]\nt\n\n[ABSTRACT]\n  The abstract. \n\n[RESEARCH_GOAL]\ng",
    "[ABSTRACT]\nall of it\n\n[SECTION_01_Intro]\nkept, as its marker holds small letters",
    "[ABSTRACT]\n" + "a" * 4000,
    "no marker, ABSTRACT: here",
    "",
]


def test_column_equals_the_plain_provider(spark):
    df = spark.createDataFrame([(p,) for p in PROMPTS], "p string").coalesce(1)
    assert [r[0] for r in df.select(P.extract(F.col("p"))).collect()] == [P.Extractive().generate(p) for p in PROMPTS]
    assert P.Extractive().generate(PROMPTS[0]) == "The abstract."
    assert "kept" in P.Extractive().generate(PROMPTS[1])
    assert len(P.Extractive().generate(PROMPTS[2])) == 3000 and P.Extractive().generate(PROMPTS[3]) == ""


def test_json_mode(spark):
    import json

    df = spark.createDataFrame([(p,) for p in PROMPTS], "p string").coalesce(1)
    for r, p in zip(df.select(P.extract(F.col("p"), True)).collect(), PROMPTS):
        assert json.loads(r[0]) == json.loads(P.Extractive().generate(p, json_mode=True))
    assert len(json.loads(P.Extractive().generate(PROMPTS[2], json_mode=True))["summary"]) == 2200


def test_choice_of_provider():
    nowhere = "http://127.0.0.1:9"
    assert P.provider("extractive", "m", nowhere).name == "extractive-fallback"
    assert P.provider("auto", "m", nowhere).name == "extractive-fallback"
    for kind in ("ollama", "other"):
        with pytest.raises(P.ProviderError):
            P.provider(kind, "m", nowhere)
