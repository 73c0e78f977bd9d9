from litspark.operators import retrieval as R


def tables(spark):
    papers = spark.createDataFrame([("p1", "Agent agent", "x"), ("p2", "Nothing", None), ("p3", "agentic", "Graph")], "arxiv_id string, title string, abstract string")
    memory = spark.createDataFrame([("p1", " "), ("p2", "a summary")], "paper_id string, summary string")
    evidence = spark.createDataFrame([(2, "p2", "graph claims"), (1, "p2", "An agent"), (3, "p3", None), (4, "gone", "agent")], "id long, paper_id string, claim string")
    return papers, memory, evidence


def test_scores_sum_over_all_texts(spark):
    got = {r["arxiv_id"]: r["score"] for r in R.scored(*tables(spark), ["agent", "graph", "agent"]).collect()}
    assert got == {"p1": 4, "p2": 3, "p3": 3}


def test_top_breaks_ties_by_id_and_limit_zero_is_empty(spark):
    scored = R.scored(*tables(spark), ["agent", "graph", "agent"])
    assert [r["arxiv_id"] for r in R.top(scored, 2).collect()] == ["p1", "p2"]
    assert R.search(scored, 0).count() == 0


def test_fallback_needs_a_summary(spark):
    assert [r["arxiv_id"] for r in R.search(R.scored(*tables(spark), ["zzz"])).collect()] == ["p2"]
    assert [r["arxiv_id"] for r in R.search(R.scored(*tables(spark), [])).collect()] == ["p2"]


def test_claims_stand_in_order_of_their_id(spark):
    got = {r["paper_id"]: r["claims"] for r in R.claim_texts(tables(spark)[2]).collect()}
    assert got == {"p2": "An agent | graph claims", "gone": "agent"}


def test_many_questions_equal_one_by_one(spark):
    papers, memory, evidence = tables(spark)
    asked = {"a": "agent graph agent", "b": "summary", "c": "of"}
    df = spark.createDataFrame(list(asked.items()), "question_id string, question string")
    many = R.search_many(df, papers, memory, evidence, 2)
    got = sorted((r["question_id"], r["place"], r["arxiv_id"], r["score"]) for r in many.collect())
    want = []
    for q, text in asked.items():
        best = R.top(R.scored(papers, memory, evidence, R.question_terms(text)), 2).collect()
        want += [(q, i, r["arxiv_id"], r["score"]) for i, r in enumerate(best, 1)]
    assert got == sorted(want)


def test_many_questions_fall_back_one_by_one(spark):
    papers, memory, evidence = tables(spark)
    asked = {"a": "agent graph agent", "b": "zzz", "c": "of", "d": None}
    df = spark.createDataFrame(list(asked.items()), "question_id string, question string")
    got = sorted((r["question_id"], r["place"], r["arxiv_id"], r["score"]) for r in R.search_many(df, papers, memory, evidence, 2, fallback=True).collect())
    want = []
    for q, text in asked.items():
        want += [(q, i, r["arxiv_id"], r["score"]) for i, r in enumerate(R.search(R.scored(papers, memory, evidence, R.question_terms(text or "")), 2).collect(), 1)]
    assert got == sorted(want) and len(got) == 5


def test_prompt(spark):
    papers, memory, evidence = tables(spark)
    text = R.prompt(R.top(R.scored(papers, memory, evidence, ["graph"]), 1), evidence, "graph?").first()["prompt"]
    assert text == "QUESTION:\ngraph?\n\nRETRIEVED RECORDS:\n\n[arXiv:p2]\nTITLE: Nothing\nSUMMARY: a summary\nABSTRACT: \nEVIDENCE: An agent | graph claims"
