import pytest

from litspark.llm import answers as A

COMMON = {
    "en": frozenset("the of and to in is that for with not we are on by was they from but as it this".split()),
    "de": frozenset("der die das und ist nicht mit von zu auf für sie wir dass ein den sind aus nach".split()),
    "ru": frozenset("и в не на что с как мы это они по из для".split()),
}
EN = "The graph of the agents is stable and it was measured with great care by the authors. They found that the sensors are not affected by the noise in this study."
DE = "Die Modelle sind nicht stabil und wir zeigen, dass sie mit der Zeit von den Daten lernen. Nach dem Versuch ist das Ergebnis für die Sensoren auf der Karte."
RU = "Мы показываем, что они не зависят от данных и это важно для всех. Как видно из опыта, по мере роста они меняются в лучшую сторону."


@pytest.fixture(scope="module")
def models():
    languages = A.Languages(COMMON, [EN, DE, RU] * 20)
    ends = [f"The {w} of the sensors was measured {k} times. They are stable{e}" for w in ("mean", "noise", "size", "state") for k in (3, 40, 17) for e in (".", ".", " (n = 4).", ".", " [12].")] * 5
    return languages, A.Endings(ends)


def test_each_defect(models):
    q = "How do the sensors of the graph measure the noise of agents?"
    for answer, want in {
        None: "empty", "": "empty", " \n": "empty", "N/A": "empty", "[]": "empty", "--": "empty", "(empty)": "empty", "null": "empty",
        "I'm sorry, but I cannot say anything about the graph.": "refusal",
        "As an AI language model, I am unable to answer. Please upload the file.": "refusal",
        "Leider kann ich dazu nichts sagen.": "refusal", "Désolé, je ne peux pas répondre.": "refusal",
        "Lo siento, no puedo responder.": "refusal", "К сожалению, я не могу ответить.": "refusal",
        q: "echo", q.upper(): "echo", "The question is: " + q: "echo", q + " " + q: "echo",
        DE: "wrong_language", RU: "wrong_language",
        "The graph of the agents is stable and it was": "truncated",
        "The mean of the sensors was measured with": "truncated",
        "They are stable, as the authors measured, i.e.": "truncated",
        "The mean of the sensors was meas...": "truncated",
        EN: None,
        'The model answers "I cannot say" to most of the questions of the study.': None,
        "The noise of the sensors was measured 40 times. They are stable [12].": None,
    }.items():
        assert A.defect(answer, q, "en", *models) == want, answer


def test_without_question_or_language(models):
    assert A.defect(EN, None, None, *models) is None
    assert A.defect(DE, "", None, *models) is None
    assert not A.is_copy("short", "q?") and not A.is_copy(EN, "")


def test_an_answer_that_goes_on_after_the_question_is_no_copy():
    q = "How do the sensors of the graph measure the noise of agents?"
    assert not A.is_copy(q + " " + EN, q)


def test_first_defect_wins(models):
    assert A.defect("I cannot answer the", "q", "de", *models) == "refusal"


def test_languages_held_out(models):
    languages = models[0]
    assert languages.of("the noise was measured by the authors")[0] == "en"
    assert languages.of("die Daten sind nicht auf der Karte")[0] == "de"
    assert languages.of("мы показываем это")[0] == "ru"
    assert languages.of("")[0] is None and languages.of(None)[0] is None


def test_judged(spark, models):
    answers = spark.createDataFrame(
        [("s", "1", "p", EN, None), ("s", "1", "p", EN, None), ("s", "2", "p", None, "q"), ("s", "2", "p", None, "q"), ("m", "3", None, DE, None), ("m", "4", "p", DE, None), ("m", None, "gone", "", None)],
        "field string, record_key string, paper_id string, answer string, question string",
    )
    papers = spark.createDataFrame([("p", EN, "x"), ("p", EN, "x"), ("q", None, "y")], "paper_id string, text string, lang string")
    got = sorted(map(tuple, A.judged(answers, papers, *models).collect()), key=str)
    assert got == [("m", "4", "wrong_language"), ("m", None, "empty"), ("s", "2", "empty")]
    assert A.judged(answers.limit(0), papers, *models).count() == 0


def test_copies_of_short_questions():
    from litspark.llm.answers import is_copy

    assert is_copy("Why?", "why") and is_copy("So, why?", "Why?") and not is_copy("Why do models fail so often?", "Why?")
    assert not is_copy("anything", "") and not is_copy("anything", None) and not is_copy("", "why")
