"""Broken question-answer pairs, each flagged with its first defect.

Copies are detected by compressing the answer with its question as a zstandard dictionary: what is left
is what the answer adds. Refusals are found with dictionaries of openings and of phrases that decline,
languages with dictionaries learnt from texts of each language. Truncation is judged by a model of
terminal contexts, trained on the ends that texts have against cuts made inside them.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import bounded_sample, table

#: The models are fitted on at most so many texts each, those with the smallest key hashes.
LANGUAGE_SAMPLE, ENDING_SAMPLE = 4000, 12000
#: An answer is a copy if it takes over this share of its question and adds at most so many bytes and this share of itself.
TAKEN_SHARE, ADDED_BYTES, ADDED_SHARE = 0.7, 6, 0.25

# Strings that stand for a missing answer.
PLACEHOLDERS = frozenset((
    "na", "n a", "none", "null", "nil", "nan", "tbd", "tba", "todo", "empty", "not available", "not applicable",
    "not provided", "not given", "no answer", "no response", "no data", "nothing", "unknown", "undefined", "blank",
    "missing", "placeholder", "keine angabe", "k a", "leer", "nicht verfügbar", "entfällt", "non disponible", "néant",
    "vide", "aucun", "no disponible", "vacío", "ninguno", "sin respuesta", "нет", "нет данных", "пусто", "не указано",
))
# Openings that may stand before a refusal.
OPENINGS = (
    r"(?:i['’]?m|i am|we are|we['’]re) (?:very |so |really )?(?:sorry|afraid)", "sorry", "(?:my )?apologies", r"i apologi[sz]e",
    "unfortunately", "regrettably", "i regret(?: to say)?", "note", "as an? (?:ai|artificial intelligence)(?: language)?(?: model| assistant)?",
    "as a (?:large )?language model", "please note", "thank you[^.!,]*", "however",
    "(?:es )?tut mir (?:sehr )?leid", "leider", "entschuldigung", "entschuldigen sie", "verzeihung", "ich bedau[e]?re", "als ki(?:-modell)?",
    "(?:je suis )?désolée?", "malheureusement", "pardon", "excusez-moi", "je regrette", "hélas", "en tant qu['’]ia",
    "lo siento(?: mucho)?", "lamentablemente", "desafortunadamente", "por desgracia", "perdón", "disculpe", "lo lamento", "como modelo de lenguaje",
    "извините", "простите", "к сожалению", "увы", "прошу прощения", "сожалею", "мне жаль", "как языковая модель",
)
# Phrases that decline.
DECLINES = (
    r"i (?:can['’]?t|can ?not|could ?n[o'’]t|couldn['’]t|won['’]?t|will not|shall not|must decline|have to decline|decline|refuse|do not know|don['’]t know)\b",
    r"i(?: am|['’]m) (?:unable|not able|not allowed|not permitted|not in a position|incapable)\b",
    r"i (?:do not|don['’]t) (?:have|possess) (?:access|the ability|enough|sufficient|any|information|the information|permission)\b",
    r"i (?:have|lack) (?:no access|no information|no way|the information|the context|access|sufficient|enough)\b",
    r"it is (?:not possible|impossible) for me\b", r"(?:my|our) (?:guidelines|policy|policies|instructions|rules) (?:do|does|will)(?: not|n['’]t)\b",
    r"there is(?: not|n['’]t) (?:enough|sufficient) \w+ for me\b", r"i(?: would|['’]d) rather not\b", r"this request can(?:not|['’]t)\b",
    r"(?:ich )?(?:kann|darf|könnte|möchte|werde) (?:ich )?(?:[^.!?]*? )?(?:nicht|nichts|keine[nrsm]?)\b", r"ich bin (?:leider )?nicht (?:in der lage|befugt|berechtigt)\b",
    r"ich habe (?:leider )?keine[nr]? (?:zugriff|zugang|informationen|möglichkeit)\b", r"es ist mir (?:leider )?(?:nicht möglich|unmöglich)\b", r"mir (?:fehlt|fehlen|ist es nicht möglich)\b",
    r"je (?:ne |n['’])(?:peux|pourrais|suis|dispose|ai|sais)\b", r"il (?:m['’]est impossible|ne m['’]est pas possible)\b", r"je (?:refuse|dois refuser|dois décliner)\b",
    r"mes (?:consignes|directives|règles) ne\b",
    r"no (?:puedo|podría|podré|me es posible|tengo (?:acceso|información|permiso)|dispongo|soy capaz|estoy autorizad[oa]|estoy en condiciones|sé)\b",
    r"(?:me es imposible|debo declinar|me niego a|mis (?:normas|directrices|instrucciones) no)\b",
    r"(?:я )?не (?:могу|смогу|имею|вправе|в состоянии|буду|располагаю|знаю)\b", r"(?:мне|у меня) (?:не|нет)\b", r"(?:я )?вынужден[а]? отказать", r"мои правила не\b",
)
# Abbreviations after which a text goes on.
ABBREVIATIONS = frozenset((
    "sec", "sect", "fig", "figs", "eq", "eqs", "tab", "ref", "refs", "ch", "al", "e.g", "i.e", "cf", "vs", "viz", "approx", "no", "nos", "vol", "pp",
    "dr", "prof", "mr", "mrs", "st", "resp", "incl", "z.b", "d.h", "bzw", "vgl", "abb", "abs", "nr", "ca", "u.a", "p.ex", "p.ej", "c.-à-d", "env", "núm",
    "т.е", "т.д", "т.к", "рис", "табл", "см", "напр", "гл",
))

WORD = re.compile(r"[^\W\d_]+")
QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")
LEAD = r"(?:(?:" + "|".join(OPENINGS) + r")[\s,.:;!\-–—]*(?:(?:but|that|aber|dass|mais|que|pero|но|что)\s+)?)*"
REFUSAL = re.compile(r"^\W*" + LEAD + r"(?:" + "|".join(DECLINES) + ")", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    words = " ".join(re.findall(r"\w+", answer.casefold()))
    return not words.strip("_ ") or words in PLACEHOLDERS


def is_refusal(answer: str) -> bool:
    """Whether one of few sentences declines in the writer's own voice; what is quoted isn't the writer's."""
    said = QUOTED.sub(" ", answer).strip()
    sentences = SENTENCE.split(said)
    whole = REFUSAL.match(said)
    return bool(whole) or len(sentences) <= 3 and any(REFUSAL.match(s) for s in sentences)


@lru_cache(maxsize=512)
def _compressor(question: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(question, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=5, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def _plain(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.casefold()))


def is_copy(answer: str, question: str | None) -> bool:
    """Whether the question, taken as a dictionary, leaves next to nothing of the answer to write.

    A question too short to be a dictionary is copied if the answer holds it and next to nothing else.
    """
    q, a = _plain(question or "").encode(), _plain(answer).encode()
    if len(q) < 12:
        return bool(q) and q in a and len(a) - len(q) <= ADDED_BYTES
    if len(a) < 0.6 * len(q):
        return False
    frame = 12
    added = len(_compressor(b"  " + q + b" ").compress(a)) - frame
    return added <= ADDED_BYTES + ADDED_SHARE * len(a) and len(a) - added >= TAKEN_SHARE * len(q)


def label_language(words: list[str], common: dict[str, frozenset[str]]) -> str | None:
    hits = {lang: sum(w in of for w in words) for lang, of in common.items()}
    best = sorted(hits, key=lambda x: (-hits[x], x))
    return best[0] if best and hits[best[0]] >= 3 and (len(best) < 2 or hits[best[0]] >= 2 * hits[best[1]]) else None


class Languages:
    """Weights of words and, for unknown ones, of their last letters, by language."""

    def __init__(self, common: dict[str, frozenset[str]], texts: list[str]) -> None:
        counts: dict[str, Counter] = {lang: Counter({w: 3 for w in of}) for lang, of in common.items()}
        for t in texts:
            words = WORD.findall(t.lower())
            lang = label_language(words, common)
            if lang:
                for w in set(words):
                    counts[lang][w] += 1
                    counts[lang]["-" + w[-3:]] += 1
        self.names = sorted(counts)
        size = {lang: 1 + max(c.values(), default=1) for lang, c in counts.items()}
        self.weights = {
            w: [math.log((counts[n][w] + 0.2) / size[n]) for n in self.names] for w in {w for c in counts.values() for w in c}
        }

    def of(self, text: str | None) -> tuple[str | None, float]:
        """The language and by how much it leads the next."""
        total = [0.0] * len(self.names)
        for w in WORD.findall((text or "").lower()):
            got = self.weights.get(w) or self.weights.get("-" + w[-3:])
            if got:
                top = max(got)
                for i, x in enumerate(got):
                    total[i] += max(x - top, -4.0)
        order = sorted(range(len(total)), key=lambda i: -total[i])
        if len(order) < 2 or total[order[0]] == total[order[1]]:
            return None, 0.0
        return self.names[order[0]], total[order[0]] - total[order[1]]


def ending(text: str) -> list[str]:
    """Features of a text's terminal context."""
    t = text.rstrip()
    tokens = t[-200:].split()
    last, before = (tokens[-1] if tokens else ""), (tokens[-2] if len(tokens) > 1 else "")
    shape = re.sub(r"[^\W\d_]+", "w", re.sub(r"\d+", "0", last))[-4:]
    core = last.lower().strip("()[]\"'“”»«,;:")
    return [
        "c" + ("w" if t[-1:].isalpha() else "0" if t[-1:].isdigit() else t[-1:]),
        "s" + shape,
        "b" + (before.lower() if len(before) <= 4 else "w") + "|" + shape[-1:],
        "o" + str((t.count("(") > t.count(")")) or (t.count("[") > t.count("]"))),
        "q" + str(t.count('"') % 2),
        "e" + str(t.endswith(("...", "…"))),
        "l" + (core if len(core) <= 5 and not core[:1].isdigit() else "w") + "|" + t[-1:] if t[-1:] in ".!?" else "l",
    ]


class Endings:
    """Log odds that a text with this terminal context is complete."""

    def __init__(self, texts: list[str]) -> None:
        draw = random.Random(7)
        full, cut = Counter(), Counter()
        n = m = 0
        for t in texts:
            t = t.strip()
            if len(t) < 30:
                continue
            full.update(ending(t))
            n += 1
            for _ in range(2):
                part = t[: draw.randrange(10, len(t) - 3)].rstrip()
                if not re.search(r"[.!?…][\"'”’»)\]]*$", part) or not re.match(r"\s+[A-ZÀ-ÞЀ-Я¿¡\"(]", t[len(part) :]):
                    cut.update(ending(part))
                    m += 1
        self.odds = {f: math.log((full[f] + 0.5) / (n + 1)) - math.log((cut[f] + 0.5) / (m + 1)) for f in {*full, *cut}}

    def is_truncated(self, text: str) -> bool:
        t = text.rstrip()
        last = t.split()[-1].lower().rstrip(".").lstrip("([\"'") if t.split() else ""
        if t.endswith(".") and (last in ABBREVIATIONS or t.endswith("...")) or t.endswith("…"):
            return True
        if t[-1:] in "([{-–—,;:&/":
            return True
        return sum(self.odds.get(f, 0.0) for f in ending(text)) < 0


def fit(memory: DataFrame, papers: DataFrame, common_words: DataFrame) -> tuple[Languages, Endings]:
    """Both models, on the driver, of samples with fixed bounds."""
    common: dict[str, set[str]] = {}
    for r in common_words.collect():  # a table of fixed size
        common.setdefault(r["lang"], set()).add(r["word"])
    texts = bounded_sample(papers.select("arxiv_id", "abstract").where("abstract IS NOT NULL"), "arxiv_id", LANGUAGE_SAMPLE)
    ends = bounded_sample(memory.select("paper_id", "summary", "method"), "paper_id", ENDING_SAMPLE // 2)
    languages = Languages({k: frozenset(v) for k, v in common.items()}, [r["abstract"] for r in texts.collect()])
    return languages, Endings([x for r in ends.collect() for x in (r["summary"], r["method"]) if x and not is_empty(x)])


def defect(answer: str | None, question: str | None, paper_language: str | None, languages: Languages, endings: Endings) -> str | None:
    """The first defect that holds, in the order that they are tried in."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if is_copy(answer, question):
        return "echo"
    if paper_language:
        lang, lead = languages.of(answer)
        if lang and lang != paper_language and lead >= 3.0:
            return "wrong_language"
    return "truncated" if endings.is_truncated(answer) else None


def judged(answers: DataFrame, papers: DataFrame, languages: Languages, endings: Endings) -> DataFrame:
    """(field, record_key, defect) of answers (field, record_key, paper_id, answer, question); papers: (paper_id, text).

    An answer whose paper is unknown or has no clear language is judged without it, one without a
    question isn't compared with any. Repeated rows come out once.
    """
    models = answers.sparkSession.sparkContext.broadcast((languages, endings))  # bounded by the samples

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = models.value[0]
        for b in batches:
            found = [known.of(t) for t in b["text"]]
            yield pd.DataFrame({"paper_id": b["paper_id"], "lang": [x if lead >= 3.0 else None for x, lead in found]})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect(a, q, lang, *models.value) for a, q, lang in zip(b["answer"], b["question"], b["lang"])]
            b = b[["field", "record_key"]].assign(defect=found)
            yield b[b["defect"].notna()]

    spoken = papers.select("paper_id", "text").mapInPandas(speak, "paper_id string, lang string").dropDuplicates(["paper_id"])
    joined = answers.join(spoken, "paper_id", "left").select("field", "record_key", "answer", "question", "lang")
    return joined.mapInPandas(judge, "field string, record_key string, defect string").distinct()


def p4_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each defective summary, method and claim."""
    memory = table(spark, sf_dir, "paper_memory").select("paper_id", "research_question", "summary", "method")
    papers = table(spark, sf_dir, "papers").select("arxiv_id", "title", "abstract")
    evidence = table(spark, sf_dir, "evidence").select("id", "paper_id", "claim")
    models = fit(memory, papers, table(spark, sf_dir, "common_words"))
    questions = memory.select("paper_id", F.col("research_question").alias("question")).dropDuplicates(["paper_id"])
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("answer"))
    own = memory.select("paper_id", F.col("research_question").alias("question"), F.explode(F.array(field("summary"), field("method"))).alias("x"))
    own = own.select("x.field", F.col("paper_id").alias("record_key"), "paper_id", "x.answer", "question")
    claims = evidence.join(questions, "paper_id", "left").select(
        F.lit("claim").alias("field"), F.col("id").cast("string").alias("record_key"), "paper_id", F.col("claim").alias("answer"), "question"
    )
    texts = papers.select(F.col("arxiv_id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("text"))
    return judged(own.unionByName(claims), texts, *models)
