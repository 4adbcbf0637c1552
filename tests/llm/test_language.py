import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language
from textloom.llm.words import FUNCTION_WORDS, LANGUAGES

TEXTS = {
    "en": "The planner reads the open requests before the next batch starts and keeps every answer in the store.",
    "de": "Der Planer liest die offenen Anfragen vor dem nächsten Durchgang und behält jede Antwort im Speicher.",
    "fr": "Le planificateur lit les demandes en cours avant le prochain passage et garde chaque réponse dans l'entrepôt.",
    "es": "El planificador lee las peticiones pendientes antes de la siguiente vuelta y guarda cada respuesta en el almacén.",
    "pt": "O planejador lê os pedidos pendentes antes da próxima volta e guarda cada resposta no depósito.",
    "nl": "De planner leest de openstaande aanvragen vóór de volgende ronde en bewaart elk antwoord in de opslag.",
}
CHUNKS = "chunk_id string, language string, content string, lang string, label string, lines int"
PAGES = "web_id long, language string, content string, raw_html string, title string, tab int"


def sample(n, seed):
    """Sentences of shuffled clauses, so that training and judged texts differ."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = LANGUAGES[i % len(LANGUAGES)]
        words = TEXTS[code].split()
        at = rng.randint(0, len(words) - 8)
        out.append((code, " ".join(words[at:] + words[:at]) + " " + TEXTS[code]))
    return out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, trans = rng.normal(size=(1, 3, language.K)), rng.normal(size=(language.K, language.K))
    marginals, _, total = language._forward_backward(scores, np.array([3]), trans)
    weights = np.zeros((language.K,) * 3)
    for path in np.ndindex(*weights.shape):
        weights[path] = np.exp(sum(scores[0, t, k] for t, k in enumerate(path)) + trans[path[0], path[1]] + trans[path[1], path[2]])
    for t in range(3):
        axes = tuple(a for a in range(3) if a != t)
        assert np.allclose(marginals[0, t], weights.sum(axis=axes) / weights.sum())
    assert np.isclose(total[0], np.log(weights.sum()))
    pot = np.exp(scores - scores.max(axis=2, keepdims=True))
    assert np.allclose(language._posteriors(pot, np.array([3]), np.exp(trans)), marginals)


def test_held_out_accuracy():
    sequences = [language.training_sequence(text, code) for code, text in sample(120, 1)]
    field = language.Field(*language.fit([s for s in sequences if s]))
    held = sample(120, 2)
    got = field.label([[(1, text)] for _, text in held])
    assert sum(g[0] == code for g, (code, _) in zip(got, held)) >= 118
    assert all(0.5 < g[1] <= 1.0001 for g in got)


def test_without_training_the_lexicon_decides():
    field = language.Field(*language.fit([]))
    assert all(field.label([[(1, text)]])[0][0] == code for code, text in TEXTS.items())


def test_labels(spark):
    given = ["en", "EN-us", "en_GB", "English", "Deutsch", "pt-BR", " fra ", "español", None, "", "unknown", "und", "it", "Klingon", "de (Schweiz)"]
    want = ["en", "en", "en", "en", "de", "pt", "fr", "es", None, None, None, None, None, None, "de"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, l string").select("i", language.label_code(F.col("l")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == want


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"t{i}", code, text) for i, (code, text) in enumerate(sample(240, 4))]
    mixed = TEXTS["en"] + "\n" + TEXTS["en"] + "\n" + TEXTS["de"] + "\n\nok\n"
    rows += [("right", "English", TEXTS["en"]), ("wrong", "de", TEXTS["en"]), ("none", None, TEXTS["fr"]), ("mixed", "en", mixed), ("short", None, "12 / 3.4"), ("null", "en", None), ("empty", "en", ""), ("mails", "en", TEXTS["en"] + "\ncc ann.planificador@reponse.example.org; entrepot.chaque@demandes.example")]
    rows += [("twice", None, TEXTS["nl"]), ("twice", None, TEXTS["nl"]), ("long", None, (TEXTS["pt"] + "\n") * 800)]
    chunks = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CHUNKS)
    pages = spark.createDataFrame([(1, "en", "Home\n" + TEXTS["es"] + "\n" + TEXTS["en"] + "\n" + TEXTS["es"], None, None, 1), (2, "en", None, "<p>x</p>", None, 1)], PAGES)
    out = language.identify(pages, chunks)
    return {(r.tab, r.rec_id): r for r in out.collect()}, {tuple(r) for r in language.mislabelled(out).collect() if not r.rec_id.startswith("t") or r.rec_id == "twice"}


def test_documents(judged):
    rows, _ = judged
    for key, lang in (("right", "en"), ("wrong", "en"), ("none", "fr"), ("mixed", "en"), ("short", None), ("empty", None), ("twice", "nl"), ("long", "pt"), ("mails", "en")):
        assert rows["document_chunks", key].lang == lang, key
    assert ("document_chunks", "null") not in rows and rows["web_content", "1"].lang == "es"


def test_cases(judged):
    _, found = judged
    assert found == {
        ("document_chunks", "wrong", 0, "en"), ("document_chunks", "none", 0, "fr"), ("document_chunks", "mixed", 3, "de"), ("document_chunks", "twice", 0, "nl"), ("document_chunks", "long", 0, "pt"),
        ("web_content", "1", 0, "es"), ("web_content", "1", 3, "en"),
    }


def test_empty_tables(spark):
    assert language.identify(spark.createDataFrame([], PAGES), spark.createDataFrame([], CHUNKS)).count() == 0


def test_lexicons_have_words():
    assert all(len(words) > 60 for words in FUNCTION_WORDS.values())
