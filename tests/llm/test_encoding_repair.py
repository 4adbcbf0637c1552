import random

import pytest

from textloom.llm.encoding_repair import plausibility_cost, repair_encoding, repair_text, search_line

SENTENCES = [
    "Größe und Güte für die Übersicht prüfen, während der Zwischenspeicher läuft.",
    "L'étape de classement vérifie les résultats de l'essai précédent à la fin.",
    "La división en fragmentos guarda la última conversación después de cada reinicio.",
    "A opção não é padrão; o coletor de páginas lê várias seções.",
]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("sentence", SENTENCES)
def test_single_misreading_round_trips(sentence, codec):
    raw = sentence.encode("utf-8")
    try:
        garbled = raw.decode(codec)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(codec, "replace") if b >= 0x80 and bytes([b]).decode(codec, "ignore") else chr(b) for b in raw)
    fixed, found, steps = repair_text(garbled)
    assert found and fixed == sentence and f"{codec}>utf-8" in steps or codec in ("latin-1",) and fixed == sentence


@pytest.mark.parametrize("sentence", SENTENCES)
def test_double_misreading_round_trips(sentence):
    once = sentence.encode("utf-8").decode("latin-1")
    twice = once.encode("utf-8").decode("latin-1")
    fixed, found, _ = repair_text(twice)
    assert found and fixed == sentence


def test_latin_text_read_as_cyrillic():
    sentence = "Der nächtliche Lauf überschreibt die geänderten Einträge."
    fixed, found, steps = repair_text(sentence.encode("cp1252").decode("cp1251"))
    assert found and fixed == sentence and steps == "cp1251>cp1252"


@pytest.mark.parametrize(
    "text",
    [None, "", "   ", "plain ascii", "Größe und Güte – 58 €", "NÃO HÁ OPÇÃO PARA A REVISÃO", "кириллица рядом, Ελληνικά", "数据处理 と 検索", 'UTF-8 shows as "Ã¤" instead of "ä" here.', "👩‍💻 works"],
)
def test_sound_texts_stay(text):
    assert repair_text(text) == (text, False, "")


def test_part_of_a_text_is_repaired_and_the_rest_kept():
    text = "Alles gut hier: ä.\n" + "GÃ¼te und GrÃ¶ÃŸe sind wichtig.\n" + "Ende – «gut»"
    fixed, found, _ = repair_text(text)
    assert found and fixed == "Alles gut hier: ä.\nGüte und Größe sind wichtig.\nEnde – «gut»"


def test_replacement_characters_count_but_stay():
    fixed, found, steps = repair_text("L'�tape de classement")
    assert found and "�" in fixed and steps == "replacement"


def test_cost_prefers_the_original():
    for s in SENTENCES:
        assert plausibility_cost(s) < plausibility_cost(s.encode().decode("latin-1"))
        assert search_line(s)[0] == s


def test_operator_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "GÃ¼te und GrÃ¶ÃŸe", 7), (3, "GÃ¼te und GrÃ¶ÃŸe", 7), (4, "x" * 300_000 + " GÃ¼te und GrÃ¶ÃŸe", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repaired int")
    out = sorted((r.doc_id, r.repaired.garbled, (r.repaired.text or "")[-14:]) for r in repair_encoding(df).collect())
    assert out == [(1, False, ""), (2, False, ""), (3, True, "Güte und Größe"), (3, True, "Güte und Größe"), (4, True, "Güte und Größe")]
    assert repair_encoding(df.limit(0)).count() == 0


def test_random_sound_lines_are_never_found():
    rng = random.Random(3)
    words = "die größte fenêtre año coração één prüfung naïve cliché señor ação être où ÜBER ÉTAT".split()
    for _ in range(300):
        line = " ".join(rng.choice(words) for _ in range(12))
        assert not repair_text(line)[1], line
