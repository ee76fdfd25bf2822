import random

from imaging_engine.llm import encodings

DOCS = "doc_id long, text string, lang string, word string"
SENTENCES = [
    "Die Größe der Läsion wäre für Ärzte möglich", "L’été précédent, une élévation décelée à côté", "Патологии не обнаружено в нижней доле лёгкого", "膵尾部に異常を認めない。小脳に変化なし。",
    "Não há alterações, são necessárias novas aquisições", "Żyła główna poszerzona, węzły chłonne niepowiększone", "El riñón izquierdo está según clínica", "now “stable” – the patient’s HU ± 28",
]
RIGHT = ["SÃO, IRMÔ, ÂGE, NOËL", "«Ёлка» и «подъезд»", "½ dose, ¼ time", "see §4.2 ¶3", "├── a │ b", "2√π", "x", "", None, " ", "37 °C ± 2 σ, 5 µm²"]
CHAINS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"),
    ("cp866", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp850"), ("mac-roman", "cp1252"), ("euc-jp", "latin-1"), ("cp932", "cp1252"), ("cp1252", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"),
]


def garble(text, written, read, times=1):
    for _ in range(times):
        data = text.encode(written)
        text = data.decode(read, "replace") if read in encodings.MULTIBYTE else data.decode("latin-1").translate(encodings._byte_table(read, "c1"))
    return text


def corpus():
    docs = [s for s in SENTENCES for _ in range(6)] + RIGHT
    wrong = []
    for written, read in CHAINS:
        for s in SENTENCES:
            try:
                g = garble(s, written, read)
            except UnicodeEncodeError:
                continue
            if g != s:
                wrong.append((g, s))
    wrong += [(garble(s, "utf-8", "cp1252", 2), s) for s in SENTENCES]
    return docs, wrong


def test_found_and_restored(found):
    docs, wrong = corpus()
    rows = [(k, t, "de", "x") for k, t in enumerate(docs)] + [(1000 + k, "Note 7: " + g + " ok", None, None) for k, (g, _) in enumerate(wrong)]
    rows.append(rows[-1])
    got = {r[0] for r in found("p8_found", documents=(DOCS, rows))}
    truth = {1000 + k for k in range(len(wrong))}
    assert not {k for k in got if k < 1000}  # no correct text is a case
    missed = truth - got
    assert len(missed) <= 0.05 * len(truth), [wrong[k - 1000] for k in missed]
    restored = {r[0]: r[1:] for r in found("p8_restored", documents=(DOCS, rows))}
    there = sum(restored[k][0] == "Note 7: " + wrong[k - 1000][1] + " ok" for k in got)
    assert there >= 0.7 * len(truth), there / len(truth)


def test_empty(found):
    assert found("p8_found", documents=(DOCS, [])) == []
    assert found("p8_found", documents=(DOCS, [(1, None, None, None), (None, "Größe", None, None)])) == []


def test_very_long_text(found):
    rows = [(k, "Die Größe ist normal für Läsionen", None, None) for k in range(5)] + [(9, "word " * 100_000 + garble("Größe", "utf-8", "cp1252"), None, None), (10, "x" * 300_000, None, None), (11, "é" * 20_000, None, None)]
    assert found("p8_found", documents=(DOCS, rows)) == [(9,)]


def test_forms_hold_every_chain():
    rng = random.Random(3)
    for word in ("Größe", "лёгкого", "wątroba", "異常", "’", "±"):
        have = encodings.forms(word)
        for written, read in rng.sample(CHAINS, 12):
            try:
                g = garble(word, written, read)
            except UnicodeEncodeError:
                continue
            assert g == word or g.isascii() or g in have, (word, written, read, g)


def test_oddness_prefers_words():
    for word, form in (("Größe", "GrÃ¶ÃŸe"), ("für", "f³r"), ("лёгкого", "ЛЕЦЙНЦН"), ("“aortic", "â€œaortic"), ("Läsion", "L�sion")):
        assert encodings.oddness(word) <= encodings.oddness(form)
    assert all(encodings.oddness(w) == 0 for w in ("SÃO", "Größe", "d’été", "°C", "mm²", "µm", "Żyła", "│"))
