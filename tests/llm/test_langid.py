import numpy as np
import pytest

from veriloom.llm import langid

WORDS = {
    "en": "the watermark of this picture was found again after heavy compression while another search ran over night".split(),
    "de": "das wasserzeichen wurde nach starker kompression noch einmal gefunden während eine andere suche über nacht lief".split(),
    "fr": "le filigrane de cette image a été retrouvé après une forte compression pendant qu'une autre recherche tournait".split(),
    "es": "la marca de agua de esta imagen fue encontrada otra vez después de una compresión fuerte mientras seguía".split(),
}


def text(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def model():
    rows = [(text(lang, 60, i), lang) for lang in WORDS for i in range(40)]
    return langid.fit([*rows, (text("en", 60, 99), "de")])


def test_held_out_accuracy(model):
    rows = [(text(lang, 25, 1000 + i), lang) for lang in WORDS for i in range(50)]
    right = sum([s[2] for s in model.stretches(t)] == [lang] for t, lang in rows)
    assert right >= 0.98 * len(rows)


def test_stretches_and_short_foreign_parts(model):
    mixed = f"{text('en', 40, 1)} {text('de', 45, 2)} {text('fr', 40, 3)}"
    assert [s[2] for s in model.stretches(mixed)] == ["en", "de", "fr"]
    quoted = f"{text('en', 60, 4)} {text('de', 10, 5)} {text('en', 60, 6)}"
    assert [s[2] for s in model.stretches(quoted)] == ["en"]
    codes = " ".join("a1b2c3d4e5f6" for _ in range(40))
    assert [s[2] for s in model.stretches(f"{text('es', 30, 7)} {codes} 12 0.5 {text('es', 30, 8)}")] == ["es"]
    assert sum(s[1] for s in model.stretches(mixed)) == 125


def test_texts_without_words(model):
    assert model.stretches("") == [] and model.stretches(" 1 2 ... ") == []
    assert len(model.stretches(text("en", 50_000, 9))) == 1


def test_short_parts_are_absorbed():
    e = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 15 + [[0.9, 0.1]] * 30))
    assert langid.segment(e, 20, 5.0) == [(0, 75, 0)]
    e = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 25))
    assert langid.segment(e, 20, 5.0) == [(0, 30, 0), (30, 25, 1)]
    assert langid.segment(e[:39], 20, 5.0) == [(0, 39, 0)]


def test_queries_over_a_table(spark):
    rows = [(i * 10 + j, text(lang, 40, i * 7 + j), label) for i, lang in enumerate(WORDS) for j, label in enumerate([lang] * 30)]
    rows += [(900, text("en", 40, 1), "DE"), (901, text("de", 40, 2), None), (902, text("fr", 40, 3), "fr_FR"), (903, text("es", 40, 4), "Spanish"), (904, f"{text('en', 40, 5)} {text('de', 40, 6)}", "en"), (905, None, None), (906, "", "??"), (907, "12 34", None), (None, text("en", 40, 7), None), (908, text("en", 40, 8), "ENG")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, label string")
    found = langid.relabelled(langid.languages(df), 0.8).collect()
    assert sorted((r.doc_id, r.seg_no, r.text_lang) for r in found if r.doc_id >= 900) == [(900, 1, "en"), (901, 1, "de"), (904, 1, "en"), (904, 2, "de")]
    assert not [r for r in found if r.doc_id < 900]


def test_label_names(spark):
    df = spark.createDataFrame([("EN",), ("en-GB",), ("fra",), ("Portuguese",), ("pt_BR",), (" de ",), ("??",), ("",), (None,), ("und",), ("unknown",), ("n/a",)], "l string")
    assert [r[0] for r in df.select(langid.label_code(df["l"])).collect()] == ["en", "en", "fr", "pt", "pt", "de"] + [None] * 6


def test_nothing_to_train_on(spark):
    with pytest.raises(ValueError, match="no labelled text"):
        langid.fit([])


def test_confidence_is_the_share_of_right_answers(model):
    rows = [(text(lang, 40, 5000 + i), lang) for lang in WORDS for i in range(60)]
    table = langid.reliability(model, rows)
    assert sum(r[2] for r in table) > 500
    assert sum(n * abs(p - right) for _, _, n, p, right in table) / sum(r[2] for r in table) < 0.05


def test_planted_mixtures_by_language(model):
    hit = dict.fromkeys(WORDS, 0)
    for i, a in enumerate(WORDS):
        for b in WORDS:
            if a != b:
                for k in range(5):
                    got = [s[2] for s in model.stretches(f"{text(a, 45, 100 * i + k)} {text(b, 35, 700 + k)}")]
                    hit[a] += got == [a, b]
    assert min(hit.values()) >= 14  # of 15


def test_doubtful_stretches_are_rejected(spark):
    rows = [(i * 10 + j, text(lang, 40, i * 7 + j), lang) for i, lang in enumerate(WORDS) for j in range(30)] + [(900, "qqq", None)]
    found = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.rejected for r in found.where("doc_id < 900").collect()} == {False} and all(r.rejected == (r.confidence < 0.8) for r in found.collect())
