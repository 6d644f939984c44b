"""Letters by code point, and texts in scripts that no learned language is written in."""

import random
import sys

from conftest import words

import corpus_pipeline
from calorant.llm import languages

GREEK = "αυτό είναι ένα κείμενο στα ελληνικά και δεν έχει άλλα γράμματα"


def model_of(spark, n=30):
    rng = random.Random(4)
    rows = [(i, words(rng, 60, "abcdefg" if i % 2 else "hijklmn"), "xx" if i % 2 else "yy", "s", 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df, languages.fit(df)


def test_letters_are_pythons():
    is_letter, *_ = languages.letters()
    assert all(is_letter[c] == chr(c).isalpha() for c in range(sys.maxunicode + 1))


def test_foreign_words_are_no_languages(spark):
    df, model = model_of(spark)
    got = languages.predict([GREEK, "䷀䷁ ䷂", "ힰힱ", GREEK + " " + "abc def " * 40, "abc def gab " * 9, ""], model, True)
    assert got["lang_pred"].tolist()[1] == "und" and got["lang_pred"].tolist()[5] == "und"
    assert got["lang_pred"][0] in ("xx", "yy") and got["score"][0] == 0 and {s["lang"] for s in got["spans"][0]} == {"und"}
    assert got["lang_pred"][2] in ("xx", "yy") and got["score"][2] == 0  # letters of no script that is known
    assert got["lang_pred"][3] == "xx" and 0.5 < got["score"][3] < 1 and [s["lang"] for s in got["spans"][3]] == ["und", "xx"]
    assert got["lang_pred"][4] == "xx" and got["score"][4] == 1


def test_the_pipeline_rejects_foreign_texts(spark, tmp_path):
    df, _ = model_of(spark)
    more = df.union(spark.createDataFrame([(900, GREEK, None, "s", 1), (901, GREEK + " abc", None, "s", 1), (902, "abc gab fed " * 8, None, "s", 1)], df.schema))
    kept = {r.doc_id: r.lang for r in dict(corpus_pipeline.STAGES)["language"](spark, more, str(tmp_path)).collect()}
    assert 900 not in kept and 901 not in kept and kept[902] == "xx" and len(kept) == 31


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(languages, "EACH", 10)
    monkeypatch.setattr(languages, "SAMPLE", 40)
    rng = random.Random(7)
    rows = [(i, words(rng, 30, "abcdefg"), "common", "s", 1) for i in range(400)] + [(1000 + i, words(rng, 30, "qrstuvw"), "rare", "s", 1) for i in range(3)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert model.names == ("common", "rare")
