from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from llm_cases import documents, empty, fold, odd_documents, with_clashing
from pyspark.sql import functions as F

from shortfall.llm import lang_filters
from shortfall.llm.queries import language_filters, op9_language_id

SAYS = {
    "en": "the weather was fine and they went out to the garden with their children",
    "de": "das Wetter war schön und sie gingen mit ihren Kindern in den Garten hinaus",
    "el": "ο καιρός ήταν καλός και βγήκαν στον κήπο με τα παιδιά τους",
}


def filters(spark, **settings):
    langs = list(SAYS) * 40
    return lang_filters.fit(documents(spark, [SAYS[x] for x in langs], langs=langs), **settings)


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    spaced = " " + " ".join(letters.split()) + " "
    return [spaced[i : i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " "]


def test_trigrams_equal_plain_ones():
    letters = lang_filters.letter_table()
    for text in ["It's 5 o'clock!", "  ÉTÉ--à la plage ", "x", "𝒳𝒴 𐐷a", "a1b2c3", "日本 語"]:
        codes = lang_filters.trigrams(lang_filters.letters_of(text, letters))
        got = ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in codes.tolist()]
        assert got == plain_grams(text)


def test_filters_name_all_languages_that_have_a_gram(spark):
    model = filters(spark)
    letters = lang_filters.letter_table()
    for i, language in enumerate(model.languages):
        grams = lang_filters.trigrams(lang_filters.letters_of(SAYS[language], letters))
        mask = np.bitwise_and.reduce([model.table[s][:, 0] for s in model.slots(grams)])
        assert ((mask >> np.uint64(i)) & np.uint64(1)).all()  # no filter misses what it was given


def test_false_hits_are_corrected(spark):
    """Random letters are in no language, however full the filters are."""
    model = filters(spark)
    pick = np.random.default_rng(1)
    codes = pick.integers(0x4E00, 0x9FFF, 40_000)
    assert (model.shares(codes) < 0.01).all()


def test_more_than_64_languages():
    grams = {f"l{i:03d}": np.arange(i * 50, i * 50 + 50) for i in range(150)}
    model = lang_filters.make_filters(grams, "l003")
    for i in (0, 63, 64, 149):
        mask = np.bitwise_and.reduce([model.table[s] for s in model.slots(grams[f"l{i:03d}"])])
        assert (mask[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()


def test_predictions_and_odd_rows(spark):
    model = filters(spark)
    docs = documents(spark, ["und das Wetter war schön", "the children went out", "με τα παιδιά", None, "", "12 !", "日本語", "the " * 50_000])
    found = {r["doc_id"]: r for r in lang_filters.predict(with_clashing(docs), model).collect()}
    assert [found[i]["lang_pred"] for i in range(8)] == ["de", "en", "el", "und", "und", "und", model.languages[model.common], "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[3]["score"] == 0
    assert lang_filters.predict(odd_documents(spark), model).count() == odd_documents(spark).count()
    accepted = docs.where(lang_filters.accepts(spark, F.col("text"), model))
    assert sorted(r["doc_id"] for r in accepted.collect()) == [0, 1, 2, 7]


def test_sample_is_bounded_and_whole_table_predicted(spark):
    docs = documents(spark, [SAYS["en"]] * 2000, langs=["en"] * 2000)
    assert filters(spark, per_language=10).languages == ("de", "el", "en")
    assert lang_filters.predict(docs, lang_filters.fit(docs, per_language=100)).where("lang_pred = 'en'").count() == 2000


def test_nothing_to_learn_from(spark):
    model = lang_filters.fit(empty(spark))
    assert rows(lang_filters.predict(empty(spark), model)) == []
    assert {r["lang_pred"] for r in lang_filters.predict(odd_documents(spark), model).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = op9_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    held = found.join(docs, "doc_id").where("held_out").collect()
    assert all(fold(r["doc_id"], 4) == 2 for r in held) and len(held) > 150
    long = [r for r in held if len(r["text"]) >= 40]
    assert sum(r["lang"] == r["lang_pred"] for r in long) >= 0.98 * len(long)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


OTHERS = [
    "Het weer was mooi en zij gingen met hun kinderen naar buiten in de tuin om daar samen te spelen",
    "Il tempo era bello e sono usciti in giardino con i loro bambini per giocare insieme tutto il pomeriggio",
    "Hava güzeldi ve çocuklarıyla birlikte bahçeye çıktılar, bütün öğleden sonra oyun oynadılar",
    "Pogoda była piękna i wyszli z dziećmi do ogrodu, żeby razem bawić się przez całe popołudnie",
]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_unlearned_languages_of_the_same_script_go(spark, folder):
    given = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    test = lang_filters.accepts(spark, F.col("text"), language_filters(given))
    others = documents(spark, OTHERS + [" ".join([x] * 20) for x in OTHERS])
    assert others.where(test).count() == 0
    assert given.where(test).count() == given.count()


def test_a_single_text_sets_no_bar(spark):
    model = lang_filters.fit(documents(spark, [SAYS["en"], SAYS["de"]], langs=["en", "de"]))
    new = documents(spark, ["the children of the garden and the weather of the town"])
    assert new.where(lang_filters.accepts(spark, F.col("text"), model)).count() == 1


def test_decisions_equal_plain_sets(spark):
    """Languages by the share of a text's trigrams that are in a language's set, without filters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    seen, number = {}, {}
    for doc, text, lang in table:
        if fold(doc, 4) != 2 and text is not None and lang is not None:
            number[lang] = number.get(lang, 0) + 1
            for gram in set(plain_grams(text)):
                seen.setdefault(lang, {}).setdefault(gram, 0)
                seen[lang][gram] += 1
    least = {lang: max(2, min(n, lang_filters.PER_LANGUAGE) * lang_filters.MIN_SHARE) for lang, n in number.items()}
    few = {lang for lang, n in number.items() if n < 2 / lang_filters.MIN_SHARE}
    sets = {lang: {g for g, n in grams.items() if n >= least[lang] or lang in few} for lang, grams in seen.items()}
    found = {r["doc_id"]: r for r in op9_language_id(spark, "/root/testdata/sf0.001").collect()}
    judged = 0
    for doc, text, _ in table:
        grams = plain_grams(text or "")
        if not grams:
            assert found[doc]["lang_pred"] == "und"
            continue
        shares = sorted(((sum(g in s for g in grams) / len(grams), lang) for lang, s in sets.items()), reverse=True)
        if shares[0][0] - shares[1][0] > 0.02:  # filters give shares to about a hundredth
            assert found[doc]["lang_pred"] == shares[0][1]
            assert found[doc]["coverage"] == pytest.approx(shares[0][0], abs=0.02)
            judged += 1
    assert judged > 0.9 * len(table)
