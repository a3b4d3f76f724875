import pytest

from qanat.llm import langid

SAMPLES = {
    "en": ["The teacher reads the book before the lesson starts", "We can ask a question when the answer is not clear", "Write the first line and check it with your friend"],
    "fr": ["Le professeur lit le livre avant que la leçon commence", "Nous pouvons poser une question quand la réponse n'est pas claire", "Écris la première ligne et vérifie avec ton ami"],
    "hi": ["शिक्षक पाठ से पहले किताब पढ़ता है", "जब उत्तर साफ न हो तो हम प्रश्न पूछ सकते हैं"],
    "ar": ["يقرأ المعلم الكتاب قبل أن يبدأ الدرس", "يمكننا أن نسأل عندما لا يكون الجواب واضحا"],
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, lang, x) for i, (lang, x) in enumerate((a, b) for a, c in SAMPLES.items() for b in c)] + [(99, None, "x"), (98, "en", None)], "sample_id int, lang string, text string")


def test_lines_and_documents(spark, samples):
    docs = [
        (1, "EN_ae", "The teacher can ask the question first\n\nLe livre est avant la réponse première\nok"),
        (2, None, "WE CAN READ THE BOOK WITH YOUR FRIEND"),
        (3, "fr-FR", "हम किताब और प्रश्न पूछ सकते हैं\n12 34 5"),
        (4, "und", "المعلم يقرأ الكتاب قبل الدرس"),
        (5, " ", None),
        (6, "en", ""),
        (7, "en", "\n\n"),
        (8, "en", "The book is clear " * 20_000),
        (None, "en", "x"),
    ]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, lang string, text string, language string, words int")
    lines = {(r.doc_id, r.line_no): r for r in langid.line_languages(df, samples).collect()}
    assert {k: v.language for k, v in lines.items() if k[0] and v.words >= 5} == {(1, 0): "en", (1, 1): "fr", (2, 0): "en", (3, 0): "hi", (4, 0): "ar", (8, 0): "en"}
    assert lines[3, 1].words == 0 and lines[3, 1].language is None and lines[3, 1].confidence == 0
    assert {(r.doc_id, r.line_no, r.language) for r in langid.wrong_lines(df, samples).collect()} == {(1, 1, "fr"), (2, 0, "en"), (3, 0, "hi"), (4, 0, "ar")}
    whole = {r.doc_id: r for r in langid.document_languages(df, samples).collect()}
    assert set(whole) == {1, 2, 3, 4, 5, 6, 7, 8} and whole[5].language is None and whole[6].confidence == 0 and whole[8].language == "en" and whole[4].label is None and whole[1].languages >= 2
    assert langid.line_languages(df.where("false"), samples).count() == 0


def test_document_has_the_language_of_most_words_over_mixed_lines(spark, samples):
    mixed = "the teacher reads the book before professeur livre leçon question"
    french = "le professeur lit le livre avant que la leçon commence"
    got = langid.document_languages(spark.createDataFrame([(1, "en", "\n".join([mixed] * 3 + [french]))], "doc_id bigint, lang string, text string"), samples).collect()
    assert [(r.language, r.confidence, r.languages) for r in got] == [("fr", 22 / 40, 2)]


def test_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01/lang_samples.parquet"
    if not os.path.exists(folder):
        pytest.skip("no samples here")
    rows = [(r.lang, r.text) for r in spark.read.parquet(folder).collect()]
    fit = [x for i, x in enumerate(rows) if i % 4]
    test = [x for i, x in enumerate(rows) if not i % 4]
    filters = langid.Filters(fit)
    _, lang, _ = langid.Judge(filters).lines([x for _, x in test])
    right = sum(filters.languages[k] == want for k, (want, _) in zip(lang, test))
    assert right / len(test) >= 0.97


def test_more_languages_than_bits_of_a_byte():
    import string

    samples = [(f"l{k:02}", " ".join(2 * (a + b) for a in string.ascii_lowercase[k : k + 2] for b in "aeiou")) for k in range(0, 24, 2)]
    filters = langid.Filters(samples)
    assert len(filters.languages) == 12
    for k, (lang, text) in enumerate(samples):
        assert filters.evidence(text.split()).sum(axis=0).argmax() == k, lang
