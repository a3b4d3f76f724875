from pyspark.sql import functions as F

from qanat.functions import hashing, patterns, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).collect()[0].y


def test_tokens(spark):
    assert one(spark, "Straße’s x_y don't-go", text.tokens) == ["strasse's", "x", "y", "don't-go"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, "' - --a-'b", text.tokens) == ["a", "b"]


def test_nfkc(spark):
    assert one(spark, "ﬁＡ", text.nfkc) == "fiA"
    assert one(spark, None, text.nfkc) is None


def test_ngrams_need_enough_words(spark):
    assert one(spark, "a b", lambda c: text.ngrams(text.tokens(c), 3)) == []
    assert one(spark, "a b c d", lambda c: text.ngrams(text.tokens(c), 3)) == ["a b c", "b c d"]


def test_filter_after_let_keeps_results(spark):
    df = spark.createDataFrame([("a b c d e f",)], "x string").withColumn("g", text.ngrams(text.tokens(F.col("x")), 5)).where(F.size("g") > 1)
    assert df.collect()[0].g == ["a b c d e", "b c d e f"]


def test_stripped_lines(spark):
    assert one(spark, "  a \r\n b\t\r c  ", text.stripped_lines) == "a\n b\n c"


def test_excerpt_and_sentences(spark):
    assert one(spark, " a  b ", text.excerpt) == "a b"
    assert len(one(spark, "x" * 300, text.excerpt)) == 220
    assert one(spark, "One. Two!  \n\nThree?", text.sentences) == ["One.", "Two!", "Three?"]


def test_fenced_json(spark):
    assert one(spark, '```json\n{"a": 1}\n```', text.fenced_json) == '{"a": 1}'
    assert one(spark, 'so: {"a": 1} done', text.fenced_json) == '{"a": 1}'
    assert one(spark, "none", text.fenced_json) is None


def test_urls_and_times(spark):
    assert one(spark, "https://a.b/c", text.valid_url) and not one(spark, "ftp://a", text.valid_url) and not one(spark, None, text.valid_url)
    assert one(spark, "2026-01-02T03:04:05Z", text.iso_time) and not one(spark, "2026-01-02", text.iso_time)


def test_stable_number_is_unsigned(spark):
    import hashlib

    for key in ("a", "b", "c", "d"):
        want = int.from_bytes(hashlib.sha256(f"s:{key}".encode()).digest()[:8], "big")
        assert int(one(spark, key, lambda c: hashing.stable_number("s", c))) == want
        assert one(spark, key, lambda c: hashing.stable_choice("s", c, 7)) == want % 7


def test_conversation_hash(spark):
    import hashlib
    import json

    messages = [("system", 'a "q" \n é/'), ("user", "")]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    want = hashlib.sha256(json.dumps([{"role": r, "content": c} for r, c in messages], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert df.select(hashing.conversation_hash(F.col("m")).alias("h")).collect()[0].h == want


def test_secrets(spark):
    assert one(spark, "hf_" + "a" * 24, patterns.labels) == ["Hugging Face token"]
    assert one(spark, "sk-" + "a" * 24, patterns.labels) == ["OpenAI-style API key"]
    assert one(spark, "OPENAI_API_KEY=paste-your-key-here", patterns.labels) == []


def test_restricted_paths(spark):
    for path in ("data/internal.jsonl", "outputs/judge.json", "research/scraped/caption.txt", ".env", "adapter_model.safetensors"):
        assert one(spark, path, patterns.restricted_reason), path
    for path in (".env.example", "submission/model/README.md"):
        assert one(spark, path, patterns.restricted_reason) is None, path


def test_assistant_patterns(spark):
    got = one(spark, "You are stupid. Here is the completed essay: answer key: 1", patterns.flags)
    assert [x.code for x in got] == ["humiliation_or_contempt_signal", "cheating_or_answer_leakage_signal"]
    assert got[0].evidence == "You are stupid"


def test_ngram_hashes(spark):
    """Equal runs of words and only those have equal hashes, for any length."""
    w = [f"w{k % 7}" for k in range(40)] + [f"x{k * k % 11}" for k in range(40)]
    df = spark.createDataFrame([(w,)], "w array<string>")
    for n in (1, 2, 3, 5, 8, 12, 16, 80, 81):
        got = df.select(text.ngram_hashes(F.col("w"), n).alias("g")).collect()[0].g
        want = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))
