from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel, Whitespace

from shardloom.functions.text import byte_level_words, bytes_to_text, words, wrap

TEXTS = [
    "",
    "   ",
    "Hello, world!! it's 2021 — naïve café_x",
    "你好,世界。 Straße x y　z\u0085q",
    "a\n\n  b\t c   ",
    "Ⅷ ⓐ १२ é x‍y \U0001F600\U0001F600!",
    "we'll they've I'm 'tis ''s",
    "tab\x0bfeed\x0c\x1cfs",
]


def test_words_match_the_whitespace_pre_tokenizer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", words("t").alias("w")).collect():
        assert r.w == [w for w, _ in Whitespace().pre_tokenize_str(r.t)]


def test_words_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", words("text").alias("w")).collect():
        assert r.w == [w for w, _ in Whitespace().pre_tokenize_str(r.text)]


def test_byte_level_words_match_the_byte_level_pre_tokenizer(spark):
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("text").alias("t"))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").union(docs)
    for r in df.select("t", byte_level_words("t").alias("w")).collect():
        assert r.w == [w for w, _ in split.pre_tokenize_str(r.t)]


def test_byte_level_display_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", bytes_to_text(F.array_join(byte_level_words("t"), "")).alias("back")).collect():
        assert r.back == r.t


def test_wrap_adds_both_marks_even_to_nothing(spark):
    df = spark.createDataFrame([([],), (["a"],)], "t array<string>")
    assert [r.w for r in df.select(wrap("t", "<eos>").alias("w")).collect()] == [["<eos>"] * 2, ["<eos>", "a", "<eos>"]]
