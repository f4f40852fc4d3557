import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom import BpeTokenizer, ByteTokenizer, assign_split, tokenize
from shardloom.functions.splits import hash_bucket
from shardloom.functions.tokenizers import check_token_ids
from shardloom.operators.checks import split_leakage

TEXTS = ["", "a", "ünï\u0000cødé \U0001f600", "line\nbreak\r\n\t", "<|endoftext|> is plain text", *(f"text {i}" for i in range(200))]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.mark.parametrize("buckets", [1, 2, 32, 7, 1000, 1 << 20])
def test_bucket_equals_unsigned_prefix_of_sha256(documents, buckets):
    rows = documents.select("text", hash_bucket(F.col("text"), buckets).alias("bucket")).collect()
    for row in rows:
        expected = int.from_bytes(hashlib.sha256(row.text.encode()).digest()[:8], "big") % buckets
        assert row.bucket == expected


def test_split_follows_bucket_and_copies_stay_together(documents):
    twice = documents.unionAll(documents.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = assign_split(twice).select("text", "split", hash_bucket(F.col("text")).alias("bucket")).collect()
    assert {r.split for r in rows} == {"train", "val"}
    assert all((r.bucket == 0) == (r.split == "val") for r in rows)
    leak = split_leakage(assign_split(twice)).first()
    assert (leak.train_texts + leak.val_texts, leak.shared_texts) == (len(TEXTS), 0)


def test_null_text_is_an_error(spark):
    rows = spark.createDataFrame([(0, None), (1, "x")], "doc_id bigint, text string")
    with pytest.raises(PySparkException, match="text is null"):
        assign_split(rows).collect()
    for tokenizer in (ByteTokenizer(), ByteTokenizer(engine="native"), BpeTokenizer(spark, {b"x": 0})):
        with pytest.raises(PySparkException, match="text is null"):
            tokenize(rows, tokenizer).collect()


def test_val_bucket_must_exist(documents):
    with pytest.raises(ValueError, match="val_bucket"):
        assign_split(documents, num_buckets=4, val_bucket=4)


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_byte_tokens(documents, engine):
    for row, text in zip(tokenize(documents, ByteTokenizer(engine=engine)).orderBy("doc_id").collect(), TEXTS, strict=True):
        assert row.tokens == [50256, *text.encode()]
        assert row.n_tokens == len(row.tokens)
    counts = documents.orderBy("doc_id").select(ByteTokenizer().count(F.col("text")).alias("n")).collect()
    assert [r.n for r in counts] == [len(t.encode()) + 1 for t in TEXTS]


def test_bpe_with_byte_ranks_equals_byte_tokens(spark, documents):
    bpe = BpeTokenizer(spark, {bytes([i]): i for i in range(256)})
    mine = tokenize(documents, bpe).orderBy("doc_id").collect()
    assert mine == tokenize(documents, ByteTokenizer()).orderBy("doc_id").collect()


def test_bpe_merges_by_rank(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b" ab": 258}
    rows = spark.createDataFrame([(0, "abcab ab"), (1, "")], "doc_id bigint, text string")
    first, second = tokenize(rows, BpeTokenizer(spark, ranks, eot=300)).orderBy("doc_id").collect()
    assert first.tokens == [300, 257, 256, 258]
    assert second.tokens == [300]


def test_bpe_from_rank_file(spark, tmp_path):
    import base64

    path = tmp_path / "ranks.tiktoken"
    ranks = [bytes([i]) for i in range(256)] + [b"th"]
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks)))
    rows = spark.createDataFrame([(0, "the")], "doc_id bigint, text string")
    assert tokenize(rows, BpeTokenizer.from_file(spark, str(path))).first().tokens == [50256, 256, ord("e")]


class Foreign:
    """A tokenizer that says nothing about its ids."""

    def __init__(self, token):
        self.token = token

    def tokens(self, text):
        return F.array(F.lit(50256), F.lit(self.token))


def test_ids_of_other_tokenizers_are_checked(documents):
    assert tokenize(documents, Foreign(65535)).first().tokens == [50256, 65535]
    with pytest.raises(PySparkException, match="token id outside"):
        tokenize(documents, Foreign(65536)).collect()


@pytest.mark.parametrize("bad", [65536, -1])
def test_token_ids_must_fit_two_bytes(spark, bad):
    rows = spark.createDataFrame([([0, 65535],), ([1, bad],)], "tokens array<int>")
    with pytest.raises(PySparkException, match="token id outside"):
        rows.select(check_token_ids(F.col("tokens"))).collect()
    with pytest.raises(ValueError, match="token id outside"):
        ByteTokenizer(eot=bad)
