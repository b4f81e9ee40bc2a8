"""Byte-level BPE against the public tokenizer library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers as tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirefold.llm import byte_bpe
from wirefold.llm.byte_bpe import VOCABULARY, encode_batch, vocabulary

PATH = tokenizers.path(VOCABULARY)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PEER = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "b", "'s", "'", "'ll", "'re", "'ve", " ", "  ", "\n", "\t", "1", "23", ".", "!", "é", "日", "😀",
        "\u00a0", "\u2003", "l", "re", "'d", "'m", "\x00", "\x1c", "\x85", "ß", "०", "²", "$", "the", "ing"]


def agree(texts):
    ids, _, counts = encode_batch(texts, vocabulary(PATH))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == PEER.encode_ordinary(text), text
        at += n


def test_random_texts_encode_like_the_library():
    rnd = random.Random(4)
    agree(["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(4000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_texts_encode_like_the_library(texts):
    agree([t.encode("utf-8", "ignore").decode() for t in texts])


def test_long_pieces():
    agree(["a" * 20_000, "ab" * 9_000, " " * 5_000, "!" * 3_000 + "x", "", "word " * 30_000])


def test_small_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "GENERATION", 3)
    book = byte_bpe.Vocabulary(PATH)
    text = "one two three four five six one two three four"
    assert encode_batch([text], book)[0].tolist() == PEER.encode_ordinary(text)


def test_query_columns_and_edges(spark):
    texts = [None, "", "Hello, wörld's end", "Hello, wörld's end", " \n x " * 3000]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, IDS string").withColumnRenamed("IDS", "_encoded")
    coded = byte_bpe.encode(docs)
    assert coded.columns == ["doc_id", "text", "_encoded", "ids", "offsets"]
    got = {r["doc_id"]: r for r in byte_bpe.digest(coded).collect()}
    for i, text in enumerate(texts):
        ids = PEER.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_a_slice_decodes_that_stretch(spark):
    docs = spark.createDataFrame([(1, "naïve café 123 done")], "doc_id bigint, text string")
    part = byte_bpe.encode(docs).select(byte_bpe.decoded(
        F.slice("ids", 2, 3), F.slice("offsets", 2, 3)).alias("b"),
        F.col("offsets")[1].alias("a"), F.col("offsets")[4].alias("z")).first()
    assert bytes(part["b"]) == "naïve café 123 done".encode()[part["a"]:part["z"]]


def test_unknown_and_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([([999_999],), (None,), ([],), ([40],)], "ids array<int>")
    got = rows.select(byte_bpe.decoded(F.col("ids"), F.transform("ids", lambda i: F.lit(0))).alias("b"))
    assert [None if r["b"] is None else bytes(r["b"]) for r in got.collect()] == [None, None, b"", b"I"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert byte_bpe.digest(byte_bpe.encode(docs)).count() == 0
