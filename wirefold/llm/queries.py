"""The training-data operators over their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wirefold.llm import (byte_bpe, decontam, gam, line_dedup, odd_sketch, periods, pii, prefix_trie, sharding,
                          topk, toxicity, url_filter, wrappers)
from wirefold.llm.shared import settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(read)``; ``read`` opens a table of the folder by name."""
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            settings(spark)
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


@query()
def op1_boosted_urls(read) -> DataFrame:
    return url_filter.digest(read("pages").select("page_id", "url"))


@query()
def op2_wrappers(read) -> DataFrame:
    return wrappers.digest(read("pages").select("page_id", "url", "html"))


@query()
def op3_odd_sketch(read) -> DataFrame:
    return odd_sketch.near_groups(read("documents").select("doc_id", "text"))


@query()
def op4_additive_model(read) -> DataFrame:
    return gam.digest(read("documents").select("doc_id", "text"), read("labels"))


@query()
def op5_lexicon(read) -> DataFrame:
    return toxicity.digest(read("documents").select("doc_id", "text"), read("labels"))


@query(topk.SQL)
def op6_sorted_lists(read) -> DataFrame:
    vectors = read("embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


@query(sharding.SQL)
def op7_hash_tree(read) -> DataFrame:
    return sharding.digest(read("documents").select("doc_id", "text"))


@query(decontam.SQL)
def op8_spaced_seeds(read) -> DataFrame:
    return decontam.leaks(read("documents").select("doc_id", "text"), read("benchmark"))


@query(pii.SQL)
def op9_pii(read) -> DataFrame:
    return pii.digest(pii.find(read("documents").select("doc_id", "text")))


@query()
def op10_byte_bpe(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text")
    return byte_bpe.digest(byte_bpe.encode(docs))


@query(line_dedup.SQL)
def op11_line_dedup(read) -> DataFrame:
    return line_dedup.digest(read("documents").select("doc_id", "text"))


@query(prefix_trie.SQL)
def op12_turn_matrices(read) -> DataFrame:
    return prefix_trie.digest(read("conversations").select("conv_id", "turn", "role", "text"))


@query()
def op13_block_convolution(read) -> DataFrame:
    return periods.digest(read("documents").select("doc_id", "text"))
