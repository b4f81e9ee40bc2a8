"""A stored keyword index: postings by term, kept in step with its records by signed rows.

A change of a record takes away what its old version counted and adds what the new one counts, so
inserts, updates and deletes are all appends, and a batch that is run again overwrites its own folders only.
Three tables lie under the root of an index, each by ``batch``:

* ``postings(term, id, field, length, tf)`` by ``bucket``, a hash of the term. The length of the whole record is
  in every posting, so a lookup needs no table of all lengths;
* ``terms(term, docs)`` by ``bucket``: how many records hold a term;
* ``totals(docs, words)``.

A lookup sums the signed rows of its own words: Spark prunes the files of all other buckets, and files are sorted by
term, so row groups of other words are skipped too. ``compact`` writes the sums as one batch of a new root.

Records without an id or without words are not indexed. An id stands for one record: ``before`` and ``after``
have one row for it at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.operators.greedy import cut
from wirefold.operators.search import B, FIELDS, K1, MIN_IDF, query_terms, terms, word_counts
from wirefold.streaming.refresh import read_before, write_batch

BUCKETS = 64        # partitions of the terms; one index keeps one number
TERMS = "term string, docs bigint, bucket int"
TOTALS = "docs bigint, words bigint"
POSTING = "term string, id {}, field string, length bigint, tf bigint, bucket int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(term, id, field, length, tf) of docs(id, *fields), counted where the texts lie."""
    words = F.array(*[F.struct(F.lit(f).alias("field"), terms(f).alias("terms")) for f in fields])
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["terms"]))
    return (docs.where("id is not null").select("id", words.alias("parts"))
            .select("id", length.alias("length"), F.explode("parts").alias("p"))
            .select("id", "length", "p.field", F.explode(word_counts(F.col("p.terms"))).alias("w"))
            .select("w.term", "id", "field", "length", "w.tf"))


def _by_bucket(df: DataFrame, root: str, table: str, batch: int) -> None:
    """Rebalanced, so that small buckets share a task and the bucket of a frequent term is split."""
    spread = df.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", F.col("bucket"))
    write_batch(spread.sortWithinPartitions("bucket", "term"), root, table, batch, "bucket")


def _write(signed: DataFrame, root: str, batch: int) -> None:
    """Write signed(term, id, field, length, tf, sign) as one batch."""
    signed = cut(signed, "signed")
    _by_bucket(signed.groupBy("term", "id", "field", "length").agg(F.sum(F.col("tf") * F.col("sign")).alias("tf"))
               .where("tf != 0"), root, "postings", batch)
    held = signed.groupBy("term", "id", "sign").agg(F.max("length").alias("length"))
    _by_bucket(held.groupBy("term").agg(F.sum("sign").cast("bigint").alias("docs")).where("docs != 0"),
               root, "terms", batch)
    each = signed.groupBy("id", "sign").agg(F.max("length").alias("length"))
    write_batch(each.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("docs"),
                         F.coalesce(F.sum(F.col("length") * F.col("sign")), F.lit(0)).alias("words")),
                root, "totals", batch)


def apply_changes(before: DataFrame, after: DataFrame, root: str, batch: int,
                  fields: tuple[str, ...] = FIELDS) -> None:
    """Add one batch: ``before`` and ``after`` hold the old and new versions of the changed records alone.

    A new record is in ``after`` only, a deleted one in ``before`` only.
    """
    sign = F.lit(1)
    _write(counted(after, fields).withColumn("sign", sign)
           .unionByName(counted(before, fields).withColumn("sign", -sign)), root, batch)


def stored(spark: SparkSession, root: str, batches: int, words: list[str] | None = None, id_type: str = "bigint"
           ) -> tuple[DataFrame, DataFrame]:
    """(postings, terms) after the first ``batches`` batches, of ``words`` alone if given. ``id_type``: of the ids."""
    def mine(df: DataFrame) -> DataFrame:
        if words is None:
            return df
        return df.where(F.col("bucket").isin(*[bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words))
    postings = mine(read_before(spark, root, "postings", batches, POSTING.format(id_type)))
    found = mine(read_before(spark, root, "terms", batches, TERMS))
    return (postings.groupBy("term", "id", "field", "length").agg(F.sum("tf").alias("tf")).where("tf != 0"),
            found.groupBy("term").agg(F.sum("docs").alias("docs")).where("docs != 0"))


def totals(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """One row: how many records are indexed, and their words."""
    return read_before(spark, root, "totals", batches, TOTALS).agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def lookup(spark: SparkSession, root: str, query: str, batches: int, limit: int | None = None,
           id_type: str = "bigint") -> DataFrame:
    """(id, score, matched) by BM25 over all fields, best first; a query without words finds nothing."""
    postings, found = stored(spark, root, batches, sorted(set(query_terms(query))), id_type)
    hits = postings.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    # One row, and a row per word of the query.
    size = totals(spark, root, batches).select(F.col("docs").alias("n"), F.try_divide("words", "docs").alias("average"))
    idf = F.greatest(F.log((F.col("n") - F.col("docs") + 0.5) / (F.col("docs") + 0.5)), F.lit(MIN_IDF))
    worth = found.join(F.broadcast(size)).select("term", "average", idf.alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = (hits.join(F.broadcast(worth), "term").groupBy("id")
              .agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("matched"))
              .orderBy(F.col("score").desc(), "id"))
    return scored.limit(limit) if limit else scored


def compact(spark: SparkSession, root: str, batches: int, to: str, id_type: str = "bigint") -> None:
    """The first ``batches`` batches as batch 0 of the index ``to``, without what was taken away."""
    postings, found = stored(spark, root, batches, id_type=id_type)
    _by_bucket(postings, to, "postings", 0)
    _by_bucket(found, to, "terms", 0)
    write_batch(totals(spark, root, batches), to, "totals", 0)
