"""Lines that many documents repeat, dropped from all documents but one.

Lines are exploded with their position, normalised to a key (blanks stripped at both ends, A-Z
lower-cased) and hashed to 128 bits; from there on only hashes, ids and positions travel. Three
steps find what to drop:

1. occurrences are counted per hash, summed on the map side first, so a line of a third of all
   documents is one row per task; fewer occurrences than ``documents`` settle nearly all hashes;
2. the occurrences of the remaining hashes, written once, give the exact number of distinct
   documents and the largest id of each;
3. positions to drop are gathered per text and meet the texts by a join, where the lines left are
   put together again in their order.

Joins on a hash that very many lines share are split by Spark's skew handling: their other side has
one row per hash and is read from a written table, as a side that is aggregated in the same stage
could not be split. Only DataFrame functions are used.

Defined results: a null text is empty, and an empty text is one empty line. Rows that repeat an id
are one document, and all of them keep the lines that this document keeps. A row without an id is no
document: it does not count, and it loses every line that is dropped elsewhere. Equal rows get equal
results. An empty table gives no rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.text import let
from wirefold.llm.shared import Scratch, fresh

DOCUMENTS = 5                              # documents that make a line a repeated one
CODE_POINTS = 40                           # of a key; shorter lines are never dropped
BLANKS = " \t\n\x0b\f\r"


def _lower(text: Column) -> Column:
    """A-Z lower-cased. In a text of ASCII alone that is all that ``lower`` changes, at less cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _hashes(*values: Column) -> tuple[Column, Column]:
    """128 bits that stand for the values."""
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def long_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
               code_points: int = CODE_POINTS) -> DataFrame:
    """id, row_a, row_b (the row's hash), pos, line_a, line_b of every line with a long enough key."""
    body = _body(text)
    a, b = _hashes(F.col(f"`{key}`"), body)
    rows = docs.select(F.col(f"`{key}`").alias("id"), a.alias("row_a"), b.alias("row_b"),
                       _lower(body).alias("body"))         # hashed here, so once a row, not once a line
    lines = rows.select("id", "row_a", "row_b", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS)))
    a, b = _hashes(F.col("line"))
    return (keyed.where(F.char_length("line") >= code_points)
            .select("id", "row_a", "row_b", "pos", a.alias("line_a"), b.alias("line_b")))


def positions_to_drop(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      documents: int = DOCUMENTS, code_points: int = CODE_POINTS,
                      scratch: Scratch | None = None) -> DataFrame:
    """row_a, row_b, drop: the positions of the lines that go, for every text that loses any."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    lines = long_lines(docs, key, text, code_points)
    line = ["line_a", "line_b"]
    often = scratch.save(lines.groupBy(*line).agg(F.count(F.lit(1)).alias("n"))
                         .where(F.col("n") >= documents).select(*line), "often", compact=True)
    repeated = scratch.save(lines.join(often, line, "left_semi"), "repeated")
    common = scratch.save(repeated.groupBy(*line)
                          .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
                          .where(F.col("n") >= documents).select(*line, "keeper"), "common", compact=True)
    return (repeated.join(common, line).where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("row_a", "row_b").agg(F.collect_set("pos").alias("drop")))


def without_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         documents: int = DOCUMENTS, code_points: int = CODE_POINTS,
                         n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without the lines that at least ``documents`` documents hold, except in the largest
    id that holds each; ``n_lines`` and ``n_dropped`` count lines before and lines gone."""
    drop = positions_to_drop(docs, key, text, documents, code_points)
    a, b, gone = (fresh(docs, n) for n in ("_row_a", "_row_b", "_drop"))
    drop = drop.select(F.col("row_a").alias(a), F.col("row_b").alias(b), F.col("drop").alias(gone))
    of_row = _hashes(F.col(f"`{key}`"), _body(text))
    joined = docs.withColumns({a: of_row[0], b: of_row[1]}).join(drop, [a, b], "left")
    body, lost = _body(text), F.col(gone)
    left = let(F.split(body, "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost),
        lambda at: F.get(lines, at)), "\n"))
    counted = joined.withColumns({
        n_lines: (F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"))) + 1).cast("bigint"),
        n_dropped: F.coalesce(F.size(lost), F.lit(0)).cast("bigint"),
        text: F.when(lost.isNull(), body).otherwise(left)})
    kept = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    return counted.select(*[F.col(f"`{c}`") for c in kept], n_lines, n_dropped)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return without_common_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {CODE_POINTS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone
  FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
