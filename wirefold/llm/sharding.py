"""Placing rows into shards by a hierarchical weighted hash tree.

Shards are the leaves of region -> rack -> shard. For a row every leaf has a draw from a hash of the
row's key and the leaf: an exponential waiting time with the leaf's weight as its rate. A node's
draw is the smallest draw below it, which again is exponential with the sum of the weights below as
rate; a row descends to the child with the smallest draw at every level. So shares follow weights at
every level, and a draw changes only with its own leaf: a new or heavier shard takes rows into
itself alone, a lighter one gives its own rows away, and no subtree whose weights stay exchanges
rows with another one.

The law is ``key``: the key and the leaves decide, whatever else the table holds. Draws are JVM
functions of the row; nothing is shuffled to place a row. Slots number the rows of a shard without
one task per shard: rows are counted by (shard, chunk of the key's hash, part of the chunk by the other
columns), a running sum over these counts gives offsets, and rows are numbered inside their part. Rows
that are equal in all columns are one row with a count there, so no key and no group of copies is hot.

Defined results: a null key is placed like the empty string; a null text has size ``overhead`` and
checksum 0; rows that repeat a key go to one shard and take slots of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.llm.shared import Scratch, fresh

SHARDS, RACK, REGION = 40, 5, 2            # leaves; leaves of a rack; racks of a region
CHUNKS = 1024                              # chunks that a shard is numbered by, and parts of a chunk
BLOCK = 65536                              # equal rows that one task numbers at a time
OVERHEAD = 16                              # bytes a row takes besides its text


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """A regular tree of ``shards`` leaves, filled rack by rack."""
    return [Leaf(s // (RACK * REGION), s // RACK % REGION, s, (weights or {}).get(s, 1.0))
            for s in range(shards)]


def _hash(text: Column) -> Column:
    """52 bits of a hash, as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def draw(key: Column, leaf: Leaf) -> Column:
    """The leaf's waiting time for ``key`` (text)."""
    share = (_hash(F.concat(key, F.lit(f":{leaf.shard}"))) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(share) / F.lit(float(leaf.weight))


def _best(below: list[Column]) -> Column:
    return F.array_min(F.array(*below)) if len(below) > 1 else below[0]


def descend(leaves: list[Leaf], draws: dict[int, Column]) -> Column:
    """struct(draw, id: region, below: struct(draw, id: rack, below: struct(draw, id: shard)))."""
    def node(level: int, some: list[Leaf]) -> Column:
        if level == 2:
            return _best([F.struct(draws[x.shard].alias("draw"), F.lit(x.shard).alias("id"))
                          for x in some])
        name = ("region", "rack")[level]
        below = []
        for value, inside in groupby(some, key=lambda x: getattr(x, name)):
            child = node(level + 1, list(inside))
            below.append(F.struct(child["draw"].alias("draw"), F.lit(value).alias("id"),
                                  child.alias("below")))
        return _best(below)
    return node(0, sorted((x for x in leaves if x.weight > 0),
                          key=lambda x: (x.region, x.rack, x.shard)))


def place(df: DataFrame, leaves: list[Leaf], key: str = "doc_id", shard: str = "shard",
          grown: tuple[str, list[Leaf]] | None = None) -> DataFrame:
    """``df`` with the shard of every row; ``grown`` adds a second column for another tree."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    every = {(x.shard, x.weight): x for x in [*leaves, *(grown[1] if grown else [])] if x.weight > 0}
    order = {k: i for i, k in enumerate(every)}
    held, path, other = (fresh(df, n) for n in ("_draws", "_path", "_other"))
    drawn = df.withColumn(held, F.array(*[draw(text, x) for x in every.values()]))

    def walk(some: list[Leaf]) -> Column:
        return descend(some, {x.shard: F.get(F.col(held), F.lit(order[x.shard, x.weight]))
                              for x in some if x.weight > 0})
    out = drawn.withColumn(path, walk(leaves))
    out = out.withColumn(shard, F.col(path)["below"]["below"]["id"])
    if grown:
        out = out.withColumn(other, walk(grown[1]))
        out = out.withColumn(grown[0], F.col(other)["below"]["below"]["id"]).drop(other)
    return out.drop(held, path)


def with_slots(placed: DataFrame, key: str = "doc_id", shard: str = "shard", slot: str = "slot",
               ties: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """``placed`` with consecutive numbers from 0 inside every shard. ``placed`` is read twice.

    A chunk of keys is split again by a hash of ``ties``, so that rows of one key, or of none, do not meet in one
    task. ``copies`` names a column with the number of equal rows that a row stands for: it takes as many numbers,
    and ``slot`` is the first of them.
    """
    names = [fresh(placed, n) for n in ("_chunk", "_part", "_offset", "_size")]
    chunk, part, offset, size = names

    def text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    many = F.col(f"`{copies}`") if copies else F.lit(1).cast("bigint")
    rows = placed.withColumn(chunk, _hash(text(key)) % CHUNKS).withColumn(
        part, _hash(F.concat_ws(":", *[text(c) for c in ties])) % CHUNKS)
    earlier = (Window.unboundedPreceding, -1)
    # A shard has CHUNKS * CHUNKS parts at most.
    before = Window.partitionBy(shard).orderBy(chunk, part).rowsBetween(*earlier)
    sizes = rows.groupBy(shard, chunk, part).agg(F.sum(many).alias(size))
    offsets = sizes.select(shard, chunk, part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(shard, chunk, part).orderBy(key, *ties).rowsBetween(*earlier)
    return (rows.withColumn(slot, F.coalesce(F.sum(many).over(inside), F.lit(0)))
            .join(offsets, [shard, chunk, part])
            .select(*[F.col(f"`{c}`") for c in placed.columns], (F.col(slot) + F.col(offset)).alias(slot)))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Documents alike in all of these are counted first, wherever they lie, and get their numbers back in blocks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = Scratch(docs.sparkSession, "sharding").save(
        place(alike, tree(shards), grown=("grown_shard", tree(shards + 1))), "placed")
    numbered = with_slots(placed, ties=("size", "text_crc32"), copies="n")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {BLOCK}")))
    blocks = numbered.withColumn("block", block).repartition("doc_id", "size", "text_crc32", "block")
    first, last = F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1
    return blocks.withColumn("i", F.explode(F.sequence(first, last))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") + F.col("i")).cast("bigint").alias("slot"), "grown_shard")


_H = "('0x' || substr(md5({}), 1, 13))::BIGINT"
SQL = f"""
WITH RECURSIVE entry AS (
  SELECT i AS n, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, step + 1
  FROM entry WHERE step < 8),
crc AS (SELECT list(c::BIGINT ORDER BY n) AS t FROM entry WHERE step = 8),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body,
  coalesce(doc_id::VARCHAR, '') AS k FROM documents),
sums AS (SELECT row_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) AS text_crc32
  FROM (SELECT row_id, hex(encode(body)) AS h FROM d), crc),
draws AS (SELECT row_id, k, s, -ln(({_H.format("k || ':' || s")} + 0.5) / 4503599627370496.0) AS w
  FROM d, range({SHARDS + 1}) t(s)),
placed AS (SELECT row_id, arg_min(s, w) FILTER (s < {SHARDS}) AS shard, arg_min(s, w) AS grown_shard
  FROM draws GROUP BY row_id),
sized AS (SELECT doc_id, strlen(body) + {OVERHEAD} AS size, text_crc32, shard, grown_shard,
  {_H.format("k")} % {CHUNKS} AS chunk,
  {_H.format(f"(strlen(body) + {OVERHEAD}) || ':' || text_crc32")} % {CHUNKS} AS part FROM d JOIN sums USING (row_id) JOIN placed USING (row_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY chunk, part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INT AS grown_shard FROM sized"""
