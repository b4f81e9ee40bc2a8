"""Order-preserving greedy selection as DataFrame rounds.

Rows have a total order. A row is *kept* unless an earlier kept row matches it.
Run one row at a time this is a loop over the whole table; here every round
settles many rows at once and gives the same answer:

* each row *asks* a few keys and *posts* under a few keys, chosen so that a row
  and any earlier row it matches share at least one asked/posted key;
* a row is ready when no undecided earlier row posts under a key it asks;
* ready rows are kept, and every later row they match is dropped.

Only kept rows are ever compared with others, so a group of n copies costs n
comparisons with one row, never n*n pairs. Per-key state is a map-side-combined
``min``; a hot key is split by AQE because one side of each join holds a handful
of rows for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.session import checkpoint_dir


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage
    ends here, an executor loss costs only a re-read, and the sizes are known."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Keyed = Callable[[DataFrame], DataFrame]


def greedy_keep(
    slots: DataFrame,
    asks: Keyed,
    posts: Keyed,
    match: Callable[[Column, Column, Column], Column],
    fixed: DataFrame | None = None,
) -> DataFrame:
    """The kept rows of ``slots(ord, x)``.

    ``asks`` and ``posts`` turn such a frame into ``(ord, x, key)`` rows; ``asks`` may
    add a column ``hint`` that is passed on to ``match(new, old, hint)``. ``fixed`` holds rows
    that were kept before any of these, in the same shape.
    """
    undecided, fresh, kept = slots, fixed, None
    while True:
        if fresh is not None:
            undecided = _without_matched(undecided, fresh, asks, posts, match)
        heads = posts(undecided).groupBy("key").agg(F.min("ord").alias("head"))
        blocked = (asks(undecided).join(heads, "key").where(F.col("head") < F.col("ord"))
                   .select("ord").distinct().withColumn("blocked", F.lit(True)))
        marked = cut(undecided.join(blocked, "ord", "left"), "greedy")
        fresh = marked.where("blocked is null").drop("blocked")
        kept = fresh if kept is None else kept.unionByName(fresh)
        undecided = marked.where("blocked").drop("blocked")
        if undecided.isEmpty():
            return kept


def greedy_stars(slots: DataFrame, asks: Keyed, posts: Keyed, match,
                 share: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, undecided, hits): the rounds of ``greedy_keep`` as long as each settles ``share``
    of what is left. ``hits(ord, old)`` has the earliest kept row that each dropped row matches.

    A row meets only the kept rows of its keys, and each of them once, so a crowd around one row costs
    one comparison each; what stays undecided are rows that wait for earlier ones they may not match.
    """
    undecided, left, kept, dropped, hits = slots, None, None, slots.limit(0), None
    while True:
        heads = posts(undecided).groupBy("key").agg(F.min("ord").alias("head"))
        blocked = (asks(undecided).join(heads, "key").where(F.col("head") < F.col("ord"))
                   .select("ord").distinct().withColumn("blocked", F.lit(True)))
        marked = cut(undecided.join(blocked, "ord", "left"), "stars")
        fresh, waiting = (marked.where(c).drop("blocked") for c in ("blocked is null", "blocked"))
        hit = cut(earliest_match(dropped.unionByName(waiting), fresh, asks, posts, match), "stars-hit")
        known = hit.select("ord")
        dropped = dropped.unionByName(waiting.join(known, "ord", "left_semi"))
        undecided = cut(waiting.join(known, "ord", "left_anti"), "stars-left")
        kept = fresh if kept is None else kept.unionByName(fresh)
        hits = hit if hits is None else hits.unionByName(hit)
        before, left = left, undecided.count()
        if left == 0 or (before is not None and left > before * (1 - share)):
            return kept, cut(dropped, "stars-dropped"), undecided, hits


def earliest_match(rows: DataFrame, kept: DataFrame, asks: Keyed, posts: Keyed, match) -> DataFrame:
    """(ord, old): the first of the ``kept`` rows before it that a row matches."""
    return earlier_matches(rows, kept, asks, posts, match).groupBy("ord").agg(F.min("old").alias("old"))


def earlier_matches(rows: DataFrame, others: DataFrame, asks: Keyed, posts: Keyed, match) -> DataFrame:
    """(ord, old): rows and the earlier ``others`` they match, once for every key that they share and
    ``match`` accepts."""
    old = posts(others).select("key", F.col("ord").alias("old"), F.col("x").alias("old_x"))
    new = asks(rows)
    hint = F.col("hint") if "hint" in new.columns else F.lit(None)
    return (new.join(old, "key")
            .where((F.col("old") < F.col("ord")) & match(F.col("x"), F.col("old_x"), hint))
            .select("ord", "old"))


def _without_matched(undecided: DataFrame, kept: DataFrame, asks: Keyed, posts: Keyed,
                     match) -> DataFrame:
    dropped = earlier_matches(undecided, kept, asks, posts, match).select("ord").distinct()
    return undecided.join(dropped, "ord", "left_anti")


def by_keys(keys: Callable[[Column], Column]) -> Keyed:
    """asks/posts for keys that are an array computed from ``x`` alone."""
    def run(df: DataFrame) -> DataFrame:
        return df.select("ord", "x", F.explode(keys(F.col("x"))).alias("key"))
    return run


WALK_EDGES = 1_000_000    # edges of one owner that a task walks in one piece


def settled(edges: DataFrame, piece_edges: int = WALK_EDGES) -> DataFrame:
    """(new): the rows dropped when every row is kept unless it matches an earlier kept row.

    ``edges(who, new, old)`` are the matching pairs, ``old`` before ``new``, both structs that begin with ``t`` and
    hold a unique ``id``; pairs lie within one ``who``. An owner's edges are cut into pieces by time, and a
    round walks every piece in order (_walk), so there are as many rounds as pieces that hang on the piece before, not
    as many as rows that match one after the other. What hangs on an open row of an earlier piece, and is
    decided by no other, waits for the next round.
    """
    before = Window.partitionBy("who").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    place = (edges.groupBy("who", (F.floor(F.col("new.t") / 86400) * 86400.0).alias("t"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select("who", "t", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / piece_edges).alias("piece")))
    pieces = F.broadcast(place.groupBy("who", "piece").agg(F.min("t").alias("begin"))
                         .where("piece > 0").groupBy("who").agg(F.sort_array(F.collect_list("begin")).alias("begins")))
    begun = F.size(F.filter(F.coalesce("begins", F.array().cast("array<double>")), lambda b: b <= F.col("new.t")))
    live = cut(edges.join(pieces, "who", "left").select(
        F.struct("who", begun.alias("n")).alias("piece"), "new", "old"), "settled-live")
    dropped = None
    while True:
        open_rows = live.select(F.col("new").alias("old"), F.lit(True).alias("open")).distinct()
        asked = (live.join(open_rows, "old", "left").repartition("piece")
                 .sortWithinPartitions("new", "old")
                 .select(F.col("new.id").alias("new"), F.col("old.id").alias("old"), F.coalesce(
                     "open", F.lit(False)).alias("open")))
        kind = edges.schema["new"].dataType["id"].dataType.simpleString()
        known = cut(asked.mapInArrow(_walk, f"id {kind}, gone boolean"), "settled-hit")
        gone = known.where("gone").select("id")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        live = cut(live.join(known.select(F.col("id").alias("_new")), F.col("new.id") == F.col("_new"), "left_anti")
                   .join(gone.select(F.col("id").alias("_old")), F.col("old.id") == F.col("_old"), "left_anti"),
                   "settled-live")
        if live.isEmpty():
            return edges.select("new").distinct().join(
                dropped.withColumnRenamed("id", "_id"), F.col("new.id") == F.col("_id"), "left_semi")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gone) of the rows that edges(new, old, open), sorted by row, decide. ``open``: the old row is itself
    a new one somewhere; one that is not is kept."""
    gone: dict = {}                       # rows walked here: dropped, kept (False) or not known (None)

    def decided(ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([gone[i] for i in ids], pa.bool_())],
                                          ["id", "gone"])
    now, here, waits, kind = None, False, False, None
    for batch in batches:
        kind, done = batch.schema.field("new").type, []
        for new, old, is_open in zip(*(batch[c].to_pylist() for c in ("new", "old", "open"))):
            if new != now:
                if now is not None:
                    gone[now] = True if here else None if waits else False
                    done.append(now)
                now, here, waits = new, False, False
            state = gone.get(old) if is_open else False
            here, waits = here or state is False, waits or state is None
        yield decided([i for i in done if gone[i] is not None])
    if now is not None and (here or not waits):
        gone[now] = here
        yield decided([now])
