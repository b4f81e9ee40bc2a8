"""The prefix trie of conversations: what a cache of shared prefixes would hold and save.

A node of depth d stands for one sequence of d turns; its members are the conversations that start
with it. A turn is known by a 128-bit number, the MD5 of its role and text, so texts leave no task.

Conversations are range-partitioned and sorted by the sequence of their turn numbers, then by id;
a node's members are then neighbours, equal conversations too, and a crowd of copies spreads over
as many shards as it fills. Every shard puts its conversations into padded matrices of turn numbers,
``COLUMNS`` turns at a time and only those that are long enough: a lexsort orders them, column
changes OR-accumulated along a row tell how many first turns it shares with the row before, which is
where nodes start, and reduceat aggregates every depth. No figure needs a walk over the trie: with x
the bytes that a row shares with the one before, the tokens saved below a node of n members and
depth d are the sum of x over all members but the first, less (n - 1) times the bytes above the
node; its leaves are the members that the next row does not continue.

Nodes that hold the first or the last row of a shard may go on in the next one. Only these are added
up across shards, by depth and a hash of their turns, with corrections for every seam between two
shards (what the two rows at the seam share is one node, not two). The ids of conversations that end
in such a node travel as blocks of text and are hashed in one stream.

What is held at once: the turn numbers and sizes of a shard, some 60 bytes a turn. Shards have equal
numbers of conversations and ``SHARD`` turns on average, at least one conversation. A conversation
is one row of 20 bytes a turn, so it may have up to 2**26 turns. The seams are one row per shard.

Defined results: a null role or text is empty; a null turn comes first; turns of one number are
ordered by the MD5 above; repeated rows are turns of their own. Rows without a conversation id
belong to no conversation. Other columns do not matter. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.llm.shared import Scratch

SHARD = 1 << 18                            # turns that a shard holds, about
COLUMNS = 16                               # turns that one padded matrix is wide
IDS = 4096                                 # ids in one block of text
HEADS, FAMILY = 9, 5                       # heads are below 9 turns; one conversation in 5 lends its head

NODES = """kind string, depth bigint, node binary, parent binary, conv_id bigint, parent_conv_id bigint,
 n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, above bigint, ends_sha256 string,
 first_seq binary, first_sizes binary, last_seq binary, last_id bigint, ids string"""
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), turn_id (16 bytes), size of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"))).alias("turn_id"),
        F.octet_length(text).alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return known.select("conv_id", (F.row_number().over(order) - 1).alias("at"), "turn_id", "size")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq (the turn numbers, 16 bytes each), sizes (4 bytes each, big-endian)."""
    packed = F.array_sort(F.collect_list(F.struct("at", "turn_id", "size")))
    rows = turns.groupBy("conv_id").agg(packed.alias("turns"))
    # array_join is for strings: bytes are joined as hexadecimal digits, sizes as eight of them
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["turn_id"])), ""))
    sizes = F.unhex(F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["size"]), 8, "0")), ""))
    return rows.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


def with_lent_heads(rows: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 5, then its own turns
    after its first h, where h is the CRC-32 of c's decimal digits modulo 9. An absent conversation
    lends nothing."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    lenders = rows.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("lender"), F.substring("seq", 1, 16 * HEADS).alias("head"),
        F.substring("sizes", 1, 4 * HEADS).alias("head_sizes"))
    both = (rows.withColumn("lender", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h)
            .join(lenders, "lender", "left"))

    def rebuilt(own: str, head: str, width: int) -> Column:
        lent = F.substring(F.coalesce(F.col(head), F.lit(b"")), F.lit(1), F.col("h") * width)
        return F.concat(lent, F.substring(own, F.col("h") * width + 1, F.octet_length(own)))
    return both.select("conv_id", rebuilt("seq", "head", 16).alias("seq"),
                       rebuilt("sizes", "head_sizes", 4).alias("sizes"))


def path_of(seq: bytes) -> list[bytes]:
    """The key of every prefix of a sequence, the empty one first."""
    digest, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(seq), 16):
        digest.update(seq[at:at + 16])
        out.append(digest.digest())
    return out


@dataclass
class Rows:
    """Conversations in order: ids, lengths, turns as one array with offsets."""
    ids: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    turns: np.ndarray                      # numbers from 1, in the order of the 16 bytes
    bytes_to: np.ndarray                   # running sum of the sizes of all turns

    def matrix(self, rows: np.ndarray, first: int) -> np.ndarray:
        """Turns ``first`` and on of ``rows``, padded with 0."""
        at = first + np.arange(COLUMNS)
        inside = at < self.lengths[rows, None]
        place = np.where(inside, self.offsets[rows, None] + at, 0)
        return np.where(inside, self.turns[place], 0) if len(self.turns) else np.zeros(inside.shape, np.int64)

    def size_of(self, rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Bytes of the first ``depth`` turns of ``rows``."""
        return self.bytes_to[self.offsets[rows] + depth] - self.bytes_to[self.offsets[rows]]


def _numbers(seqs: list[bytes]) -> np.ndarray:
    """A number from 1 for every turn, in the order of its bytes."""
    raw = np.frombuffer(b"".join(seqs), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(raw), np.int64)
    new[1:] = (raw[order[1:]] != raw[order[:-1]]).any(axis=1)
    out = np.empty(len(raw), np.int64)
    out[order] = np.cumsum(new)
    return out


def ordered(rows: Rows) -> np.ndarray:
    """The order of the conversations by their turns (a prefix first), then by id: blocks of columns
    refine the ranks of the rows that go on."""
    rank = np.zeros(len(rows.ids), np.int64)                 # rows before the row's group
    first, live = 0, np.flatnonzero(rows.lengths > 0)
    rank[live] = len(rank) - len(live)                       # what has ended comes before what goes on
    while len(live):
        held = rows.matrix(live, first)
        order = np.lexsort((*held.T[::-1], rank[live]))
        live, held = live[order], held[order]
        old = np.append(True, rank[live[1:]] != rank[live[:-1]])
        new = old | np.append(True, (held[1:] != held[:-1]).any(axis=1))
        place = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new, place, 0))
        group = np.maximum.accumulate(np.where(old, place, 0))
        ended = rows.lengths[live] <= first + COLUMNS
        stops = np.add.reduceat(ended.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        rank[live] = rank[live] + start - group + np.where(ended, 0, stops)
        live, first = live[~ended], first + COLUMNS
    return np.lexsort((rows.ids, rank))


def shared_turns(rows: Rows, order: np.ndarray) -> np.ndarray:
    """How many first turns every row of ``order`` shares with the row before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    least = np.minimum(rows.lengths[order[1:]], rows.lengths[order[:-1]])
    live, first = np.flatnonzero(least > 0) + 1, 0
    while len(live):
        changed = rows.matrix(order[live], first) != rows.matrix(order[live - 1], first)
        equal = (~np.logical_or.accumulate(changed, axis=1)).sum(axis=1)
        out[live] += equal
        first += COLUMNS
        live = live[(equal == COLUMNS) & (least[live - 1] > first)]
    out[1:] = np.minimum(out[1:], least)
    return out


def _sorted(batch: pa.Table) -> tuple[Rows, np.ndarray, list[bytes], list[bytes]]:
    seqs, sizes = batch.column("seq").to_pylist(), batch.column("sizes").to_pylist()
    lengths = np.array([len(s) // 16 for s in seqs], np.int64)
    size = np.frombuffer(b"".join(sizes), ">u4").astype(np.int64)
    rows = Rows(batch.column("conv_id").to_numpy(), lengths, np.cumsum(lengths) - lengths, _numbers(seqs),
                np.concatenate([[0], np.cumsum(size)]))
    return rows, ordered(rows), seqs, sizes


def nodes_of(batch: pa.Table) -> Iterator[dict]:
    """Columns of the nodes of one shard: whole nodes, parts of nodes at its rims, blocks of the ids
    that end in those, and one row for the seam to the next shard."""
    rows, order, seqs, sizes = _sorted(batch)
    n, ids, lengths = len(order), rows.ids[order], rows.lengths[order]
    shared = shared_turns(rows, order)
    gained = rows.size_of(order, shared)                     # bytes shared with the row before
    gained[0] = 0
    leaf = np.append(shared[1:] < lengths[:-1], True).astype(np.int64)
    first, last = order[0], order[-1]
    paths = path_of(seqs[first]), path_of(seqs[last])
    yield {"kind": ["seam"], "conv_id": [int(ids[0])], "first_seq": [seqs[first]], "first_sizes": [sizes[first]],
           "last_seq": [seqs[last]], "last_id": [int(ids[-1])]}
    here, above = np.arange(n), None                         # rows that reach this depth
    for depth in range(int(lengths.max()) + 1):
        here = here[lengths[here] >= depth]
        starts = np.flatnonzero((shared[here] < depth) | (here == 0)) if depth else np.zeros(1, np.int64)
        head = here[starts]
        stop = np.append(starts[1:], len(here))
        tail = here[stop - 1]
        members = stop - starts
        over = rows.size_of(order[head], depth - 1) if depth else np.zeros(1, np.int64)
        saved = np.add.reduceat(gained[here], starts) - gained[head] - (members - 1) * over
        more = (lengths[here] > depth) & (shared[here] <= depth)         # first rows of children
        smallest = np.minimum.reduceat(ids[here], starts)
        parent = np.searchsorted(above["head"], head, "right") - 1 if depth else None
        rim = (head == 0) | (tail == n - 1)
        rim_key = [paths[0][depth] if a == 0 else paths[1][depth] if b == n - 1 else None
                   for a, b in zip(head.tolist(), tail.tolist())]
        ends = lengths[here] == depth
        n_ends = np.add.reduceat(ends.astype(np.int64), starts)          # the first rows of the node
        texts = [",".join(map(str, ids[a:a + k].tolist())) if k and not r else ""
                 for a, k, r in zip(head.tolist(), n_ends.tolist(), rim.tolist())]
        up_rim = above["rim"][parent] if depth else np.zeros(1, bool)
        yield {"kind": np.where(rim, "rim", "node").tolist(), "depth": [depth] * len(head), "node": rim_key,
               "parent": [above["key"][p] if depth else None for p in (parent.tolist() if depth else [0])],
               "conv_id": smallest,
               "parent_conv_id": pa.array(above["conv_id"][parent], mask=up_rim) if depth else [None],
               "n_convs": members, "n_children": np.add.reduceat(more.astype(np.int64), starts),
               "n_leaves": np.add.reduceat(leaf[here], starts), "saved_tokens": saved, "above": over,
               "ends_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else EMPTY_SHA for t in texts]}
        for at in np.flatnonzero(rim & (n_ends > 0)).tolist():
            for block in range(int(head[at]), int(head[at] + n_ends[at]), IDS):
                part = ids[block:min(block + IDS, int(head[at] + n_ends[at]))]
                yield {"kind": ["ids"], "depth": [depth], "node": [rim_key[at]], "conv_id": [int(part[0])],
                       "ids": [",".join(map(str, part.tolist()))]}
        above = {"head": head, "key": rim_key, "rim": rim, "conv_id": smallest}


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in
                      (field.split() for field in NODES.replace("\n", " ").split(","))])


def _filled(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema],
        schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        schema = _schema()
        for columns in nodes_of(pa.Table.from_batches(held)):
            yield _filled(columns, schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for what the last conversation of a shard and the first of the next share."""
    schema = _schema()
    for batch in batches:
        for seam in batch.to_pylist():
            before, after = seam["before"], seam["first_seq"]
            shared, least = 0, min(len(before), len(after)) // 16
            while shared < least and before[16 * shared:16 * shared + 16] == after[16 * shared:16 * shared + 16]:
                shared += 1
            reach = np.cumsum(np.concatenate([[0], np.frombuffer(seam["first_sizes"], ">u4")]).astype(np.int64))
            depth = np.arange(shared + 1)
            saved = reach[shared] - reach[np.maximum(depth - 1, 0)]
            yield _filled({"kind": ["rim"] * (shared + 1), "depth": depth, "node": path_of(after[:16 * shared]),
                           "n_convs": np.zeros(shared + 1, np.int64),
                           "n_children": -(depth < shared).astype(np.int64),
                           "n_leaves": np.full(shared + 1, -int(shared == len(before) // 16)),
                           "saved_tokens": saved}, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, depth, ends_sha256 from blocks of ids in order: one running hash at a time."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([key[0]], pa.binary()), "depth": [key[1]],
                                           "ends_sha256": [digest.hexdigest()]})
    for batch in batches:
        for row in batch.to_pylist():
            if (row["node"], row["depth"]) != key:
                if key:
                    yield done()
                key, digest = (row["node"], row["depth"]), hashlib.sha256()
                digest.update(row["ids"].encode())
            else:
                digest.update(b"," + row["ids"].encode())
    if key:
        yield done()


def trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, seq, sizes), as the module says."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    rows = scratch.save(rows, "rows")
    turns = rows.agg(F.sum(F.octet_length("seq") / 16 + 1)).first()[0] or 0
    parts = max(1, -(-int(turns) // shard))
    found = scratch.save(rows.repartitionByRange(parts, "seq", "conv_id").mapInArrow(_shards, NODES), "found")
    # one row per shard: its last conversation beside the first one of the next shard that has any
    seam = Window.orderBy("first_seq", "conv_id")
    seams = (found.where("kind = 'seam'").withColumn("before", F.lag("last_seq").over(seam))
             .where("before IS NOT NULL").select("before", "first_seq", "first_sizes"))
    rims = (found.where("kind = 'rim'").unionByName(seams.mapInArrow(_seams, NODES))
            .groupBy("depth", "node").agg(
                F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
                *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    hashed = (found.where("kind = 'ids'").select("node", "depth", "conv_id", "ids")
              .repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
              .mapInArrow(_hashed, "node binary, depth bigint, ends_sha256 string"))
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    rims = scratch.save(rims.join(hashed, ["node", "depth"], "left").select(
        "depth", "node", "parent", "conv_id", *figures,
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")), "rims")
    inner = found.where("kind = 'node'").select("depth", "parent", "conv_id", "parent_conv_id", *figures, "ends_sha256")
    every = inner.unionByName(rims.drop("node"), allowMissingColumns=True)
    above = rims.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"),
                        F.col("conv_id").alias("above"))
    return every.join(above, ["depth", "parent"], "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), *figures, "ends_sha256")


def digest(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of all conversations with lent heads."""
    return trie(with_lent_heads(sequences(turns_of(conversations))), shard)


SQL = f"""
WITH RECURSIVE entry AS (
  SELECT i AS n, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, step + 1
  FROM entry WHERE step < 8),
crc AS (SELECT list(c::BIGINT ORDER BY n) AS t FROM entry WHERE step = 8),
own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, ts, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, (i + 1)::INT, 1))::BIGINT)),
    lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) % {HEADS} AS h FROM own, crc),
built AS (SELECT x.c, list_concat(coalesce(y.ts[1:x.h], []), x.ts[x.h + 1:]) AS ts
  FROM heads x LEFT JOIN own y ON y.c = x.c - x.c % {FAMILY}),
steps AS (SELECT c, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM built),
members AS (SELECT c, n, depth, ts[1:depth] AS prefix FROM steps),
nodes AS (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(prefix[depth].text) ELSE 0 END AS saved
  FROM members GROUP BY depth, prefix),
up AS (SELECT *, CASE WHEN depth > 0 THEN prefix[1:depth - 1] END AS parent FROM nodes),
children AS (SELECT parent, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent),
full_up AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN children k ON k.parent = u.prefix),
spread AS (SELECT unnest(range(depth + 1)) AS above, prefix, saved, n_children FROM full_up),
below AS (SELECT prefix[1:above] AS prefix, sum(saved)::BIGINT AS saved_tokens,
    count(*) FILTER (n_children = 0) AS n_leaves FROM spread GROUP BY 1)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, b.n_leaves, b.saved_tokens,
  u.ends_sha256
FROM full_up u JOIN below b ON b.prefix = u.prefix LEFT JOIN nodes p ON p.prefix = u.parent"""
