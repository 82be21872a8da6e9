"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of a fixed number of turns, each a row with one column a
position. One ROLLUP over these columns counts all prefixes of all blocks together;
grouping_id tells how many positions a row stands for. A block's key is the node before it,
which follows from the turns alone: digests of whole blocks are combined over distances that
double, so a conversation of n turns costs log n joins on unique keys, and no task ever holds
a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch

#: Turns of a block, which are the columns of the ROLLUP.
WIDTH = 8
#: Turns of near numbers that are put in order together.
NEAR_TURNS = 10
#: Ids that are packed into one piece before those of a node meet.
PIECE = 2048
ROOT = "root"


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 32)


def _turn(role_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Role, text and their turn id: a digest of both and the text's UTF-8 bytes; nulls count as empty."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return role, text, F.concat_ws("-", F.substring(F.sha2(both, 256), 1, 32), F.octet_length(text).cast("string"))


def turn_ids(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, tid) of the turns that have a conversation; only the digests move on, not the texts."""
    return df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), _turn(role_col, text_col)[2].alias("tid"))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, tid) with positions from 1 by turn, null first, then by tid.

    Turns of near numbers are ordered together and counts of what comes before are added, so
    that a long conversation is ordered by many tasks.
    """
    part = F.coalesce(F.shiftright(F.col("turn").cast("long"), NEAR_TURNS), F.lit(-(1 << 60)))
    turns = turns.withColumn("part", part)
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "tid"))
    return turns.withColumn("k", within).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("k")).alias("pos"), "tid")


def _scan(values: DataFrame, combine: Callable[[Column, Column], Column], scratch: Scratch, name: str) -> DataFrame:
    """(conv_id, block, v): ``v`` of each block combined with those of all blocks before it; a conversation's blocks have no holes."""
    held = scratch.table(values.select("conv_id", "block", "v"), f"{name}-0")
    least, most = held.agg(F.min("block"), F.max("block")).first()
    step = 1
    while most is not None and step <= most - least:
        before = held.select("conv_id", (F.col("block") + step).alias("block"), F.col("v").alias("w"))
        v = F.when(F.col("w").isNull(), F.col("v")).otherwise(combine(F.col("w"), F.col("v"))).alias("v")
        held = scratch.table(held.join(before, ["conv_id", "block"], "left").select("conv_id", "block", v), f"{name}-{step}")
        step *= 2
    return held


def _blocks(turns: DataFrame, convs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(conv_id, block, key, full, n, t1...): the turns of each block by position.

    ``key`` is the node before the block, ``full`` the node of the block's last column where
    all columns are told, ``n`` the conversation's turns. A conversation without turns has an
    empty block 0.
    """
    places = turns.select("conv_id", F.floor((F.col("pos") - 1) / width).cast("long").alias("block"), ((F.col("pos") - 1) % width).cast("int").alias("slot"), "tid")
    rows = places.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("slot"), F.lit(None).cast("string").alias("tid")))
    cells = [F.max(F.when(F.col("slot") == i, F.col("tid"))).alias(f"t{i + 1}") for i in range(width)]
    wide = scratch.table(rows.groupBy("conv_id", "block").agg(*cells), "cells").join(convs.select("conv_id", "n"), "conv_id")
    columns = [f"t{i + 1}" for i in range(width)]
    own = F.when(F.col(columns[-1]).isNotNull(), _digest(F.lit(ROOT), *columns))
    short = wide.where(F.col("n") <= width).withColumn("key", F.lit(ROOT)).withColumn("full", own)
    long = scratch.table(wide.where(F.col("n") > width).withColumn("v", own), "long")
    done = _scan(long.where("v is not null"), _digest, scratch, "keys")
    key = done.select("conv_id", (F.col("block") + 1).alias("block"), F.col("v").alias("key"))
    long = long.drop("v").join(key, ["conv_id", "block"], "left").join(done.withColumnRenamed("v", "full"), ["conv_id", "block"], "left").na.fill(ROOT, ["key"])
    out = ["conv_id", "block", "key", "full", "n", *columns]
    return scratch.table(short.select(*out).unionByName(long.select(*out)), "blocks")


def _rolled(blocks: DataFrame, width: int, *figures: str) -> DataFrame:
    """(node, parent, depth, tid, figures) of every prefix: one ROLLUP over all blocks."""
    columns = [f"t{i + 1}" for i in range(width)]
    rolled = blocks.sparkSession.sql(
        f"SELECT block, key, {', '.join(columns)}, grouping_id() AS gid, min(full) AS full, {', '.join(figures)} FROM {{blocks}} GROUP BY block, key, ROLLUP ({', '.join(columns)})", blocks=blocks
    )
    # grouping_id has a bit for each column that is rolled up
    level = F.lit(width) - F.bit_count("gid")
    rolled = rolled.withColumn("level", level.cast("int"))
    node = F.when(F.col("level") == 0, F.col("key")).when(F.col("level") == width, F.col("full"))
    parent, tid = F.when(F.col("level") == 1, F.col("key")), F.lit(None).cast("string")
    for i in range(1, width + 1):
        mine = _digest(F.col("key"), *columns[:i])
        node = node if i == width else node.when(F.col("level") == i, mine)
        parent = parent if i == width else parent.when(F.col("level") == i + 1, mine)
        tid = F.when(F.col("level") == i, F.col(columns[i - 1])).otherwise(tid)
    rolled = rolled.withColumn("tid", tid).where(((F.col("level") == 0) & (F.col("block") == 0)) | ((F.col("level") > 0) & F.col("tid").isNotNull()))
    named = [c for c in rolled.columns if c not in {"block", "key", "gid", "full", "level", "tid", *columns}]
    return rolled.select(node.alias("node"), parent.alias("parent"), (F.col("block") * width + F.col("level")).alias("depth"), "tid", *named)


def _end_nodes(blocks: DataFrame, width: int) -> DataFrame:
    """(node, conv_id): where each conversation ends."""
    columns = [f"t{i + 1}" for i in range(width)]
    slot = F.col("n") - F.col("block") * width
    node = F.when(slot == 0, F.col("key")).when(slot == width, F.col("full"))
    for i in range(1, width):
        node = node.when(slot == i, _digest(F.col("key"), *columns[:i]))
    return blocks.where(slot.between(1, width) | (F.col("n") == 0)).select(node.alias("node"), "conv_id")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) of sorted (node, conv_id): ids of a node packed into texts."""
    node, ids, out = None, [], []

    def pack() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["node", "first", "ids"])
        out.clear()
        return done

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or len(ids) >= PIECE):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(c)
        if len(out) >= 1024:
            yield pack()
    if ids:
        out.append((node, ids[0], ",".join(map(str, ids))))
    yield pack()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sha) of sorted (node, first, ids); a node's pieces are hashed as they come and never held."""
    node, sha, out = None, None, []
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], names=["node", "sha"])
        out = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["node", "sha"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the ids (conv_id long) of each node, ascending, comma-joined.

    A digest is made in one pass over its ids, so they end in one task for each node; they
    come packed, in order, and stream through it.
    """
    packed = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node string, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node string, sha string")


def trie_nodes(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of ``turns`` (conv_id long, pos from 1 without holes, tid) of ``convs`` (conv_id, n: its turns).

    One row for each node: (node, parent, tid, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256). Sums over subtrees need no walk up the tree: a node's
    own value belongs to its smallest member, and a conversation's nodes of that kind are the
    last of its path, so a subtree has the totals of its members but for what its smallest
    member has above it. Without conversations there are no rows.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    convs = scratch.table(convs, "convs")
    blocks = _blocks(turns, convs, scratch, width)
    nodes = scratch.table(_rolled(blocks, width, "min(conv_id) AS conv_id", "count(*) AS n_convs"), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").na.fill(0, ["n_children"])
    text_bytes = F.coalesce(F.substring_index("tid", "-", -1).cast("long"), F.lit(0))
    place = F.greatest(F.floor((F.col("depth") - 1) / width), F.lit(0)).cast("long")
    nodes = scratch.table(nodes.withColumn("own", (F.col("n_convs") - 1) * text_bytes).withColumn("block", place), "valued")
    # what a conversation's own nodes before a node have: within the block, and in the blocks before
    by_block = nodes.groupBy("conv_id", "block").agg(F.sum("own").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    long = convs.where(F.col("n") > width).select("conv_id")
    upto = _scan(by_block.join(long, "conv_id", "left_semi").withColumn("v", F.col("own")), lambda a, b: a + b, scratch, "sums")
    ahead = upto.select("conv_id", (F.col("block") + 1).alias("block"), F.col("v").alias("ahead"))
    near = F.sum("own").over(Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    nodes = nodes.withColumn("near", near).join(ahead, ["conv_id", "block"], "left").withColumn("above", F.coalesce("near", F.lit(0)) + F.coalesce("ahead", F.lit(0)))
    totals = by_block.groupBy("conv_id").agg(F.sum("own").alias("total"), F.sum("leaf").alias("leaf"))
    whole = _rolled(blocks.join(totals, "conv_id", "left"), width, "sum(total) AS total", "sum(leaf) AS n_leaves").select("node", "total", "n_leaves")
    of = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(whole, "node").join(member_digests(_end_nodes(blocks, width)), "node", "left").join(of, "parent", "left")
    return out.select(
        "node", "parent", "tid", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("total", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``trie_nodes`` of a table of turns, ordered by turn, null first, ties by the turn's digest.

    Rows without a conversation take no part; null roles and texts count as empty, repeated
    rows are turns of their own, and other columns are not read. Ids are integers. An empty
    table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "turns")
    turns = scratch.table(in_order(turn_ids(df, conv_col, turn_col, role_col, text_col)), "turns")
    return trie_nodes(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n")), width)


def node_texts(nodes: DataFrame, df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with role and text of their last turn, from any turn of ``df`` with the same digest; the root has none."""
    role, text, tid = _turn(role_col, text_col)
    of = df.select(tid.alias("tid"), role.alias("role"), text.alias("text")).dropDuplicates(["tid"])
    return nodes.join(of, "tid", "left")


def grafted(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that share their beginnings with the first of their group.

    ``turns`` are (conv_id, pos, tid). Conversation c becomes the first h turns of conversation
    c - c % ``group`` (all if fewer, none if absent), then its own turns after its first h, where
    h = crc32(c in decimals) % ``longest``.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    c = F.col("conv_id")
    plan = sizes.select("conv_id", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % longest).alias("h"), F.col("n").alias("own_n"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = turns.where(F.col("pos") < longest).select(F.col("conv_id").alias("base"), "pos", "tid")
    head = plan.select("conv_id", "base", "taken").join(first, "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "tid")
    tail = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid")
    return head.unionByName(tail), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("n"))
