"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times and once
more with probability r - floor(r). The flight phase moves these probabilities through
the null space of the balancing constraints (number of documents, number of words) of the
source until all but two are 0 or 1. It runs in blocks of bounded size, so that a hot
source is many tasks; what the blocks leave open meets in later rounds. The first block of
each source waits for what the others leave open and lands with it: a source of any size
has about one block of documents that may be exchanged for others, to meet what the whole
source is to have.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch

#: Rows that a block has on average.
BLOCK_ROWS = 2000
WEIGHTS = (5, 2, 1)
_NEAR = 1e-9
#: Equal rows that are made from a count at a time.
_TIES = 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    edges = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts).cast("long") - edges).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size, n): ``share`` of all words, dealt by weight.

    Weights repeat over the sources by code point, null last. A target stops at ``most``
    times the source's size, and what is over goes to the others by weight, until none is
    above. With one row a source, the table is small whatever the corpus is.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    # sources reach their caps in the order of cap / weight; the first that doesn't ends it
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), "source_no")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", share * F.sum("source_size").over(every)).withColumn("ws", F.sum("w").over(every))
    rows = rows.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.col("all") - F.col("capped_before")) / (F.col("ws") - F.col("w_before")))
    rows = rows.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    level = F.min_by("level", F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "source_no"))).over(every)
    return rows.withColumn("target", F.when(F.col("open"), level * F.col("w")).otherwise(F.col("cap"))).select("source", "source_no", "source_size", "n", "target")


def _flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, landing: bool) -> np.ndarray:
    """Probabilities after the flight phase, and with ``landing`` all of them 0 or 1.

    Two constraints hold: the sums of p and of p * x. Rows come with large x first. A row
    much larger than those that follow can hardly move with them; it is drawn at once, and
    the probabilities of the rows to come take up the difference in words, so that what
    the landing has to settle in the end is small.
    """
    p, x, draws, drawn = p.copy(), x.tolist(), rng.random(2 * len(p) + 8), 0
    size = np.array(x)
    held: list[int] = []
    following = 0

    def move(units: list[int], u: tuple[float, ...]) -> None:
        nonlocal drawn
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(units, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(units, u, strict=True) if v)
        step = up if draws[drawn] * (up + down) < down else -down
        drawn += 1
        for i, v in zip(units, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < _NEAR else 1.0 if q > 1 - _NEAR else q

    def draw(unit: int) -> None:
        nonlocal drawn
        was, p[unit] = p[unit], float(draws[drawn] < p[unit])
        drawn += 1
        rest = p[following:]
        room = rest * (1 - rest)
        if (words := float((room * size[following:]).sum())) > 0:
            p[following:] = np.clip(rest + (was - p[unit]) * x[unit] / words * room, 0, 1)

    while True:
        held = [i for i in held if 0 < p[i] < 1]
        while len(held) < 3 and following < len(p):
            if 0 < p[following] < 1:
                held.append(following)
            following += 1
        if len(held) == 3 and x[held[0]] > 4 * x[held[2]]:
            draw(held.pop(0))
        elif len(held) == 3:
            a, b, c = (x[i] for i in held)
            u = (c - b, a - c, b - a)
            move(held, u if any(u) else (1.0, -1.0, 0.0))
        elif len(held) == 2 and x[held[0]] == x[held[1]]:
            move(held, (1.0, -1.0))
        elif landing and len(held) == 2:  # the number of documents gives way to the words
            move(held, (max(x[held[1]], 1e-6), -max(x[held[0]], 1e-6)))
        elif landing and held:
            draw(held.pop())
        else:
            return p


def _exchanged(q: np.ndarray, x: np.ndarray, words: float) -> np.ndarray:
    """The landing's draws, with a document taken, left or exchanged for another while that brings their words nearer."""
    q = q.copy()
    for _ in range(16):
        off = words - float((q * x).sum())
        inside, outside = np.flatnonzero(q > 0.5), np.flatnonzero(q < 0.5)
        moves = [(abs(off + s * x[i]), i, -1) for part, s in ((inside, 1), (outside, -1)) if len(part) for i in [part[np.abs(off + s * x[part]).argmin()]]]
        if len(inside) and len(outside):
            order = inside[np.argsort(x[inside], kind="stable")]
            at = np.searchsorted(x[order], x[outside] - off)
            for near in (np.clip(at, 0, len(order) - 1), np.clip(at - 1, 0, len(order) - 1)):
                left = np.abs(off - x[outside] + x[order[near]])
                k = int(left.argmin())
                moves.append((left[k], order[near[k]], outside[k]))
        best = min(moves, default=(abs(off), 0, 0))
        if best[0] >= abs(off):
            break
        for i in best[1:]:
            if i >= 0:
                q[i] = 1 - q[i]
    return q


def _settle(seed: int, k: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Round ``k`` for the rows of one block of one source; the last meets the words in ``words``."""

    def settle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([seed, k, int(key[0]), int(key[1])])
        p, x = part["p"].to_numpy(), part["size"].to_numpy(float)
        q = _flight(p, x, rng, last)
        part["p"] = _exchanged(q, x, float(part["words"].iloc[0])) if last and len(q) else q
        return part[["id", "size", "h", "source_no", "whole", "p"]]

    return settle


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of its own for each of equal rows, so that many of them do not meet in one block.

    Equal rows are counted and made anew from the count, so that reruns give the same hashes.
    """
    counted = rows.groupBy("id", "source", "size", "h").agg(F.count("*").alias("c"))
    part = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / _TIES))).alias("p"))
    each = part.select("id", "source", "size", "h", F.explode(F.sequence(F.col("p") * _TIES, F.least(F.col("c"), (F.col("p") + 1) * _TIES) - 1)).alias("tie"))
    return each.select("id", "source", "size", F.when(F.col("tie") == 0, F.col("h")).otherwise(F.xxhash64("h", "tie")).alias("h"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of ``df``.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that.
    Null and empty texts have size 0; a null source is a source of its own, last in order.
    Every input row gives one output row, also when rows repeat. Where all sizes are 0,
    all targets are. Reruns agree: draws depend on ids, sizes and ``seed`` alone. An empty
    table gives an empty result. Other columns are not read, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("h"))
    rows = scratch.table(_told_apart(scratch.table(rows, "rows")), "sizes")
    targets = scratch.table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most), "targets")
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("id", "size", "h", "source_no", "n", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    per_source = targets.select(F.max("n")).first()[0] or 0
    order = F.pmod(F.xxhash64("h", F.lit(seed)), F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)))
    done = [joined.where((F.col("p") < _NEAR) | (F.col("p") > 1 - _NEAR)).select("id", "size", "source_no", "whole", F.round("p").alias("p"))]
    still = joined.where((F.col("p") >= _NEAR) & (F.col("p") <= 1 - _NEAR)).select("id", "size", "h", "source_no", "whole", "p", order.alias("block"))
    schema = "id {0}, size long, h long, source_no int, whole long, p double".format(rows.schema["id"].dataType.simpleString())
    waiting, still, k = still.where("block = 0"), still.where("block > 0"), 1
    while per_source > BLOCK_ROWS:
        blocks = math.ceil(per_source / BLOCK_ROWS)
        moved = scratch.table(still.groupBy("source_no", "block").applyInPandas(_settle(seed, k, False), schema), f"round-{k}")
        done.append(moved.where("p = 0 or p = 1").select("id", "size", "source_no", "whole", "p"))
        per_source = 3 * blocks  # a block leaves two rows at most; one to spare for blocks beyond their mean
        groups = max(1, math.ceil(per_source / BLOCK_ROWS))
        still = moved.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed + k)), F.lit(groups)))
        waiting, k = waiting if groups > 1 else waiting.unionByName(still), k + 1
    # what a source is to have beyond whole copies, less what it has
    has = [part.select("source_no", (F.col("p") * F.col("size")).alias("has")) for part in done[1:]]
    wanted = targets.select("source_no", (F.col("source_size") * (ratio - F.floor(ratio))).alias("words"))
    if has:
        has = reduce(DataFrame.unionByName, has).groupBy("source_no").agg(F.sum("has").alias("has"))
        wanted = wanted.join(has, "source_no", "left").select("source_no", (F.col("words") - F.coalesce("has", F.lit(0.0))).alias("words"))
    landing = waiting.withColumn("block", F.lit(0)).join(wanted, "source_no").groupBy("source_no", "block")
    landed = scratch.table(landing.applyInPandas(_settle(seed, k, True), schema), "landing")
    done.append(landed.select("id", "size", "source_no", "whole", "p"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.join(targets, "source_no").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
