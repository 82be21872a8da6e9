"""Exact top-k inner products from an impact-ordered index, score at a time.

Rows are dealt into shards of bounded size by a hash of their number. In a shard every entry of
a vector is a posting, and its impact is its size, quantised to half a bit; postings of one
dimension and impact make a segment. A query takes the segments by descending impact and adds
their contributions to accumulators. After each impact, what a row may still gain or lose is at
most the norm of its smaller entries times that of the query; rows that can't reach the
query's k-th best score are out. Once few rows are possible, they are rescored exactly, so the
result is that of scoring all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch

#: Entries of a shard's vectors on average, and entries of the queries that a task takes on average.
SHARD, BLOCK = 1 << 19, 1 << 17
#: Shards of the first round; each later round takes this many times the shards before it.
GROWTH = 8
#: A search ends when no more than this share of a shard's rows, or so many rows, are possible.
FEW, FEW_ROWS = 1 / 16, 64
#: Slack of accumulators for rounding, as a share of the product of norms.
ROUNDING = 1e-9


def quantised(col: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every entry as whole doubles; null where the vector or an entry is null or not finite."""
    entries = F.transform(col, lambda c: c.cast("double"))
    told = col.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # beyond 2**52 every double is whole
    return F.when(told, F.transform(entries, lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale)))


def _impact(x: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm of whole numbers' sizes, rounded down, from 0 on; -1 where there is no posting."""
    size = np.abs(x)
    return np.where(size > 0, np.floor(2 * np.log2(np.maximum(size, 1))), -1).astype(np.int32)


def _dense(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix, missing entries as 0."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    out, flat = np.zeros((len(column), dims)), np.asarray(column.flatten(), float)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _segments(dims: int):
    """(shard, dim, impact, docs, vals, n) of a shard's rows; a head with dim -1 tells how many rows there are."""

    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("doc").to_numpy())
        x = _dense(part.column("x"), dims)[order]
        held: list[tuple] = [(-1, -1, np.zeros(0, np.int32), np.zeros(0))]
        for d in range(dims):
            impact = _impact(x[:, d])
            by = np.argsort(-impact, kind="stable")
            ends = np.flatnonzero(np.diff(impact[by], append=-2)) + 1
            held += [(d, int(impact[by[i]]), by[i:j].astype(np.int32), x[by[i:j], d]) for i, j in zip([0, *ends[:-1]], ends, strict=True) if impact[by[i]] >= 0]
        n, shard = len(x), part.column("shard")[0].as_py()
        return pa.table({
            "shard": pa.array([shard] * len(held), pa.int32()), "dim": pa.array([h[0] for h in held], pa.int32()), "impact": pa.array([h[1] for h in held], pa.int32()),
            "docs": pa.array([h[2] for h in held], pa.list_(pa.int32())), "vals": pa.array([h[3] for h in held], pa.list_(pa.float64())), "n": pa.array([n] * len(held), pa.int32()),
        })

    return run


def _exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of whole numbers, exact: in doubles where all sums are below 2**53, else in Python's integers."""
    if not x.size or float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2.0**53:
        return [int(v) for v in x @ q]
    return [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]


class Shard:
    """The segments of a shard as they are searched: by descending impact, with what is left of each row after each."""

    def __init__(self, n: int, dims: int, segments: list[tuple[int, int, np.ndarray, np.ndarray]]):
        """``segments`` are (dim, impact, docs, vals)."""
        self.n, self.x, self.steps = n, np.zeros((n, dims)), []
        for dim, _, docs, vals in segments:
            self.x[docs, dim] = vals
        rest = (self.x**2).sum(1)
        self.rounding = ROUNDING * np.sqrt(rest)
        # beyond the range of doubles nothing can be proved, and all rows are rescored
        for impact in sorted({s[1] for s in segments}, reverse=True) if np.isfinite(rest).all() else ():
            now = [s for s in segments if s[1] == impact]
            docs, vals = np.concatenate([s[2] for s in now]).astype(np.intp), np.concatenate([s[3] for s in now])
            rest = rest - np.bincount(docs, vals * vals, n)
            self.steps.append((docs, np.repeat([s[0] for s in now], [len(s[2]) for s in now]), vals, np.sqrt(np.maximum(rest, 0)) + self.rounding))

    def search(self, q: np.ndarray, k: int, least: int | None = None, own: int | None = None, stats: dict | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (score, doc) for one query, ties to the smaller doc, without ``own``.

        Scores below ``least``, where it is told, are left out. ``stats`` gets the postings
        taken and the rows rescored.
        """
        norm, acc, taken = float(np.sqrt(q @ q)), np.zeros(self.n), 0
        floor = -np.inf if least is None else float(least)
        possible = np.arange(self.n) if own is None else np.delete(np.arange(self.n), own)
        for docs, dims, vals, left in self.steps:
            if len(possible) <= max(FEW_ROWS, FEW * self.n):
                break
            acc += np.bincount(docs, vals * q[dims], self.n)
            taken += len(docs)
            sums, room = acc[possible], norm * left[possible]
            # k rows surely have what the k-th best of the lower bounds has
            floor = max(floor, float(np.partition(sums - room, len(possible) - k)[len(possible) - k])) if len(possible) >= k else floor
            possible = possible[sums + room >= floor]
        scores = _exact(self.x[possible], q)
        if stats is not None:
            stats["postings"], stats["rescored"] = stats.get("postings", 0) + taken, stats.get("rescored", 0) + len(possible)
        return sorted(((s, int(d)) for s, d in zip(scores, possible, strict=True) if least is None or s >= least), key=lambda r: (-r[0], r[1]))[:k]


def _search(k: int, dims: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if index.num_rows and asked.num_rows:
            lists = lambda name: [np.asarray(v.values) for v in index.column(name).combine_chunks()]
            segments = zip(index.column("dim").to_pylist(), index.column("impact").to_pylist(), lists("docs"), lists("vals"), strict=True)
            number, shard = index.column("shard")[0].as_py(), Shard(index.column("n")[0].as_py(), dims, [s for s in segments if s[0] >= 0])
            rows = [asked.column(c).to_pylist() for c in ("q", "home", "own", "least")]
            for q, home, own, least, x in zip(*rows, _dense(asked.column("x"), dims), strict=True):
                for score, doc in shard.search(x, k, least, own if home == number else None):
                    if abs(score) >= 2**63:
                        raise OverflowError("an inner product is beyond a long")
                    out.append((q, number, doc, score))
        types = {"q": pa.int64(), "shard": pa.int32(), "doc": pa.int32(), "score": pa.int64()}
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(types.items())})

    return run


def build_index(df: DataFrame, id_col: str, vector_col: str, scratch: Scratch, scale: int = 256) -> tuple[DataFrame, DataFrame, int, int]:
    """(members, index, number of shards, dimensions) of the rows that take part.

    ``members`` are (num, id, x, shard, doc), ``doc`` by id within a shard, null last;
    ``index`` are the posting segments, stored with a shard's segments together.
    """
    rows = scratch.table(df.select(F.monotonically_increasing_id().alias("num"), F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("x")).where("x is not null"), "rows")
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    dims = dims or 0
    shards = max(1, -(-n * max(dims, 1) // SHARD))
    by_id = Window.partitionBy("shard").orderBy(F.col("id").asc_nulls_last(), "num")
    members = scratch.table(rows.withColumn("shard", F.pmod(F.xxhash64("num"), F.lit(shards)).cast("int")).withColumn("doc", F.row_number().over(by_id) - 1), "members")
    index = members.select("shard", "doc", "x").groupBy("shard").applyInArrow(_segments(dims), "shard int, dim int, impact int, docs array<int>, vals array<double>, n int")
    return members, scratch.table(index, "index"), shards, dims


def exact_top_k(df: DataFrame, id_col: str, vector_col: str, k: int = 5, query_step: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): of each row with an id divisible by ``query_step``, the ``k`` best other rows.

    Scores are inner products of ``floor(scale * entry)``, exact; ties go to the smaller id, a
    null id last, of equal ids in an order that holds for the run. Rows whose vector is null or
    holds a null or non-finite entry take no part. Missing entries of shorter and of empty
    vectors count as 0. Repeated ids are rows of their own: each is searched, and finds the
    others. With fewer than ``k`` other rows all are found; an empty table gives no rows. A
    score beyond a long is an error. Other columns are not read.

    Shards come in rounds of growing size, and what earlier rounds found bounds later ones
    from below, so that a query gets a few rows from each round however many shards there are.
    """
    scratch = Scratch(df.sparkSession, "topk")
    members, index, shards, dims = build_index(df, id_col, vector_col, scratch, scale)
    asked = members.where(F.col("id") % query_step == 0)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked * max(dims, 1) // BLOCK))
    asked = scratch.table(asked.select(F.col("num").alias("q"), "x", F.col("shard").alias("home"), F.col("doc").alias("own"), F.pmod(F.xxhash64("num", F.lit(1)), F.lit(blocks)).cast("int").alias("block")), "asked")
    spark = df.sparkSession
    best = spark.createDataFrame([], "q long, shard int, doc int, score long, num long, id " + df.schema[id_col].dataType.simpleString())
    done, first = 0, Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "num")
    while done < shards:
        upto = min(shards, max(GROWTH, done * (GROWTH + 1)))
        bound = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        queries = asked.join(bound, "q", "left") if done else asked.withColumn("least", F.lit(None).cast("long"))
        ours = index.where(F.col("shard").between(done, upto - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        theirs = queries.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
        tasks = min((upto - done) * blocks, 20_000)
        pairs = ours.repartition(tasks, "shard", "block").groupBy("shard", "block").cogroup(theirs.repartition(tasks, "shard", "block").groupBy("shard", "block"))
        found = pairs.applyInArrow(_search(k, dims), "q long, shard int, doc int, score long")
        named = found.join(members.select("shard", "doc", "num", "id"), ["shard", "doc"])
        best = scratch.table(best.unionByName(named).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank"), f"best-{upto}")
        done = upto
    ids = asked.select("q").join(members.select(F.col("num").alias("q"), F.col("id").alias("query_id")), "q")
    return best.join(ids, "q").select("query_id", F.row_number().over(first).alias("rank"), F.col("id").alias(id_col), "score")
