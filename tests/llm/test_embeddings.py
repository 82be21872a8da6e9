"""Whitening and exact search against plain numpy, on the tables and on odd rows."""

import math

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import audio, topk
from tidemark.llm.queries import op11_whitening, op12_exact_top_k
from tidemark.llm.whitening import polarised, whiten

NAN, INF = float("nan"), float("inf")
#: id, vector, and columns that clash with names the operators use.
ODD = "i string, v array<double>, id long, x string, num int, shard int"


def odd(rows):
    return [(*r, 7, "x", 1, 2) for r in rows]


def held(vectors):
    return [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whitened(vectors, most=16):
    """Plain version: n, deviations, eigenvalues, trace and whitened values up to sign."""
    dims = max((len(v) for v in vectors), default=0)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(0)
    z = (fit * n - s).astype(float) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    rows = ((x * n - s) / n).astype(float)
    return n, ((x * n - s) ** 2).sum(1), values, np.trace(z.T @ z / n), (rows @ vectors) / np.sqrt(np.maximum(values, 1e-30))


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, values, trace, white = whitened([r["embedding"] for r in table])
    rows = op11_whitening(spark, SF).collect()
    assert len(rows) == 16 * len(table)
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    sign = {}
    for r in rows:
        i, k = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9) and r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(white[i, k]), abs=1e-6)
        if abs(r["whitened"]) > 1e-3:
            sign.setdefault(k, set()).add(r["whitened"] * white[i, k] > 0)
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(40, 3))]
    rows = [*((str(i), v) for i, v in enumerate(vectors)), ("0", vectors[0]), (None, vectors[1]), ("a", [1.0]), ("b", []), ("n", None), ("m", [1.0, None, 2.0]), ("q", [1.0, NAN, 2.0]), ("r", [INF, 1.0, 1.0, 1.0])]
    got = whiten(spark.createDataFrame(odd(rows), ODD), "i", "v").collect()
    stay = held([v for _, v in rows])
    n, deviation, values, trace, white = whitened(stay)
    assert n == 42 and len(got) == 3 * len(stay) and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got) == sorted(int(d) for d in deviation for _ in range(3))
    for k in range(3):
        assert sorted(round(abs(r["whitened"]), 6) for r in got if r["component"] == k + 1) == sorted(round(abs(w), 6) for w in white[:, k])
    assert {r["i"] for r in got} == {i for i, v in rows if v is not None and held([v])}


def test_whitening_without_spread(spark):
    same = spark.createDataFrame(odd([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]), ODD)
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in whiten(same, "i", "v").collect()] == [(1, 0, None, None)] * 4
    line = spark.createDataFrame(odd([(str(i), [float(i), -float(i)]) for i in range(9)]), ODD)
    got = whiten(line, "i", "v").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and got[0]["identity_error"] < 1e-9
    assert whiten(line.where("false"), "i", "v").collect() == [] and whiten(spark.createDataFrame(odd([("a", []), ("b", None)]), ODD), "i", "v").collect() == []


def test_polarisation_is_exact_for_large_numbers():
    z = np.array([[3 * 10**18, -(10**18)], [-(10**18), 10**18], [-2 * 10**18, 0]], object)
    totals = {(0, 0): int((z[:, 0] ** 2).sum()), (1, 1): int((z[:, 1] ** 2).sum()), (0, 1): int(((z[:, 0] + z[:, 1]) ** 2).sum())}
    assert polarised(2, 3, totals)[0, 1] == float(int((z[:, 0] * z[:, 1]).sum()) / 27)


def nearest(rows, k, step, scale=256):
    """Plain version of the search, rows as (id, vector)."""
    rows = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and held([v])]
    out = []
    for at, (i, q) in enumerate(rows):
        if i is not None and i % step == 0:
            others = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(rows) if b != at))[:k]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(others, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query_id"], r["rank"], r[2], r["score"]) for r in df.collect()), key=str)


def test_search_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(op12_exact_top_k(spark, SF)) == nearest(rows, 5, 50)


@pytest.mark.parametrize("shard,block,growth", [(1 << 19, 1 << 17, 8), (60, 12, 1)])
def test_search_of_odd_rows(spark, monkeypatch, shard, block, growth):
    """Small shards and blocks make many rounds."""
    monkeypatch.setattr(topk, "SHARD", shard), monkeypatch.setattr(topk, "BLOCK", block), monkeypatch.setattr(topk, "GROWTH", growth)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(90)]
    rows += [(200 + i, rows[10][1]) for i in range(30)]
    rows += [(None, rows[10][1]), (None, [9.0] * 4), (10, [0.5, 0.5]), (10, rows[3][1]), (300, []), (301, None), (302, [1.0, None]), (310, [NAN] * 4), (320, [1.0, -INF]), (330, [-1e-4, 1e7, 1e-300, 0.0])]
    df = spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], "i long, v array<double>, id long, x string, num int, shard int")
    assert found(topk.exact_top_k(df, "i", "v", 5, 10)) == nearest(rows, 5, 10)


def test_search_with_few_rows_and_large_values(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**22, 3.0]), (2, [-(2.0**22), 1e-3])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    assert found(topk.exact_top_k(df, "i", "v", 5, 1)) == nearest(rows, 5, 1)
    assert topk.exact_top_k(df.where("i = 0"), "i", "v").collect() == [] and topk.exact_top_k(df.where("false"), "i", "v").collect() == []
    with pytest.raises(Exception, match="beyond a long"):
        topk.exact_top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "i long, v array<double>"), "i", "v").collect()


def test_search_stops_on_proof():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(4096, 32)) / 6)
    x[1::7] = x[0]
    segments = []
    for d in range(32):
        impact = topk._impact(x[:, d])
        segments += [(d, int(i), np.flatnonzero(impact == i), x[impact == i, d]) for i in np.unique(impact) if i >= 0]
    shard, stats = topk.Shard(4096, 32, segments), {}
    for q in range(0, 4096, 64):
        scores = x @ x[q]
        best = sorted((-scores[d], d) for d in range(4096) if d != q)[:5]
        assert shard.search(x[q], 5, None, q, stats) == [(int(-s), d) for s, d in best]
        least = int(-best[2][0])
        assert shard.search(x[q], 5, least, q) == [(int(-s), d) for s, d in best if -s >= least]
    assert stats["postings"] < 0.9 * 64 * (x != 0).sum() and stats["rescored"] < 0.2 * 64 * 4096


def degraded(seed, n=150):
    """Recordings of notes, and pieces of them with noise: (codes of all, [(codes of a piece, which)])."""
    rng = np.random.default_rng(seed)
    t, whole, pieces = np.arange(256) / 4000, [], []
    for i in range(n):
        pitch = rng.integers(0, 25, 64)
        tone = np.sin(2 * np.pi * np.outer(110 * 2 ** (pitch / 12), t)).ravel() * 0.78
        whole.append(audio.fingerprint(audio.chroma(tone, 4000)).view(np.int32))
        cut = rng.integers(0, 3000)
        piece = tone[cut : cut + rng.integers(9000, 16384)]
        noisy = np.clip(piece + rng.normal(size=len(piece)) * rng.uniform(0, 1.2), -1, 1)
        pieces.append((audio.fingerprint(audio.chroma(noisy, 4000)).view(np.int32), i))
    return whole, pieces


def test_offset_histograms_find_what_all_offsets_find():
    """Recall of voted offsets against all offsets is 0.9 at least, and what they find is right."""
    whole, pieces = degraded(11)
    index, found, wanted = audio.Votes(whole), 0, 0
    for codes, i in pieces:
        error, offset = audio.best_offsets([codes], whole, 0.2, 16)
        got, at = index.best(codes, 3, 0.2, 16)
        linked, voted = np.isfinite(error[0]), np.isfinite(got)
        assert not (voted & ~linked).any() and (got[voted] >= error[0][voted]).all()
        found, wanted = found + voted.sum(), wanted + linked.sum()
        for j in np.flatnonzero(voted):
            s, t = max(0, -at[j]), max(0, at[j])
            m = min(len(codes) - s, len(whole[j]) - t)
            assert got[j] == np.bitwise_count((codes[s : s + m] ^ whole[j][t : t + m]).view(np.uint32)).sum() / (32 * m)
    assert wanted > 60 and found >= 0.9 * wanted


def test_histograms_in_small_pieces(monkeypatch):
    whole, pieces = degraded(12, 20)
    whole += [np.zeros(300, np.int32), np.zeros(0, np.int32)]
    queries = [c for c, _ in pieces] + [np.zeros(40, np.int32)]
    want = [audio.Votes(whole).best(c, 3, 0.2, 16) for c in queries]
    monkeypatch.setattr(audio, "HITS", 50), monkeypatch.setattr(audio, "CELLS", 400)
    for c, (error, offset) in zip(queries, want, strict=True):
        got = audio.Votes(whole).best(c, 3, 0.2, 16)
        assert (got[0] == error).all() and (got[1] == offset).all()
    assert want[-1][0][-2] == 0 and want[-1][1][-2] == 0 and np.isinf(audio.Votes([]).best(queries[0], 3, 0.2, 16)[0]).all()
