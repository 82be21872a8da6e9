"""Operators against brute force, exact round trips, held-out accuracy, and odd tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import audio, decontaminate, jaccard, language, mixing, tokens, urls, warc
from tidemark.llm.components import connected_components
from tidemark.llm.storage import Scratch

VOCAB = [f"w{i}" for i in range(60)]
#: Null, empty, blank, repeated and very long rows, and other columns with names that operators use.
ODD = [(None, None), (None, "a b c d e f"), (7, ""), (8, " \t\n"), (9, "x"), (9, "x"), (10, "word " * 60_000), (11, "é😀 ü"), (12, "A b"), (13, "a B")]
NAMES = ("id", "row", "sig", "n", "token", "h", "u", "v", "start", "score", "spans")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    return df.withColumns({c: F.lit(1) for c in NAMES}) if extra else df


def near_copies(seed, groups=25):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([2, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def links(rows, k, num, den):
    sets = {i: brute.shingles(t, k) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}, sets


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_components_match_brute_force(spark, k, num, den):
    rows = near_copies(k)
    pairs, sets = links(rows, k, num, den)
    want = components([i for i, _ in rows], pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), k=k, threshold=(num, den)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_jaccard_pairs_lose_no_link(spark):
    rows = near_copies(9, 12)
    want, sets = links(rows, 3, 9, 10)
    pairs, members = jaccard.jaccard_pairs(docs(spark, rows), k=3, threshold=(9, 10))
    name = {r.doc_id: r.class_id for r in members.collect()}
    got = {(r.class_a, r.class_b) for r in pairs.collect()}
    assert got == {tuple(sorted((name[a], name[b]))) for a, b in want if sets[a] != sets[b]}
    assert all((sets[a] == sets[b]) == (name[a] == name[b]) for a, _ in rows for b, _ in rows)


@pytest.mark.parametrize("base_stays", [True, False])
def test_jaccard_of_a_large_group_of_near_copies(spark, base_stays):
    rng = random.Random(21)
    base = [f"{rng.choice(VOCAB)}{rng.randrange(40)}" for _ in range(140)]
    rows = [base] if base_stays else []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(60)}"
        rows.append(copy[: len(copy) - rng.randrange(3)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    pairs, sets = links(rows, 3, 90, 100)
    want = components([i for i, _ in rows], pairs)
    assert len(set(want.values())) > 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), k=3, threshold=(90, 100)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_jaccard_makes_few_pairs_that_do_not_link(spark):
    """Texts of one base that each differ from all others by thrice as much as linked ones may."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join(w if i not in changed else f"x{d}y{i}" for i, w in enumerate(base))) for d in range(80) for changed in [set(rng.sample(range(400), 10))]]
    rows.append((80, rows[0][1] + " more"))
    j = jaccard._Join(docs(spark, rows), "doc_id", "text", 3, (9, 10))
    made = j.met(j.postings.withColumns({"comp": F.col("sig"), "far": F.lit(True)}))
    assert made.distinct().count() == 1 and made.count() < 100


def test_jaccard_in_odd_tables(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, ODD, True), k=3).collect()), key=str)
    want = [(None, 0, None), (None, 4, None), (7, 0, 7), (8, 0, 8), (9, 1, 9), (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 1, 12), (13, 1, 12)]
    assert got == sorted(want, key=str)
    assert jaccard.jaccard_components(docs(spark, ODD).where("false")).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "cc").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_language_accuracy_and_odd_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = language.train_language(rows.where("not out"), rows_per_language=40)
    held = language.predict_language(rows.where("out"), model)
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert held.columns == [*rows.columns, "lang_pred", "score"]
    got = sorted(((r.doc_id, r.lang_pred == "und", r.score == 0) for r in language.predict_language(docs(spark, [*ODD, (20, "12 34 !")], True), model).collect()), key=str)
    assert [x for x in got if x[1]] == sorted([(None, True, True), (7, True, True), (8, True, True), (20, True, True)], key=str)
    none = language.train_language(rows.where("false"))
    assert {r.lang_pred for r in language.predict_language(rows.limit(3), none).collect()} == {"und"}
    assert language.predict_language(rows.where("false"), model).collect() == []


def grams(text, buckets):
    """Buckets of the n-grams of a text that hold a letter, one character at a time."""
    c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text]
    shift, out = 32 - buckets.bit_length() + 1, []
    for i in range(len(c)):
        h = 0
        for n in range(1, 4):
            if i + n <= len(c):
                h = (h + c[i + n - 1]) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
                if any(x != 32 for x in c[i : i + n]):
                    out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> shift)
    return out


def test_language_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(15)
    words = {"x": ["the", "rain", "Éa", "in"], "y": ["die", "Regen", "ßé", "und"], "z": ["le", "😀", "pluie", "12"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate("xyz" * 20)]
    rows += [(100, "die rain Éa le 12 pluie " * 400, None), (101, "thé" + "😀" * 3, None), (102, "a", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for piece in (1 << 18, 50):  # pieces end within rows, between two characters
        monkeypatch.setattr(language, "PIECE_BYTES", piece)
        model = language.train_language(frame, rows_per_language=10**6, buckets=1024)
        want = np.zeros((3, 1024))
        for _, t, lang in rows:
            if lang:
                np.add.at(want["xyz".index(lang)], grams(t, 1024), 1)
        want = np.log(want + 0.5) - np.log(want.sum(1, keepdims=True) + 512)
        assert model.languages == ["x", "y", "z"] and np.abs(model.log_prob[:, :-1] - want).max() < 1e-5
        got = {r.doc_id: r for r in language.predict_language(frame, model).collect()}
        for i, t, _ in rows:
            total = want[:, grams(t, 1024)].sum(1)
            assert got[i].lang_pred == "xyz"[total.argmax()] and abs(got[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-3


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 50, 200, 900])), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * target[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], s
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_small_sources_meet_targets_beside_a_hot_one(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * (rng.choice([3, 40, 170, 900]) + rng.randrange(30))), f"s{i % 8}" if i < 480 else "t" if i < 3000 else "hot") for i in range(12_000)]
    size, taken, target = defaultdict(int), defaultdict(int), {}
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.02).collect()
    assert sorted(r.doc_id for r in got) == list(range(12_000))
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    off = {s: abs(taken[s] - target[s]) / target[s] for s in target}
    hot = off.pop("hot")  # takes some 30 of its 9,000 documents
    assert len(off) == 9 and max(off.values()) <= 0.001 and hot <= 0.02, (off, hot)


def test_cube_flight_keeps_sums():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(80, 120, 500).astype(float))[::-1]
    p = np.full(500, 0.37)
    q = mixing._flight(p, x, rng, False)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-4


def test_mixing_keeps_probabilities():
    rng = np.random.default_rng(5)
    n, seeds, p = 150, 200, 0.37
    x = np.round(np.exp(rng.normal(5.5, 1.2, n))).astype(int)
    part = pd.DataFrame({"id": range(n), "size": x, "h": rng.integers(0, 1 << 62, n), "source_no": 0, "whole": 0, "p": p, "words": p * x.sum()})
    taken = np.zeros(n)
    for seed in range(seeds):
        out = mixing._settle(seed, 1, True)((0, 0), part.copy())
        taken[out["id"]] += out["p"]
        assert abs((out["p"] * out["size"]).sum() - p * x.sum()) < 0.001 * p * x.sum()
    z = (taken / seeds - p) / np.sqrt(p * (1 - p) / seeds)
    assert np.abs(z).max() < 4.5 and np.sqrt((z**2).mean()) < 1.2 and abs(z.mean()) < 0.1


def test_mixing_in_odd_tables(spark):
    got = mixing.mix_sources(docs(spark, ODD, True)).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == 6 + 1 + 1 + 60_000 + 2 + 2 + 2
    assert mixing.mix_sources(docs(spark, ODD).where("false")).collect() == []
    assert {r.target for r in mixing.mix_sources(docs(spark, [(1, ""), (2, None)])).collect()} == {0.0}


def test_warc_round_trip(spark):
    rng = random.Random(2)
    pages = [None, "", "same", "same", *("<p>" + " ".join(rng.choice(VOCAB) for _ in range(300)) + "</p>" for _ in range(60)), "long " * 200_000, "é\r\n\r\n😀"]
    rows = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").coalesce(2)
    for size in (1, 20, 1000):
        path = Scratch(spark, "t").path
        warc.write_archives(warc.plan_records(rows, "page_id", "url", "html"), path, archive_records=size)
        got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
        assert len(got) == len(pages)
        for i, p in enumerate(pages):
            r, raw = got[f"urn:row:{i}"], (p or "").encode()
            assert r.error is None and r.payload_bytes == len(raw) and r.payload_digest == warc.sha1_base32(raw) and r.target_uri == f"http://h/{i}"
            keeper = max(j for j, q in enumerate(pages) if (q or "") == (p or ""))
            assert (r.record_type, r.refers_to) == (("response", None) if keeper == i else ("revisit", f"urn:row:{keeper}"))
            assert keeper != i or bytes(r.payload) == raw
    path = Scratch(spark, "t").path
    warc.write_archives(warc.plan_records(rows.where("false"), "page_id", "url", "html"), path)
    assert spark.read.format("binaryFile").load(path).count() <= 2 and warc.read_archives(spark, path).collect() == []


def test_broken_archives_are_told():
    records = [warc._record(f"urn:row:{i}", "http://x", "2024-01-01T00:00:00Z", f"payload {i} ".encode() * 40, warc.sha1_base32(f"payload {i} ".encode() * 40), 40 * len(f"payload {i} "), None) for i in range(300)]
    data = warc._archive(records, 4096)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert [r["error"] for r in warc.parse_archive(data)] == [None] * 300
    assert [r["error"] for r in warc.parse_archive(data[:-3])][-1] is not None
    frame = zstandard.ZstdCompressor().compress
    assert next(warc.parse_archive(frame(records[0].replace(b"payload 0", b"payload 1"))))["error"] == "wrong block digest"
    assert next(warc.parse_archive(frame(records[0][:-1])))["error"] == "wrong content length"
    assert next(warc.parse_archive(frame(b"no record")))["error"] == "no WARC header"
    assert next(warc.parse_archive(b"junk and junk"))["error"] == "not a Zstandard frame"


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.choice([3, 15, 30, 59])))) for i in range(12)]
    rows = []
    for i in range(120):
        w = [rng.choice(VOCAB) for _ in range(rng.choice([2, 40, 300]))]
        if i % 2:
            x = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(3)):
                x[rng.choice([0, 1, -1, len(x) // 2])] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = x
        rows.append((i, " ".join(w).title() if i % 5 == 0 else " ".join(w)))
    want = {}
    for i, t in rows:
        w = brute.words(t)
        h = [tuple(w[j : j + 5]) for j in range(len(w) - 4)] or [tuple(w)]
        for item, u in items:
            x = brute.words(u)
            g = [tuple(x[j : j + 5]) for j in range(len(x) - 4)] or [tuple(x)]
            best = 0
            for s in range(max(1, len(h) - len(g) + 1)):
                part = h[s : s + len(g)]
                c = sum(min(part.count(k), g.count(k)) for k in set(g))
                best = max(best, c / (len(part) + len(g) - c))
            if best >= 0.8:
                want[i, item] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_in_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "x"), (1, "a b c d e f")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, ODD, True), bench).collect()), key=str)
    assert got == sorted([(None, 1), (9, 4)], key=str)
    assert decontaminate.find_leaks(docs(spark, ODD).where("false"), bench).collect() == []
    assert decontaminate.find_leaks(docs(spark, ODD), bench.where("false")).collect() == []


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("ads", "a.com", "2024-01-10", "add"), ("ads", "a.com", "2024-02-10", "remove"), ("ads", "a.com", "2024-03-10", "add"), ("bad", "b.a.com/x", "2024-01-01", "add"), ("bad", None, "2024-01-01", "add"), ("bad", "c.com", "2024-01-01", "remove")],
        "list string, key string, date string, action string",
    ).withColumn("date", F.to_date("date"))
    rows = [(1, "http://b.a.com/x/y?q", "2024-01-20"), (2, "https://u@A.com:80/", "2024-02-09"), (3, "http://a.com", "2024-02-10"), (4, "http://a.com", "2024-03-10"), (5, None, "2024-03-10"), (6, "junk", "2024-03-10"), (7, "http://a.com", None), (4, "http://a.com", "2024-03-10"), (8, "http://xa.com/b.a.com/x", "2024-06-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("key", F.lit(1))
    got = sorted((r.page_id, r.lists, r.keys) for r in urls.filter_urls(captures, entries).collect())
    assert got == sorted([(1, ["ads", "bad"], ["a.com", "b.a.com/x"]), (2, ["ads"], ["a.com"]), (3, [], []), (4, ["ads"], ["a.com"]), (4, ["ads"], ["a.com"]), (5, [], []), (6, [], []), (7, [], []), (8, [], [])])
    assert urls.filter_urls(captures.where("false"), entries).collect() == []
    assert all(not r.lists for r in urls.filter_urls(captures, entries.where("false")).collect())


def test_url_filters_with_long_paths_and_times(spark):
    entries = spark.createDataFrame(
        [("deep", "a.com/b/c/d/e", "2024-01-10 12:00:00", "add"), ("deep", "a.com/b/c/d/e", "2024-03-20 06:00:00", "remove")], "list string, key string, date string, action string"
    ).withColumn("date", F.to_timestamp("date"))
    rows = [(1, "http://x.a.com/b/c/d/e/f", "2024-01-10 12:00:00"), (2, "http://a.com/b/c/d/e", "2024-01-10 11:59:59"), (3, "http://a.com/b/c/d/e?q", "2024-03-20 05:59:59"), (4, "http://a.com/b/c/d/e", "2024-03-20 06:00:00"), (5, "http://a.com/b/c/d", "2024-02-01 00:00:00")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched"))
    assert {r.page_id for r in urls.filter_urls(captures, entries).collect() if r.lists} == {1, 3}


def test_url_query_matches_sql(spark):
    import duckdb

    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_url_filter"]).fetchall()
    names = [c[0] for c in con.description]
    got = queries.op3_url_filter(spark, "/root/testdata/sf0.01").select(names).collect()
    plain = lambda rows: sorted(tuple(str(x)[:40] for x in r) for r in rows)
    assert plain(got) == plain(want)
    assert any(r.blocked for r in got)


def test_tokens_are_attributed_once(spark):
    rows = [*ODD, (30, "one two\nthree\n\nfour"), (31, "tab\n\n\n  x\n"), (32, "\n")]
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, rows, True)).collect() if r.doc_id not in (None, 9)}
    encoding, lengths = tokens._encoder(tokens.VOCABULARY)
    for i, t in rows:
        if i in got:
            ids = encoding.encode_ordinary(t or "")
            assert got[i].n_tokens == len(ids) == sum(got[i].section_tokens)
            if not t:
                continue
            want, at = [0] * got[i].n_sections, 0
            owner = np.cumsum([0] + [c == "\n" for c in t])[:-1]
            whole = t.encode()
            for k in ids:
                raw = whole[at : at + lengths[k]]
                a, z = len(whole[:at].decode("utf-8", "ignore")), len(whole[: at + len(raw)].decode("utf-8", "ignore"))
                touched = [owner[c] for c in range(a, max(z, a + 1))] or [owner[a]]
                want[max(sorted(set(touched)), key=touched.count)] += 1
                at += len(raw)
            assert got[i].section_tokens == want, t[:30]
    assert tokens.count_tokens(docs(spark, ODD).where("false")).collect() == []


def test_boundary_rule():
    counts, crossing = tokens.attribute(np.array([0, 2, 4, 9]), np.array([1, 5, 8, 10]), np.array([0, 3, 6, 10]))
    assert (counts.tolist(), crossing) == ([1, 1, 2, 0], 3)


def test_audio_alignment(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    vectors += [(100, vectors[0][1]), (101, vectors[20][1][8:] + rng.normal(size=8).tolist()), (102, None), (103, [])]
    frame = audio.render(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {r.vec_id: r for r in audio.align(frame, "vec_id", "audio").collect()}
    assert got[100].class_id == got[0].class_id == 0 and got[0].n_links == 0
    assert (got[20].n_links, got[20].best_class, got[20].best_offset) == (1, 101, -8) and got[20].best_error < 0.2
    assert got[1].n_links is None and got[102].class_id is None and got[103].n_codes == 0
    junk = spark.createDataFrame([(1, b"junk"), (2, None), (None, b"")], "vec_id long, audio binary")
    assert [r.n_codes for r in audio.align(junk, "vec_id", "audio").collect()] == [0, 0, 0]


def test_audio_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (46, 46, 46, 30, 80, 200)]
    base.append(np.concatenate([base[0][:20], base[1][:20], base[0][:20]]))
    codes = []
    for c in base:
        codes.append(c)
        for rate in (0.05, 0.1, 0.15, 0.19, 0.2, 0.21):
            noise = np.packbits(rng.random((len(c), 32)) < rate, axis=1).view(np.uint32).ravel()
            cut = rng.integers(0, 12)
            codes.append((c ^ noise)[cut:])
    rows = [(i, c.view(np.int32).tolist()) for i, c in enumerate(codes)] + [(900, []), (901, [5] * 20)]
    want = {}
    for i, a in enumerate(codes):
        if i % 4 == 0:
            found = []
            for j, b in enumerate(codes):
                shares = []
                for d in range(16 - len(a), len(b) - 15):
                    x, y = a[max(0, -d) : len(b) - d], b[max(0, d) : len(a) + d]
                    if i != j and len(x) >= 16:
                        shares.append((int(np.bitwise_count(x ^ y).sum()) / (32 * len(x)), abs(d), d))
                if shares and min(shares)[0] <= 0.2:
                    found.append((min(shares)[0], j, min(shares)[2]))
            want[i] = (len(found), *(min(found) if found else (None, None, None)))
    assert sum(n for n, *_ in want.values()) > 25
    frame = spark.createDataFrame(rows, "id long, codes array<int>")
    made = lambda df, i, m: df.select("id", F.when(F.size("codes") > 0, F.xxhash64("codes")).alias("sig"), "codes")
    monkeypatch.setattr(audio, "fingerprints", made)
    for block in (1 << 17, 400):
        monkeypatch.setattr(audio, "QUERY_CODES", block)
        monkeypatch.setattr(audio, "BLOCK_CODES", block)
        got = {r.id: (r.n_links, r.best_error, r.best_class, r.best_offset) for r in audio.align(frame, "id", "codes", query_step=4).collect()}
        assert {i: got[i] for i in want} == want


WANTED = {
    "op1_decontaminate": {"doc_id", "item_id", "start", "similarity"}, "op2_source_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op3_url_filter": {"page_id", "fetched", "lists", "keys", "blocked"},
    "op4_warc_zstd": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op5_audio_fingerprint": {"vec_id", "class_id", "n_links"}, "op6_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_ngram_jaccard": {"doc_id", "n_shingles", "component_id"}, "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op10_token_counts": {"doc_id", "n_tokens", "section_tokens"},
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_registered_queries(spark, name):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, sf)
    assert set(out.columns) >= WANTED[name]
    rows = out.collect()
    ids = {"op4_warc_zstd": ("pages", "page_id"), "op3_url_filter": ("pages", "page_id"), "op5_audio_fingerprint": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    every = [r[0] for r in spark.read.parquet(f"{sf}/{ids[0]}.parquet").select(ids[1]).collect()]
    assert rows and ({r[ids[1]] for r in rows} <= set(every) if name == "op1_decontaminate" else sorted(r[ids[1]] for r in rows) == sorted(every))
    if name == "op8_language_id":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    if name == "op9_pii":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert all(r.base_sha256 == brute.digest(brute.pii_spans(texts[r.doc_id]), ("email", "ip", "card", "phone")) for r in rows)
    if name == "op6_secret_scan":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert all(r.base_sha256 == brute.digest(brute.secret_spans(texts[r.doc_id]), ("assign", "access", "hex")) for r in rows)


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    some = known.where("lang is not null").first()
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7, " 12 ", None, "s", 4), (None, some.text, None, "s", 1), (None, some.text, None, "s", 1), (-5, f"{some.text} mail a.b@c.de", some.lang, "s", 1), (-5, some.text * 40, some.lang, None, 1)]
    rows = known.limit(60).unionByName(spark.createDataFrame(odd, known.schema)).withColumn("row", F.lit(1))
    told = corpus_pipeline.language(spark, rows, sf)
    assert told.columns == list(corpus_pipeline.COLUMNS) and told.where("lang is null or text is null").count() == 0
    assert sorted((r.doc_id, r.lang) for r in told.where("doc_id is null or doc_id < 0").collect() if r.doc_id is not None) == [(-5, some.lang)] * 2
    assert told.where("doc_id is null").select("lang").collect() == [(some.lang,)] * 2
    clean = corpus_pipeline.personal_data(spark, rows, sf)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and clean.count() == rows.count()
    got = {(r.doc_id, r.n_chars): r.text for r in clean.where("doc_id is null or doc_id in (-5, 7)").collect()}
    assert got[None, None] is None and got[None, 0] == "" and got[7, 4] == " 12 "
    assert any(t.endswith("mail <EMAIL>") for (i, _), t in got.items() if i == -5) and all(n == len(t) for (_, n), t in got.items() if t is not None)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert len(set(ids)) == len(ids)
    rows = {r.doc_id: r.text for r in before.collect()}
    pairs, _ = links(list(rows.items()), 5, 8, 10)
    assert not [p for p in pairs if p[0] in set(ids) and p[1] in set(ids)]
    assert not [i for r in out for i in brute.pii_spans(r.text)]
    docs_ = before.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_.where("false"), sf).columns == docs_.columns, name


def test_pipeline_keeps_rows_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    text = [" ".join(f"{rng.choice(VOCAB)}{rng.randrange(9)}" for _ in range(30)) for _ in range(24)]
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, t) for t in text[:8]] + [(5, t) for t in text[8:16]] + [(i + 10, t) for i, t in enumerate(text[16:])]
    copies = [(99, text[0]), (None, text[1]), (5, text[9]), (5, text[20]), (2, text[2] + " more")]
    frame = lambda rows: spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    empty = [(None, ""), (None, ""), (None, None), (5, "")]
    want = [r for r in rows if r not in ((None, text[0]), (None, text[2]), (14, text[20]))] + [(99, text[0]), (5, text[20]), (2, text[2] + " more"), *empty]
    assert plain(corpus_pipeline.near_duplicates(spark, frame(rows + copies + empty), str(tmp_path))) == sorted(want, key=str)
    leaky = frame([*rows, (None, f"a b {item} c"), (5, item)])
    assert plain(corpus_pipeline.decontamination(spark, leaky, str(tmp_path))) == sorted(rows, key=str)
    many = frame([*rows, *rows, *rows[:2]])
    got = corpus_pipeline.mixture(spark, many, str(tmp_path)).collect()
    assert len(got) > 20 and {r.doc_id for r in got} >= {None, 5}
    assert sum(r.taken for r in got) == 30 * sum(r.copies for r in got) and abs(sum(r.taken for r in got) - got[0].target) <= 30
