import random
import time

from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import pii, secrets
from tidemark.llm.spans import beside

SECRETS = ["password", "PassWd=", "api_key: '", "APIKEY = \"", "token=secret=", "abc12345", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123456789abcdef", " ", "é", "😀", "=", ":", "short", "\n", "ſecret: abcdefgh1", "toKen=abcdefgh12"]
PII = ["a.b@c.de", "@", ".", "x_y", "1.2.3.4", "256.1.1.1", "00001.2.3.255", ".5", "4316522678525456", "4316 5226-7852 5456", "12", "-", " ", "+1 (310) 555-4510", "+", "(", "é", "😀", "9", "\n", "mail", "%"]


def texts(parts, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return [None, "", " ", *out]


#: Texts on which backtracking would take quadratic time or deep stacks, and how many spans they hold.
LONG = [("x" * 300_000, 0, 0), ("1" * 300_000, 1, 0), ("a.b" * 100_000, 0, 0), ("1." * 100_000, 0, 25_000), ("a@b" + ".c" * 100_000, 0, 1), ("+1" + "(" * 200_000, 0, 0), ("f" * 300_000, 1, 0), ("1 " * 100_000, 0, 0), ("token=" * 50_000, 1, 0)]


def frame(spark, found):
    return spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string").repartition(8)


def test_secret_base_spans_match_brute_force(spark):
    found = texts(SECRETS, 1)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets if s.kind < 3] for r in secrets.scan_secrets(frame(spark, found), [0.0] * 68**2).select("doc_id", "secrets").collect()}
    for i, t in enumerate(found):
        assert got[i] == sorted(brute.secret_spans(t)), t[:80]


def test_very_long_texts(spark):
    rows = frame(spark, [t for t, _, _ in LONG])
    got = {r.doc_id: r for r in rows.select("doc_id", F.size(secrets.base_spans(F.col("text"))).alias("s"), F.size(pii.base_spans(F.col("text"))).alias("p")).collect()}
    assert [(got[i].s, got[i].p) for i in range(len(LONG))] == [(s, p) for _, s, p in LONG]


def test_markov_model_tells_random_strings_from_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    llr = secrets.train(secrets.labelled_tokens(docs))
    rng = random.Random(5)
    random_strings = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(32)) for _ in range(200)]
    names = ["_".join(rng.choice(["thering", "nation", "station", "ordering", "thanst", "reading", "handler"]) for _ in range(4)) for _ in range(200)]
    rows = frame(spark, [*(f"the {x} and" for x in random_strings), *(f"the {x} and" for x in names)])
    got = {r.doc_id: len(r.secrets) for r in secrets.scan_secrets(rows, llr).collect()}
    assert sum(got[i] for i in range(200)) >= 190
    assert sum(got[i] for i in range(200, 400)) <= 4


def test_secrets_in_odd_tables(spark):
    empty = frame(spark, ["x"]).where("false").withColumn("secrets", F.lit(1))
    assert secrets.scan_secrets(empty, [0.0] * 68**2).collect() == []
    assert secrets.scanned_digest(empty.drop("secrets")).collect() == []
    rows = spark.createDataFrame([(None, None), (1, "token = abcdefgh12"), (1, "token = abcdefgh12")], "doc_id long, text string")
    assert sorted(r.n_assign for r in secrets.scanned_digest(rows).collect()) == [0, 1, 1]


def test_pii_base_spans_match_brute_force(spark):
    found = texts(PII, 2)
    rows = frame(spark, found).select("doc_id", F.expr("coalesce(text, '')").alias("text"))
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.base) for r in rows.select("doc_id", pii.base_spans(F.col("text")).alias("base")).collect()}
    for i, t in enumerate(found):
        assert got[i] == sorted(brute.pii_spans(t)), (t or "")[:80]


def test_patterns_discover_unseen_identifiers(spark):
    good = [f"please call my number +1 (310) 555-45{i:02d} soon" for i in range(9)]
    rows = [*good, "they call my number 310555 today", "in chapter 12345 we saw", None, "", "call my number 7"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[9] == [(4, 20, 26)]
    assert got[10] == got[11] == got[12] == got[13] == []
    assert all(got[i] == [(3, 22, 39)] for i in range(9))


def test_pii_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc now", 1), (1, "mail a@b.cc now", 1), (None, None, 2), (2, "", 3), (3, "x 1.2.3.4", 4)], "doc_id long, text string, spans int")
    out = pii.redact(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "", r.spans) for r in out.collect()) == [(0, "", 2), (1, "mail <EMAIL> now", 1), (1, "mail <EMAIL> now", 1), (2, "", 3), (3, "x <IP>", 4)]
    assert pii.find_pii(rows.where("false")).collect() == []


def test_queries_match_brute_force(spark):
    from tidemark.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for query, spans, kinds in ((queries.op6_secret_scan, brute.secret_spans, secrets.KINDS), (queries.op9_pii, brute.pii_spans, pii.KINDS)):
        got = {r.doc_id: r for r in query(spark, "/root/testdata/sf0.001").collect()}
        assert len(got) == len(docs)
        for doc in docs:
            found = spans(doc.text)
            assert got[doc.doc_id].base_sha256 == brute.digest(found, kinds)
            assert set(f"{kinds[k]}:{s}:{e}" for s, k, e in found) <= set(got[doc.doc_id].spans.split(","))


def test_many_spans_in_one_text(spark):
    rng = random.Random(7)
    text = " ".join(rng.choice(["write to é", "call 4711-0815x", "from host 10.20.30.40", "by a.b@c.de now", "x1 é2", f"+1 310 555 {rng.randrange(1000, 9999)}"]) for _ in range(40_000))
    rows = frame(spark, [text, None, "", "mail a.b@c.de"])
    for op in (lambda: pii.find_pii(rows), lambda: pii.redact(rows), lambda: secrets.scan_secrets(rows.withColumn("text", F.regexp_replace("text", "a.b@c.de", "token=abcdefgh12 abcdefghij0123456789xyz")), [0.0] * 68**2)):
        began = time.time()
        op().write.format("noop").mode("overwrite").save()
        assert time.time() - began < 30
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(rows).collect()}
    assert [(s, k, e) for s, k, e in spans[0] if k < 4] == sorted(brute.pii_spans(text)) and len(spans[0]) > 15_000
    out, at = [], 0
    for s, k, e in spans[0]:
        if s >= at:
            out += [text[at:s], f"<{pii.KINDS[k].upper()}>"]
        at = max(at, e)
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got[0] == "".join(out) + text[at:] and (got[1], got[2], got[3]) == (None, "", "mail <EMAIL>")


def test_words_beside_spans_match_brute_force(spark):
    rng = random.Random(8)
    for n in (0, 3, 700):
        words, at = [], 0
        for _ in range(n):
            at += rng.randrange(0, 4)
            words.append((at, at := at + rng.randrange(1, 9)))
        spans = sorted({(s := rng.randrange(max(1, at)), rng.randrange(4), s + rng.randrange(1, 20), rng.randrange(1 << 40)) for _ in range(n)})
        df = spark.createDataFrame([(spans, words)], "s array<struct<start:int,kind:int,end:int,entity:bigint>>, w array<struct<start:int,end:int>>")
        got = df.select(beside(F.col("s"), F.col("w"), "struct<start:int,end:int>").alias("x")).first().x
        want = []
        for a, z in words:
            later = [s for s in spans if s[0] >= a]
            want.append((a, z, any(s[0] < a < s[2] for s in spans), later[0][0] if later else None, later[0][3] if later else None))
        assert [(x.word.start, x.word.end, x.covered, x.next_start, x.entity) for x in got] == want
