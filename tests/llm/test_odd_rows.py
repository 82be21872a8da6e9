"""Repeated and null ids, clashing column names, ties, very long rows and keys of any type, for the earlier operators."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import audio, jaccard, language, mixing, pii, spans, tokens, urls, warc

NAMES = ("id", "row", "sig", "n", "h", "u", "v", "start", "spans", "codes", "key", "list", "date", "digest", "length", "payload")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in NAMES if c not in df.columns})


def test_audio_ids_and_lengths(spark):
    rng = np.random.default_rng(1)
    long = rng.integers(-(2**31), 2**31, 30_000).tolist()
    rows = [(20, long), (20, long), (None, long[100:160]), (40, long[500:600]), (41, []), (None, None)]
    frame = clashing(spark.createDataFrame(rows, "i long, c array<int>"))
    made = lambda df, i, m: df.select(F.col(i).alias("id"), F.when(F.size(m) > 0, F.xxhash64(m)).alias("sig"), F.coalesce(m, F.array().cast("array<int>")).alias("codes"))
    was, audio.fingerprints = audio.fingerprints, made
    try:
        for votes in (None, 3):
            got = [(r.i, r.class_id, r.n_links, r.best_class, r.best_offset, r.best_error) for r in audio.align(frame, "i", "c", votes=votes).collect()]
            assert got.count((20, 20, 2, None, -100, 0.0)) == 2 and (40, 40, 1, 20, 500, 0.0) in got and len(got) == 6
    finally:
        audio.fingerprints = was


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, None, "same"), (None, "u", None), (7, "u", ""), (9, "u", "Grüße 😀\x00 end")]
    frame = clashing(spark.createDataFrame(rows, "i long, a string, b string"))
    warc.write_archives(warc.plan_records(frame, "i", "a", "b"), f"{tmp_path}/w")
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.refers_to, r.error) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()), key=str)
    assert got == sorted([
        ("urn:row:1", "response", 4, None, None), ("urn:row:1", "response", 4, None, None), ("urn:row:null", "revisit", 4, "urn:row:1", None),
        ("urn:row:null", "revisit", 0, "urn:row:7", None), ("urn:row:7", "response", 0, None, None), ("urn:row:9", "response", len("Grüße 😀\x00 end".encode()), None, None),
    ], key=str)


def test_urls_of_odd_rows(spark):
    url = "http://a.b.example.com/" + "x/" * 3000 + "?q"
    frame = clashing(spark.createDataFrame([(1, url, "2024-02-01"), (1, url, "2024-02-01"), (None, "no url", "2024-02-01"), (3, url, None)], "page_id long, url string, d string").withColumn("fetched", F.to_date("d")))
    entries = spark.createDataFrame([("ads", "example.com/x/x", "2024-01-01", "add"), ("ads", "b.example.com", "2024-01-01", "add"), ("ads", "b.example.com", "2024-01-15", "remove")], "list string, key string, date string, action string").withColumn("date", F.to_date("date")).withColumn("url", F.lit("z"))
    got = [(r.page_id, r.lists, r["keys"]) for r in urls.filter_urls(frame, entries).collect()]
    assert got.count((1, ["ads"], ["example.com/x/x"])) == 2 and (None, [], []) in got and (3, [], []) in got


def test_words_of_the_mixture(spark):
    texts = ["a\tb\nc", " x  y ", "\x0b\x0c\r", "", None, "é ü z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(mixing.word_count(F.col("text"))).collect()]
    assert got == [len(brute.WORD.findall(t or "")) for t in texts]
    mixed = mixing.mix_sources(clashing(df.withColumn("source", F.lit("s")).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))))
    assert sorted(r.doc_id for r in mixed.collect()) == [f"k{i}" for i in range(6)]


def test_languages_of_repeated_rows(spark):
    known = [(i, t, lang) for i in range(30) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    model = language.train_language(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    rows = [(None, "the dog"), (None, "the dog"), (1, "die katze " * 30_000), (2, "123"), (3, None)]
    got = [(r.doc_id, r.lang_pred) for r in language.predict_language(clashing(spark.createDataFrame(rows, "doc_id long, text string")), model, keep=["doc_id"]).collect()]
    assert got.count((None, "en")) == 2 and {(1, "de"), (2, "und"), (3, "und")} <= set(got)
    nulls = spark.createDataFrame([(None, f"{w} w{i}", lang) for i in range(40) for w, lang in (("the", "en"), ("der", "de"))], "doc_id long, text string, lang string")
    assert language.train_language(nulls, rows_per_language=20).languages == ["de", "en"]


def test_tokens_of_a_text_without_white_space(spark):
    text = "x" * 20_000 + "\n" + "y" * 20_000
    got = tokens.count_tokens(clashing(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))).collect()
    assert len(got) == 2 and got[0].n_tokens == sum(got[0].section_tokens) > 1000 and got[0].n_sections == 2


def test_joins_on_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "other words here"), (None, "one two three four"), ("d", None)]
    got = {r.i: r.component_id for r in jaccard.jaccard_components(clashing(spark.createDataFrame(rows, "i string, text string")), "i", k=3, threshold=(9, 10)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: "a", "d": "d"}


def test_patterns_have_whole_words(spark):
    word = "w" * 200
    gaps = ["call me ", f"x {word} me ", f"{word} {word}\t\n", " one ", "", f"a b {'z ' * 60}", "é ü  "]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i int, g string")
    got = [brute.WORD.findall(r[0]) for r in df.orderBy("i").select(pii._two_before(F.col("g"))).collect()]
    assert got == [w[-2:] if len(w := brute.WORD.findall(g)) > 1 else [] for g in gaps]
    found = spark.createDataFrame([(f"{word} {word} 12345 a 6",)], "t string").select(spans.find_spans(F.col("t"), pii._INSTANCE, 4, pii._two_before).alias("s")).first().s
    assert [(s.match, s.before.split()) for s in found] == [("12345", [word, word]), ("6", [])]
