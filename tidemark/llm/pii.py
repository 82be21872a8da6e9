"""Personal data: four patterns, and bootstrapped contextual extraction of further identifiers.

Seed entities (the patterns' matches) induce lexical patterns: the two words before them.
Spark scores the bipartite graph of patterns and instances in rounds: a pattern is as good
as the instances it brings, an instance as good as its best pattern. Patterns of high
confidence that enough different seeds support then discover identifiers that the seed
patterns miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import beside, carried, count_kind, find_spans, joined, let, ordered, parts
from tidemark.llm.storage import Scratch

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins where the run of its characters begins, or where the last match ended.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit.
_INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: The last two words of a text, and characters in which they are looked for first.
_TWO, _CLOSE = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$", 80


def _two_before(gap: Column) -> Column:
    """The last two words of what is between two matches, whole however long they are; empty where there are fewer."""
    close = F.regexp_extract(F.right(gap, F.lit(_CLOSE)), rf"[\x20\x09-\x0D]({_TWO})", 1)
    whole = F.regexp_extract(gap, rf"(?<![^\x20\x09-\x0D])({_TWO})", 1)
    return F.when(close != "", close).otherwise(whole)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["sum"] % 10 == 0)


def base_spans(text: Column) -> Column:
    """Spans of the four patterns; a match that fails its test is dropped and not tried again."""

    def part(x: Column) -> Column:
        short = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)

    def card(s: Column) -> Column:
        digits = F.regexp_replace(s["match"], r"[\x20-]", "")
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))

    return F.concat(
        find_spans(text, _EMAIL, 0, holds="@"),
        F.filter(find_spans(text, _IP, 1), lambda s: F.forall(F.split(s["match"], r"\."), part)),
        F.filter(find_spans(text, _CARD, 2), card),
        F.filter(find_spans(text, _PHONE, 3, holds="+"), lambda s: F.length(F.regexp_replace(s["match"], "[^0-9]", "")).between(9, 15)),
    )


def _scores(edges: DataFrame, scratch: Scratch, rounds: int, support: int) -> DataFrame:
    """(pattern, confidence) after some rounds over ``edges`` (pattern, instance, n, seed)."""
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for k in range(rounds):
        scored = edges.join(instances, "instance")
        patterns = scratch.table(scored.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"), F.sum("seed").alias("seeds")
        ).where(F.col("seeds") >= support).select("pattern", "confidence"), f"patterns-{k}")
        if k + 1 < rounds:
            reached = edges.join(patterns, "pattern", "left").groupBy("instance").agg(F.max("seed").cast("double").alias("s"), F.max("confidence").alias("c"))
            instances = reached.select("instance", F.greatest("s", F.coalesce("c", F.lit(0.0))).alias("score"))
    return patterns


_WORD = "struct<start:int,end:int,core:string,pattern:string>"


def _word(w: Column) -> Column:
    """Of a word, the part between its first and last letter, digit or sign that an identifier begins with, and its pattern."""
    core = F.regexp_extract(w["match"], r"[\p{L}0-9+#@](?:.*[\p{L}0-9])?", 0)
    two = F.lower(w["before"])

    def of(x: Column) -> Column:
        start = w["start"] + F.instr(w["match"], x) - 1
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("core"), F.regexp_replace(F.trim(two), r"[\x20\x09-\x0D]+", " ").alias("pattern"))

    return let(core, of)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.8, digits: int = 4) -> DataFrame:
    """(id, row_hash, spans) for every row of ``df``; spans are (start, kind, end) by start.

    ``support`` different seed instances have to occur with a pattern, and its confidence
    has to reach the bound, before its other instances with ``digits`` digits or more
    become spans of kind ``context``. These touch no base span; base spans stay as they
    are. Null and empty texts have no span. Every input row gives one output row, also
    when rows repeat; ``row_hash`` (of id and text) tells rows of one id apart. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", F.xxhash64("id", text).alias("row_hash"), base_spans(text).alias("base"), find_spans(text, _INSTANCE, 4, _two_before).alias("words")
    )
    spans = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["match"]).alias("entity"))))
    rows = rows.select("id", "row_hash", spans.alias("base"), F.filter(F.transform("words", _word), lambda w: w["pattern"] != "").alias("words"))
    placed = F.when(F.size("base") > 0, beside(F.col("base"), F.col("words"), _WORD)).otherwise(
        F.transform("words", lambda w: F.struct(F.lit(-1).alias("kind"), w.alias("word"), F.lit(False).alias("covered"), F.lit(None).cast("int").alias("next_start"), F.lit(None).cast("long").alias("entity"))))
    rows = scratch.table(rows.select("id", "row_hash", ordered(F.col("base")).alias("base"), placed.alias("words")), "rows")
    words = rows.select("id", "row_hash", F.explode("words").alias("w")).select("id", "row_hash", "w.word.*", "w.covered", "w.entity", F.coalesce(F.col("w.next_start") < F.col("w.word.end"), F.lit(False)).alias("begins"))
    # the later words of an entity say nothing about the words before them
    graph = words.where("begins or not covered").select(
        "id", "row_hash", "pattern", F.when(F.col("begins"), F.col("entity")).otherwise(F.xxhash64(F.lower("core"))).alias("instance"),
        "core", "start", "end", F.col("begins").cast("int").alias("seed"),
    )
    graph = scratch.table(graph, "words")
    edges = scratch.table(graph.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    good = _scores(edges, scratch, rounds, support).where(F.col("confidence") >= confidence)
    new = graph.where((F.col("seed") == 0) & (F.length(F.regexp_replace("core", "[^0-9]", "")) >= digits)).join(good, "pattern")
    extra = new.groupBy("id", "row_hash").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("extra"))
    both = rows.select("id", "row_hash", "base").alias("r").join(extra.alias("e"), F.col("r.id").eqNullSafe(F.col("e.id")) & (F.col("r.row_hash") == F.col("e.row_hash")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return both.select(F.col("r.id").alias(id_col), F.col("r.row_hash").alias("row_hash"), spans.alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``find_pii`` in ``text_col`` replaced by its kind in angle brackets.

    Rows and other columns stay as they are; overlapping spans become one, named by the
    first. Null and empty texts stay; repeated rows and ids are each cleaned, an empty table
    gives an empty result, and the work grows with the length of a text. Columns of ``df`` keep their names and order.
    """
    columns = df.columns
    found = find_pii(df, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_hash"), "spans").distinct()
    packed = df.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    both = packed.join(found, F.col(f"row.{id_col}").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")), "left")
    text, names = F.col(f"row.{text_col}"), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    reach = lambda at, s: F.greatest(at, s["end"])

    def cleaned(part: Column, at: Column, begin: Column, stop: Column) -> Column:
        """Of the text from ``begin`` to ``stop``, where the spans of ``part`` begin, what is beyond ``at``."""

        def over(region: Column) -> Column:
            between = lambda a, z: F.substring(region, a - begin + 1, z - a)

            def step(acc: Column, s: Column) -> Column:
                piece = F.concat(between(acc["at"], s["start"]), F.element_at(names, s["kind"] + 1))
                return F.struct(reach(acc["at"], s).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

            first = F.struct(F.greatest(at, begin).alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(part, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.when(acc["at"] < stop, between(acc["at"], stop)).otherwise("")))

        return let(F.substring(text, begin + 1, stop - begin), over)

    def joined_parts(q: Column) -> Column:
        begins = F.transform(q, lambda part, i: F.when(i == 0, F.lit(0)).otherwise(F.get(part, F.lit(0))["start"]))
        stops = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.length(text)))
        where = F.arrays_zip(carried(q, F.lit(0), reach).alias("at"), begins.alias("begin"), stops.alias("stop"))
        return F.array_join(F.zip_with(q, where, lambda part, x: cleaned(part, x["at"], x["begin"], x["stop"])), "")

    clean = let(parts(F.col("spans")), joined_parts)
    return both.select(*(F.when(F.col("spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns))


def pii_digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) of ``find_pii``."""
    base = F.filter(F.col("spans"), lambda s: s["kind"] < 4)
    return find_pii(df).select(
        "doc_id", *(count_kind(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(5)),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )
