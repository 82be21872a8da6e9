"""Secret scans: three patterns, and character Markov models of random strings and identifiers.

Both models are first-order over the characters a token may have, with add-one smoothing,
trained from labelled samples. A token is a secret where the log-likelihood ratio per
character reaches a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import beside, count_kind, find_spans, joined, ordered

KINDS = ("assign", "access", "hex", "markov")
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
#: Characters of a token; any other is class 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_CLASSES = len(ALPHABET) + 1
#: Shortest token that the models judge.
LEAST = 20
_TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
_TOKEN_TYPE = "struct<kind:int,start:int,end:int,match:string>"


def base_spans(text: Column) -> Column:
    """Spans of the patterns; a match that fails its length is dropped and not tried again."""
    assign = F.filter(find_spans(text, _ASSIGN + f"{_VALUE}++", 0), lambda s: F.length(F.regexp_replace(s["match"], "^" + _ASSIGN, "")) >= 8)
    return F.concat(assign, find_spans(text, "AKIA[A-Z0-9]{12,}+", 1, holds="AKIA"), find_spans(text, "[0-9a-f]{32,}+", 2))


def labelled_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = 1000, strings: int = 4000) -> DataFrame:
    """(token, random): labelled samples for ``train``.

    ``strings`` generated random strings of three alphabets (and as many again in each),
    and words and joined words (snake, kebab, camel, path) of about ``rows`` whole rows,
    which are chosen by a hash of id and text; these are the documented bounds of the sample.
    """
    n = df.count()
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    made = df.sparkSession.range(strings).select(F.explode(F.array(
        digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)),
    )).alias("token"), F.lit(1).alias("random"))
    picked = df.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, rows / max(1, n)))).select(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]{2,}+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.array(
        a, F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(a, F.initcap(b)), F.concat(a, F.lit("/"), b, F.lit("1")),
    )).otherwise(F.array(a)))
    ordinary = picked.select(F.explode(F.flatten(pairs)).alias("token"), F.lit(0).alias("random"))
    return made.unionByName(ordinary)


def train(tokens: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of character classes, row by row.

    ``tokens`` (token, random 0/1). The collected table has two counts for each pair of
    characters of the alphabet, whatever the sample is.
    """
    chars = tokens.where(F.length("token") > 1).select("random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    code = lambda at: F.instr(F.lit(ALPHABET), F.expr(f"substring(token, {at}, 1)"))
    counts = {(r[0], r[1]): r[2] for r in chars.groupBy("random", (code("i") * _CLASSES + code("i + 1")).alias("pair")).count().collect()}
    llr = [0.0] * (_CLASSES * _CLASSES)
    for a in range(_CLASSES):
        total = [sum(counts.get((r, a * _CLASSES + b), 0) for b in range(_CLASSES)) + _CLASSES for r in (0, 1)]
        for b in range(_CLASSES):
            k = a * _CLASSES + b
            llr[k] = math.log((counts.get((1, k), 0) + 1) / total[1]) - math.log((counts.get((0, k), 0) + 1) / total[0])
    return llr


def ratio(token: Column, llr: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's character pairs, in one pass over it."""
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in llr) + "', ',') as array<double>)")

    def step(acc: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c)
        add = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, acc["last"] * _CLASSES + code + 1))
        return F.struct((acc["sum"] + add).alias("sum"), code.alias("last"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def scan_secrets(df: DataFrame, llr: list[float], text_col: str = "text", threshold: float = 1.0, out: str = "secrets") -> DataFrame:
    """Every row of ``df`` with an array column ``out`` of (start, kind, end), by start.

    Null and empty texts have none. Every row is scanned whole, also when rows repeat or texts
    are very long, and the work grows with the length; an empty table gives an empty result. Base spans stay as they are; a token that touches one
    is not judged. A column that is named ``out`` already is replaced; no other is read
    but ``text_col``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.withColumn(out, F.struct(base_spans(text).alias("base"), find_spans(text, _TOKEN, 3).alias("tokens")))
    base, tokens = F.col(f"{out}.base"), F.col(f"{out}.tokens")
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).cast("long").alias("entity")))
    clear = F.filter(beside(spans, tokens, _TOKEN_TYPE), lambda x: ~x["covered"] & F.coalesce(x["next_start"] >= x["word"]["end"], F.lit(True)))
    clear = F.when(F.size(base) > 0, F.transform(clear, lambda x: x["word"])).otherwise(tokens)
    judged = F.filter(clear, lambda s: ratio(s["match"], llr) >= threshold)
    return found.withColumn(out, ordered(F.concat(base, judged)))


def scanned_digest(df: DataFrame) -> DataFrame:
    """One row for every row of ``df``, nulls and repeats included: (doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan_secrets`` with a model of the rows' own sample."""
    llr = train(labelled_tokens(df))
    rows = scan_secrets(df.select("doc_id", "text"), llr).select("doc_id", "secrets")
    base = F.filter(F.col("secrets"), lambda s: s["kind"] < 3)
    return rows.select(
        "doc_id", *(count_kind(F.col("secrets"), k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("secrets"), KINDS).alias("spans"),
    )
