"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by Spark from a bounded sample of labelled rows; the log-probability
matrix is broadcast, and whole texts are scored in numpy, a batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import chunks, utf8

#: n-gram lengths in characters.
NGRAMS = (1, 2, 3)
#: Most bytes that the broadcast log-probability matrix may take.
MATRIX_BYTES = 1 << 30
#: Bytes of text that are worked on at once; numpy holds some 20 times as many.
PIECE_BYTES = 1 << 18
UNDETERMINED = "und"

_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to lower-case letter, or to a space where it is no letter."""
    if not _folds:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folds.append(table)
    return _folds[0]


def _pieces(data: np.ndarray, offs: np.ndarray, reach: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, row after the last, begin, end, stop): bytes of at most about ``PIECE_BYTES``.

    Short rows come several at a time. A longer row comes in pieces that end between two
    characters; n-grams that begin in one may reach ``reach`` bytes beyond it, to stop.
    """
    for i, j in chunks(offs, PIECE_BYTES):
        at, z = int(offs[i]), int(offs[j])
        while z - at > PIECE_BYTES:
            end = at + PIECE_BYTES
            while data[end] & 0xC0 == 0x80:
                end -= 1
            stop = min(z, end + reach)
            while stop < z and data[stop] & 0xC0 == 0x80:
                stop += 1
            yield i, j, at, end, stop
            at = end
        yield i, j, at, z, z


def _grams(data: np.ndarray, offs: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bucket of the n-gram at each character, first character of that row and those after it).

    One n-gram length at a time, so that few arrays of a piece are held together. N-grams
    that leave their row or hold no letter are in bucket ``buckets``, which weighs nothing.
    """
    fold, shift = _fold(), np.uint32(32 - int(buckets).bit_length() + 1)
    longest = max(NGRAMS)
    for i, j, begin, end, stop in _pieces(data, offs, 4 * (longest - 1)):
        raw = data[begin:stop]
        c = fold[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
        begins = places[np.clip(offs[i : j + 1], begin, end) - begin]
        last = places[np.clip(offs[i + 1 : j + 1], begin, stop) - begin]
        left = np.repeat(last, np.diff(begins)) - np.arange(begins[-1], dtype=np.int32)
        h, some, letter = np.zeros(len(c), np.uint32), np.zeros(len(c), bool), c != 32
        for n in range(1, longest + 1):
            m = max(0, len(c) - n + 1)
            h[:m] += c[n - 1 :][:m]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some[:m] |= letter[n - 1 :][:m]
            if n in NGRAMS:
                bucket = ((h[: begins[-1]] * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32)
                bucket[~some[: begins[-1]] | (left < n)] = buckets
                yield i, bucket, begins


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: languages x (buckets + 1), float32; the last column is zero.
    log_prob: np.ndarray


def train_language(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 2000, buckets: int = 1 << 16) -> LanguageModel:
    """Fit on labelled rows of ``df``; rows with null text or language are left out.

    ``rows_per_language`` bounds the sample: a language with more rows gives each of them
    with that probability (by a hash of its id and text), so about that many are read whole. Repeated
    rows count each; a table without labelled rows gives a model without languages. n-grams
    fall into ``buckets`` (a power of 2) whatever the languages are; a model of
    more than ``MATRIX_BYTES`` (4,096 languages) is an error, since it is broadcast. Other
    columns are not read, whatever their names.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("text is not null and lang is not null")
    most = MATRIX_BYTES // (4 * (buckets + 1))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: the model can't be broadcast")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, buckets + 1), np.float32))
    spark = df.sparkSession
    share = spark.createDataFrame([(x, int(1e6 * min(1.0, rows_per_language / counts[x])) + 1) for x in languages], "lang string, per_million long")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("per_million")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, grams, begins in _grams(*utf8(batch.column(1)), buckets):
                for row in range(len(begins) - 1):
                    own = seen.setdefault(langs[i + row], np.zeros(buckets + 1, np.int64))
                    np.add.at(own, grams[begins[row] : begins[row + 1]], 1)
        for lang, n in seen.items():
            at = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(languages), buckets + 1))
    place = {x: k for k, x in enumerate(languages)}
    np.add.at(n, ([place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()), got.column("n").to_numpy())
    log_prob = np.log(n + 0.5) - np.log(n[:, :-1].sum(1, keepdims=True) + 0.5 * buckets)
    log_prob[:, -1] = 0
    return LanguageModel(languages, log_prob.astype(np.float32))


def predict_language(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of every row, with ``lang_pred`` and ``score``.

    Text that is null, empty or without a letter gives ``und`` with score 0, and so does
    every text where the model has no language. ``score`` is the posterior probability of
    the predicted language under equal priors; ties go to the language that sorts first.
    Columns of ``df`` named lang_pred or score are replaced. Repeated rows are scored each,
    an empty table gives an empty result, and a very long text is scored piece by piece.
    Only the text goes to Python, once.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_prob))
    text = F.col(f"`{text_col}`").cast("string")

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, log_prob = shared.value
        for column in batches:
            total = np.zeros((len(column), max(1, len(languages))))
            for i, grams, begins in _grams(*utf8(column), log_prob.shape[1] - 1) if languages else ():
                full = np.flatnonzero(begins[1:] > begins[:-1])
                if len(full):
                    for k in range(len(languages)):
                        total[i + full, k] += np.add.reduceat(log_prob[k][grams], begins[full], dtype=np.float64)
            best = total.argmax(1)
            posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            known = np.asarray(column.is_valid()) & bool(languages)
            names = pa.array([*languages, UNDETERMINED], pa.string()).take(pa.array(np.where(known, best, len(languages))))
            yield pa.StructArray.from_arrays([names, pa.array(np.where(known, posterior, 0.0))], ["lang_pred", "score"])

    name = "told"
    while name in {c.lower() for c in keep}:
        name += "_"
    # a deterministic function would run again in every filter on what it returns
    told = F.arrow_udf(score, "lang_pred string, score double").asNondeterministic()
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    out = df.select(*(F.col(f"`{c}`") for c in keep), told(F.when(has_letter, text)).alias(name))
    return out.select(*(F.col(f"`{c}`") for c in keep), f"{name}.lang_pred", f"{name}.score")
