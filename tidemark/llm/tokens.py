"""Token counts by section: whole documents are encoded once, and tokens go to sections by offsets.

A token belongs to the section in which most of its characters lie; of equals, to the
earliest. That rule settles tokens that cross a boundary, so the sections' counts always
add up to the document's.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shingles import utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's merges split a text (fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[path] = (tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _encoders[path]


def token_spans(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (both inclusive) of each token of a text in UTF-8."""
    ends = np.cumsum(lengths[ids])
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    return chars[ends - lengths[ids]], chars[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary.

    Sections begin at the sorted characters ``begins``, the first at 0, and each reaches to the next.
    """
    a, z = np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, last, "right") - 1
    owner = a.copy()
    crossing = np.flatnonzero(z > a)
    for t in crossing:
        edges = np.concatenate([[first[t]], begins[a[t] + 1 : z[t] + 1], [last[t] + 1]])
        owner[t] = a[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(begins)), len(crossing)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing, section_tokens) for every row of ``df``.

    Sections are the pieces between separators (one character), each with its separator;
    ``section_tokens`` has their tokens in order. Null and empty texts have no token and
    no section. Every input row gives one output row, also when rows repeat, and an empty
    table an empty result; very long texts are encoded whole, and other columns are not read,
    whatever their names. The vocabulary file is at its path on every machine, or it is a
    name that ``SparkContext.addFile`` has sent to all of them.
    """
    mark = separator.encode()
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(vocabulary)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            n, sections, crossing, per = [], [], [], []
            for row in range(batch.num_rows):
                raw = data[offs[row] : offs[row + 1]].tobytes()
                if not raw:
                    n.append(0), sections.append(0), crossing.append(0), per.append(np.zeros(0, np.int64))
                    continue
                text = raw.decode("utf-8")
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                first, last = token_spans(raw, ids, lengths)
                at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord(mark.decode())) + 1
                begins = np.concatenate([[0], at[at < len(text)]])
                counts, crossed = attribute(first, last, begins)
                n.append(len(ids)), sections.append(len(begins)), crossing.append(crossed), per.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.array(per, pa.list_(pa.int64()))],
                names=["id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>").withColumnRenamed("id", id_col)
