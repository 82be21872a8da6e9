"""Spans of regular expressions in whole texts, by DataFrame functions alone.

Positions are code points, end exclusive. Patterns are written so that no run of
characters is scanned from each of its positions, and with possessive repeats, which take
constant stack, so that very long texts are safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running state is carried over at a time; each step copies what the part
#: has given so far, so a long list goes in parts.
_PART = 256


def find_spans(text: Column, pattern: str, kind: int, before: Callable[[Column], Column] | None = None, holds: str = "") -> Column:
    """All leftmost, non-overlapping matches as (kind, start, end, match).

    With ``before``, also what this makes of the text between the match and the one before
    it. ``holds`` is a text that is part of every match, so
    that texts without it need no search by the pattern.
    """
    fields = [
        lambda at, m, _: F.lit(kind).alias("kind"),
        lambda at, m, _: at.alias("start"),
        lambda at, m, _: (at + F.length(m)).alias("end"),
        lambda at, m, _: m.alias("match"),
    ]
    if before:
        fields.append(lambda at, m, b: before(b).alias("before"))
    kinds = "struct<kind:int,start:int,end:int,match:string" + (",before:string" if before else "") + ">"

    def place(at: Column, x: Column) -> Column:
        return F.struct(*(f(at + F.length(x["b"]), x["m"], x["b"]) for f in fields))

    def paired(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        return running(pairs, F.lit(0), lambda at, x: at + F.length(x["b"]) + F.length(x["m"]), place, kinds)

    return F.when(text.contains(holds) & text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)).otherwise(F.array().cast(f"array<{kinds}>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(array: Column) -> Column:
    """The array in consecutive parts; none for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / _PART).cast("int")), lambda k: F.slice(array, k * _PART + 1, F.lit(_PART)))


def carried(parted: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state with which each part begins."""
    return F.slice(F.aggregate(parted, F.array(start), lambda acc, part: F.concat(acc, F.array(F.aggregate(part, F.element_at(acc, -1), step)))), F.lit(1), F.size(parted))


def running(array: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit`` (of type ``kind``) of each element and the state that ``step`` has made of those before it.

    The work grows with the length of the array.
    """

    def over(part: Column, state: Column) -> Column:
        first = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out")), lambda acc: acc["out"])

    whole = lambda a: let(parts(a), lambda q: F.flatten(F.zip_with(q, carried(q, start, step), over)))
    return let(array, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast(f"array<{kind}>")))


def beside(spans: Column, words: Column, word: str) -> Column:
    """Each of ``words`` as (word, covered, next_start, entity), in order.

    ``spans`` (start, kind, end, entity) and ``words`` (start, end, ..., of type ``word``) in any
    order. ``covered``: a span that begins before the word ends within or beyond it. ``next_start``
    and ``entity`` are those of the first span that begins with or after the word, else null.
    Spans and words are sorted together and gone through once in either direction.
    """
    both = f"struct<start:int,kind:int,end:int,entity:bigint,word:{word}>"
    told = f"struct<start:int,kind:int,entity:bigint,word:{word},covered:boolean>"
    item = lambda start, kind, end, entity, w: F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), entity.alias("entity"), w.alias("word")).cast(both)
    merged = F.array_sort(F.concat(
        F.transform(spans, lambda s: item(s["start"], s["kind"], s["end"], s["entity"], F.lit(None))),
        F.transform(words, lambda w: item(w["start"], F.lit(-1), w["end"], F.lit(None), w)),
    ))
    forth = running(
        merged, F.lit(0), lambda reach, x: F.when(x["kind"] < 0, reach).otherwise(F.greatest(reach, x["end"])),
        lambda reach, x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["entity"].alias("entity"), x["word"].alias("word"), (reach > x["start"]).alias("covered")), told,
    )
    none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("long").alias("entity"))
    back = running(
        F.reverse(forth), none, lambda following, x: F.when(x["kind"] < 0, following).otherwise(F.struct(x["start"].alias("start"), x["entity"].alias("entity"))),
        lambda following, x: F.struct(x["kind"].alias("kind"), x["word"].alias("word"), x["covered"].alias("covered"), following["start"].alias("next_start"), following["entity"].alias("entity")),
        f"struct<kind:int,word:{word},covered:boolean,next_start:int,entity:bigint>",
    )
    return F.reverse(F.filter(back, lambda x: x["kind"] < 0))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of ``ordered`` spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
