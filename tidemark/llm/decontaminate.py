"""Benchmark decontamination by SimHash of item-sized windows, by DataFrame functions alone.

1. A window similar enough to an item holds shingles of the items of that size at as many
   positions as the similarity needs at least, and so one of any of the item's shingles
   that are more than it may lack: the rarest ones are the item's anchors. An exact join of all
   shingles of all rows against the items' gives these positions, every window with enough of
   them and an anchor is formed, and no other; that loses nothing.
2. Windows and items get 64-bit SimHash fingerprints of their shingles, weighted by count.
   The index of a row is of ``radius`` + 1 blocks of the fingerprints of those items of which
   it has an anchor; windows meet it by size, block and value. Two fingerprints within the
   radius agree in one block at least, so of the items that share an anchor with the row
   all within the radius are candidates.
3. The exact similarity of weighted shingles (sum of smaller counts / sum of larger
   counts) verifies each candidate, for all windows of a row and an item at once: no window
   is stored with its shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import let
from tidemark.llm.storage import Scratch

#: Most shingles of all items for which they are broadcast (about 40 bytes each).
BROADCAST_SHINGLES = 1_000_000
#: Bits of the bitmap in which rows with windows are looked up.
BITMAP_BITS = 1 << 26
#: Shingles that 16-bit counters of SimHash can hold; longer windows are counted bit by bit.
PACKED = 65_535
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_list(text: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a text, in order; fewer words are one shingle."""

    def of(w: Column) -> Column:
        n = F.size(w)
        whole = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w), n))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))).otherwise(whole)

    return let(word_list(text), of)


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def simhash(hashes: Column, n: Column) -> Column:
    """64-bit SimHash; sums of four bits at a time are kept in the 16-bit lanes of a long."""
    lanes = F.lit(0x0001000100010001)
    start = F.struct(*(F.lit(0).cast("long").alias(f"l{j}") for j in range(16)))
    sums = F.aggregate(hashes, start, lambda acc, h: F.struct(*((acc[f"l{j}"] + F.shiftright(h, j).bitwiseAND(lanes)).alias(f"l{j}") for j in range(16))))
    bit = lambda j: F.lit(1 << j if j < 63 else -(1 << 63))
    packed = let(sums, lambda s: _or([F.when(F.shiftrightunsigned(s[f"l{j}"], 16 * q).bitwiseAND(F.lit(0xFFFF)) * 2 > n, bit(16 * q + j)).otherwise(F.lit(0)) for j in range(16) for q in range(4)]))
    wide = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, j: F.when(
        F.aggregate(hashes, F.lit(0), lambda c, h: c + F.getbit(h, j)) * 2 > n, out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))
    ).otherwise(out))
    return F.when(n <= PACKED, packed).otherwise(wide)


def _blocks(fingerprint: Column, n: int) -> Column:
    """(block number, value) of ``n`` blocks that cover the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("value")) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))))


def _occurrences(a: Column) -> Column:
    """A hash for each value and how often it came so far, so that sets of them are multisets of values; in linear time after a sort."""

    def of(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0))))))
        return F.flatten(let(first, lambda f: F.transform(f, lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(f, k + 1), n) - i), lambda j: F.xxhash64(F.get(s, i), j)))))

    return let(F.sort_array(a), of)


def _common(a: Column, b: Column) -> Column:
    """Sum over the distinct values of ``a`` of the smaller of their counts in both."""
    repeated = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    return F.when(repeated, F.size(F.array_intersect(_occurrences(a), _occurrences(b)))).otherwise(F.size(F.array_intersect(a, b)))


def _starts(pos: Column, m: Column, n: Column, need: Column) -> Column:
    """First positions of all windows of ``m`` of ``n`` shingles that hold ``need`` of the ascending ``pos`` at least.

    The windows whose first held position is the i-th begin after the one before it, so no
    window comes twice.
    """

    def of(i: Column) -> Column:
        before = F.when(i > 0, F.get(pos, i - 1) + 1).otherwise(F.lit(0))
        low = F.greatest(F.get(pos, i + need - 1) - m + 1, before, F.lit(0))
        high = F.least(F.get(pos, i), F.greatest(n - m, F.lit(0)))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(pos) - need, F.lit(0))), of))


def _marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a hash) is among ``keys`` (key), and perhaps a few others.

    Keys are looked up in a bitmap of 8 MB at most, so that rows need no shuffle to find
    them; where it is too full to tell, more rows stay, and an exact join follows.
    """
    at = lambda k: F.pmod(k, F.lit(BITMAP_BITS)) + 1
    places = keys.select(at(F.col("key")).alias("at"))
    bits = places.groupBy(F.bitmap_bucket_number("at").alias("part_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits_"))
    out = df.withColumns({"part_": F.bitmap_bucket_number(at(key)), "bit_": F.bitmap_bit_position(at(key))}).join(F.broadcast(bits), "part_")
    byte = F.conv(F.hex(F.substring(F.col("bits_"), F.floor(F.col("bit_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.where(F.call_function("shiftright", byte, (F.col("bit_") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("part_", "bit_", "bits_")


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """(id, item, start, similarity): each row of ``df`` and item of which a window matches.

    ``start`` is the first word of the best window (the earliest of equals). A row with
    fewer words than the item is one window. Rows and items of fewer than ``k`` words are
    one shingle of all their words, so such an item matches only rows that have just these
    words, and not a longer row that contains it. Null and empty texts and items match nothing;
    rows with a null id are compared too. Repeated rows give one result, and repeated item
    ids one per id. Empty tables give an empty result. Other columns are not read, whatever
    their names.
    """
    scratch = Scratch(df.sparkSession, "leaks")
    items = benchmark.select(F.col(item_id).alias("item"), shingle_list(F.col(item_text).cast("string"), k).alias("item_hashes"))
    items = scratch.table(items.withColumn("m", F.size("item_hashes")).where("m > 0").distinct(), "items")
    total = items.agg(F.sum("m")).first()[0]
    need = F.ceil(F.col("m") * F.lit(similarity) - 1e-9).cast("int")
    # of an item's shingles a match lacks m - need at most, so it has one of the m - need + 1 rarest
    each = items.select("item", "m", F.explode(F.array_distinct("item_hashes")).alias("hash"))
    common = each.groupBy("m", "hash").agg(F.count("*").alias("in_items"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("in_items", "hash"))), F.lit(1), F.first(F.col("m") - need + 1))
    anchors = scratch.table(each.join(common, ["m", "hash"]).groupBy("item", "m").agg(rarest.alias("r")).select("item", "m", F.explode("r.hash").alias("hash")), "anchors")
    wanted = common.select("m", "hash").join(anchors.select("m", "hash", F.lit(True).alias("rare")).distinct(), ["m", "hash"], "left")
    wanted = F.broadcast(wanted) if (total or 0) <= BROADCAST_SHINGLES else wanted
    text = F.col(text_col).cast("string")
    # ids may be null or repeat: 128 bits of id and text tell rows
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.struct(F.xxhash64(F.col(id_col), text).alias("x"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("y")).alias("row"))
    placed = docs.select("id", "row", shingle_list(F.col("text"), k).alias("h"))
    hits = placed.select("id", "row", F.size("h").alias("n"), F.posexplode("h").alias("pos", "hash")).join(wanted, "hash")
    held = hits.groupBy("id", "row", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("pos"), F.collect_set(F.when(F.col("rare"), F.col("hash"))).alias("rare"))
    held = held.where((F.size("pos") >= need) & (F.size("rare") > 0))
    held = scratch.table(held.select("id", "row", "m", _starts(F.col("pos"), F.col("m"), F.col("n"), need).alias("starts"), "rare"), "held")
    texts = _marked(docs.select("text", "row"), F.col("row.x"), held.select(F.col("row.x").alias("key"))).join(held.select("row").distinct(), "row").dropDuplicates(["row"])
    texts = scratch.table(texts.select("row", shingle_list(F.col("text"), k).alias("h")), "texts")
    made = F.transform("starts", lambda s: F.struct(s.alias("start"), let(F.slice("h", s + 1, F.col("m")), lambda w: simhash(w, F.size(w))).alias("print")))
    windows = held.select("row", "m", "starts").join(texts, "row").select("row", "m", F.explode(made).alias("w")).select("row", "m", "w.*")
    n = radius + 1
    left = windows.select("row", "m", "start", "print", F.explode(_blocks(F.col("print"), n)).alias("b")).select("*", "b.*").drop("b")
    prints = items.select("item", "m", simhash(F.col("item_hashes"), F.col("m")).alias("item_print"))
    right = held.select("row", "m", F.explode("rare").alias("hash")).join(anchors, ["m", "hash"]).select("row", "m", "item").distinct().join(prints, ["item", "m"])
    right = right.select("row", "m", "item", "item_print", F.explode(_blocks(F.col("item_print"), n)).alias("b")).select("*", "b.*").drop("b")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = left.join(right, ["row", "m", "block", "value"]).where(apart <= radius).groupBy("row", "m", "item").agg(F.collect_set("start").alias("starts"))
    ids = held.select("id", "row").distinct()
    both = near.join(texts, "row").join(items.select("item", "m", "item_hashes"), ["item", "m"]).join(ids, "row")
    alike = lambda w: let(_common(F.col("item_hashes"), w), lambda c: c / (F.size(w) + F.col("m") - c))
    each = F.transform("starts", lambda s: F.struct(let(F.slice("h", s + 1, F.col("m")), alike).alias("similarity"), (-s).alias("back")))
    verified = both.select("id", "item", F.array_max(each).alias("x")).select("id", "item", "x.similarity", (-F.col("x.back")).alias("start")).where(F.col("similarity") >= similarity - 1e-12)
    best = verified.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    out = scratch.table(best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity")), "result")
    scratch.drop("items", "anchors", "held", "texts")
    return out
