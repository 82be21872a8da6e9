"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

A row's set holds its distinct k-word shingles (words lower-cased in A-Z). Two rows link
when intersection / union reaches the threshold. Rows with equal sets are one class and
the join runs between classes, so copies are never expanded into pairs.

1. A class of n tokens shares at least t n of them with any class it links to. So the
   first ``n - ceil(t n) + l`` tokens by hash, its head, hold at least ``l`` tokens that the
   partner's head holds too, and ``l`` is half a prefix. Every token of every head is
   counted exactly, by an aggregate; a class with fewer than ``l`` tokens that others
   have can link with nothing, and leaves.
2. Heads are ordered rare-first by these counts (ties by hash), which is one total order,
   and all but ``l - 1`` tokens are the prefix. Tokens that no other class has need no
   posting. Classes meet on the others under length, positional and suffix filters (sizes
   of hash ranges), and whole sets are compared last.
3. For components, the members of a bucket are first held against its leader, the class
   with the fewest tokens of its own; the leader of a group of near copies is much the
   same in all its buckets. Links made so merge classes, and pairs of one component need
   no check any more.
4. Members of other components near the leader meet by what they differ from its center in. Two
   sets that both differ little from the center link to it; otherwise two that link differ
   from it in common tokens, so prefix filtering applies again, to the differences.
   Near copies that differ from each other by more than the threshold then share no key.
   Members far from the leader meet all others of their bucket.
   No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.storage import Scratch

#: Bits of the Bloom filter in which rows are looked up whose sets are compared (8 MB), and hashes of a row.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 3
#: Times the difference at which sets still link, up to which members are near their leader.
NEAR = 5
#: Hash ranges that the suffix filter compares, the few first.
RANGES, FINE_RANGES = 16, 256


def _signature(s: np.ndarray) -> np.int64 | None:
    return np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64) if len(s) else None


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _heads(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row: class signature, set size, tokens that two heads have in common at least, and the head.

    ``l`` holds for partners of the row's size or more, ``least`` for all partners.
    """

    def common(n: int) -> int:
        overlap = -(-num * n // den)
        return max(1, min((n - overlap + 2) // 2, overlap))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size, both, least, head = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                overlap = -(-num * n // den)
                sig.append(_signature(s))
                size.append(n)
                both.append(common(n))
                least.append(common(overlap))
                head.append(s[: n - overlap + both[-1]].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(both, pa.int32()), pa.array(least, pa.int32()), _lists(head)],
                names=["id", "sig", "n", "l", "least", "head"],
            )

    return docs.select("id", "text").mapInArrow(heads, f"id {docs.schema['id'].dataType.simpleString()}, sig long, n long, l int, least int, head array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sig, n, tokens, ranges, fine): whole sets of the rows whose ids are ``wanted``, and perhaps of a few others.

    Ids are looked up in a Bloom filter of fixed size, so that the texts need no shuffle to
    find them; where it is too full to tell, more sets are made than are asked for.
    Sizes of ranges above 32,767 count as that, which only weakens the filters.
    """
    places = [F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(BLOOM_BITS)) for seed in range(BLOOM_HASHES)]
    at = wanted.select(F.explode(F.array(*places)).alias("at")).select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bloom = np.zeros(BLOOM_BITS // 8, np.uint8)
    for bucket, bits in parts:  # BLOOM_BITS / 32768 of them at most
        bloom[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in range(1, 1 + BLOOM_HASHES):
                bit = batch.column(c).to_numpy()
                keep &= (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            found = [s for s in shingle_sets(batch.column(0).filter(pa.array(keep)), k) if len(s)]
            sizes = [np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=FINE_RANGES) for s in found]
            ranges, fine = ([np.minimum(x.reshape(many, -1).sum(axis=1), 32767).astype(np.int16) for x in sizes] for many in (RANGES, FINE_RANGES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_signature, found), pa.int64()), pa.array(map(len, found), pa.int64()), _lists(found), pa.array(ranges, pa.list_(pa.int16())), pa.array(fine, pa.list_(pa.int16()))],
                names=["sig", "n", "tokens", "ranges", "fine"],
            )

    columns = [p.cast("int").alias(f"p{i}") for i, p in enumerate(places)]
    return docs.select("text", *columns).mapInArrow(sets, "sig long, n long, tokens array<long>, ranges array<smallint>, fine array<smallint>")


class _Join:
    """The tables that the steps of one join share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, k: int, threshold: tuple[int, int]):
        self.num, self.den = threshold
        if not 0 < self.num <= self.den:
            raise ValueError("threshold must be a fraction above 0 and at most 1")
        self.scratch = Scratch(df.sparkSession, "jaccard")
        docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        heads = self.scratch.table(_heads(docs, k, self.num, self.den), "heads")
        self.rows = self.scratch.table(heads.select("id", "sig", "n"), "rows")
        #: One row per class: what its members have in common, and its smallest id.
        classes = self.scratch.table(heads.where("sig is not null").groupBy("sig", "n", "l", "least").agg(F.min("id").alias("first"), F.any_value("head").alias("head")), "classes")
        self.classes = classes
        self.scratch.drop("heads")
        packed = classes.select("sig", F.explode("head").alias("token"))
        often = packed.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        shared = packed.join(often, "token").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))
        # the largest hash of the head, in an order of signed numbers
        edge = F.element_at("head", -1).bitwiseXOR(F.lit(-(1 << 63)))
        open_ = classes.select("sig", "n", "l", "least", F.size("head").alias("e"), edge.alias("edge")).join(shared, "sig").where(F.size("shared") >= F.col("least"))
        open_ = open_.withColumn("alone", F.col("e") - F.size("shared"))
        posted = self.scratch.table(open_.select("sig", "n", "l", "e", "alone", "edge", F.posexplode(F.slice("shared", F.lit(1), F.col("e") - F.col("least") + 1 - F.col("alone"))).alias("i", "x")).select(
            F.col("x.token").alias("token"), "sig", "n", "l", "e", "edge", "alone", (F.col("alone") + F.col("i")).alias("pos"), (F.col("alone") / F.col("e")).alias("own")
        ), "posted")
        leaders = posted.groupBy("token").agg(F.min_by("sig", F.struct("own", "sig")).alias("leader"), F.count("*").alias("size")).where("size > 1").select("token", "leader")
        #: Prefix tokens on which two classes or more meet, and the leader of those.
        self.postings = self.scratch.table(posted.join(leaders, "token").select("token", "leader", "sig", "n", "l", "e", "edge", "alone", "pos"), "postings")
        self.scratch.drop("posted")
        members = self.postings.select("sig").distinct()
        made = self.scratch.table(_sets(docs, classes.join(members, "sig", "left_semi").select(F.col("first").alias("id")), k), "sets")
        found, distinct = made.agg(F.count("*"), F.count_distinct("sig")).first()
        if found > distinct:  # where ids repeat, a class may come more than once
            made = self.scratch.table(made.groupBy("sig").agg(F.any_value(F.struct("n", "tokens", "ranges", "fine")).alias("x")).select("sig", "x.*"), "sets-once")
        self.sets = made

    def length(self, a: str, b: str) -> Column:
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num

    def near(self, a: str, b: str) -> Column:
        """The length filter, and the positional filters of two postings of one token.

        Of the tokens before it, those that no other class has are in one set alone. What
        is in the head that ends first, and not in the other head, is not in the other set.
        """
        x, y = ({c: F.col(f"{s}.{c}") for c in ("n", "e", "pos", "alone", "edge")} for s in (a, b))
        before = F.least(x["pos"] - x["alone"], y["pos"] - y["alone"])
        common = before + F.least(x["e"] - x["pos"], y["e"] - y["pos"])
        apart = F.when(x["edge"] <= y["edge"], 2 * (x["pos"] - before) + y["n"] - x["n"]).otherwise(2 * (y["pos"] - before) + x["n"] - y["n"])
        return self.length(a, b) & (common >= F.least(f"{a}.l", f"{b}.l")) & (apart * (self.num + self.den) <= (x["n"] + y["n"]) * (self.den - self.num))

    def alike(self, a: str, b: str, sizes: str = "ranges") -> Column:
        """The suffix filter: what the sizes of two sets' hash ranges differ is in one of them alone."""
        apart = F.aggregate(F.zip_with(f"{a}.{sizes}", f"{b}.{sizes}", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
        return apart * (self.num + self.den) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (self.den - self.num)

    def compared(self, pairs: DataFrame, name: str, over: int, under: int, difference: bool = False) -> DataFrame:
        """(u, v, nu, nv, apart) of those ``pairs`` that differ in at most over / under of both sizes together.

        The suffix filter on fine ranges comes first (pairs by differences have not met it), then whole sets are compared, which
        are made for the classes in postings alone. With ``difference`` also what they differ in.
        """
        u, v = (self.sets.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}")) for x in "uv")

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (b.column(c).flatten().to_numpy().reshape(-1, FINE_RANGES).astype(np.int32) for c in ("fu", "fv"))
                total = b.column("nu").to_numpy() + b.column("nv").to_numpy()
                yield b.select(["u", "v"]).filter(pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) * under <= over * total))

        kept = self.scratch.table(pairs.join(u, "u").join(v, "v").mapInArrow(close, "u long, v long"), f"{name}-kept")
        x, y = (self.sets.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(t)) for c, t in (("u", "x"), ("v", "y")))
        both = kept.join(x, "u").join(y, "v").withColumn("apart", F.col("nu") + F.col("nv") - 2 * F.size(F.array_intersect("x", "y"))).where(F.col("apart") * under <= over * (F.col("nu") + F.col("nv")))
        differ = [F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("differ")] if difference else []
        out = self.scratch.table(both.select("u", "v", "nu", "nv", "apart", *differ), name)
        self.scratch.drop(f"{name}-kept")
        return out

    def linked(self) -> Column:
        return F.col("apart") * (self.num + self.den) <= (F.col("nu") + F.col("nv")) * (self.den - self.num)

    def met(self, members: DataFrame) -> DataFrame:
        """Pairs of members of a bucket (as ``postings``, with comp and far) of different components, of which one is far.

        A pair meets on each token that both prefixes have, so the fine ranges are compared
        where it meets: hardly a pair that doesn't link is made then.
        """
        wanted = members.where("far").select("token").distinct()
        p = members.join(wanted, "token", "left_semi").join(self.sets.select("sig", "ranges", "fine"), "sig")
        a, b = p.where("far").alias("a"), p.alias("b")
        once = ~F.col("b.far") | (F.col("a.sig") > F.col("b.sig"))
        met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & once & self.near("a", "b") & self.alike("a", "b") & self.alike("a", "b", "fine"))
        return met.select(F.greatest("a.sig", "b.sig").alias("u"), F.least("a.sig", "b.sig").alias("v"))

    def centers(self, close: DataFrame) -> DataFrame:
        """(u, center): of those near each leader u (u, v, apart, differ), and u, the one that most agrees with them all.

        A token in which more than half of them differ from the leader is one that their
        consensus differs in; the center is the nearest to the consensus.
        """
        token = close.select("u", "v", F.explode("differ").alias("token"))
        many = close.groupBy("u").agg(F.count("*").alias("k"))
        agreed = token.groupBy("u", "token").agg(F.count("*").alias("c")).join(many, "u").where("2 * c > k + 1").select("u", "token")
        agreed = self.scratch.table(agreed, "agreed")
        size = agreed.groupBy("u").agg(F.count("*").alias("of"))
        held = token.join(agreed, ["u", "token"]).groupBy("u", "v").agg(F.count("*").alias("held"))
        far = F.col("apart") + F.coalesce("of", F.lit(0)) - 2 * F.coalesce("held", F.lit(0))
        scored = close.select("u", "v", "apart").join(held, ["u", "v"], "left").join(size, "u", "left").select("u", "v", far.alias("far"))
        leaders = many.join(size, "u", "left").select("u", F.col("u").alias("v"), F.coalesce("of", F.lit(0)).alias("far"))
        return scored.unionByName(leaders).groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("center"))

    def deviating(self, members: DataFrame) -> DataFrame:
        """Pairs of different components that differ from one center in common tokens.

        ``members`` (center, sig, comp, n, d, differ): d tokens in which a set differs from the
        center. Two that link differ in w = (1 - t) / t n tokens at most, and n is of
        either; so of d tokens the smaller d misses w / 2 at most, the larger w.
        """
        token = members.select("center", "sig", F.explode("differ").alias("token"))
        often = token.groupBy("center", "token").agg(F.count("*").alias("c")).where("c > 1")
        shared = token.join(often, ["center", "token"]).groupBy("center", "sig").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))
        p = members.select("center", "sig", "comp", "n", "d").join(shared, ["center", "sig"]).withColumn("alone", (F.col("d") - F.size("shared")).cast("int"))
        p = p.withColumn("w", F.floor(F.col("n") * (self.den - self.num) / self.num + 1e-9).cast("int"))
        p = p.select("center", "sig", "comp", "n", "d", "w", "alone", F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.col("w") + 1 - F.col("alone"), F.lit(0)))).alias("i", "x"))
        p = self.scratch.table(p.select("center", F.col("x.token").alias("token"), "sig", "comp", "n", "d", "alone", (F.col("alone") + F.col("i")).alias("pos"), "w"), "deviations")
        a, b = p.where(F.col("pos") <= F.floor(F.col("w") / 2)).alias("a"), p.alias("b")
        first = F.struct("a.d", "a.sig") < F.struct("b.d", "b.sig")
        most = F.least(F.col("a.d") - F.col("a.pos"), F.col("b.d") - F.col("b.pos")) + F.least(F.col("a.pos") - F.col("a.alone"), F.col("b.pos") - F.col("b.alone"))
        enough = (F.col("a.d") + F.col("b.d") - 2 * most) * (self.num + self.den) <= (F.col("a.n") + F.col("b.n")) * (self.den - self.num)
        met = a.join(b, (F.col("a.center") == F.col("b.center")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & first & self.length("a", "b") & enough)
        return met.select(F.greatest("a.sig", "b.sig").alias("u"), F.least("a.sig", "b.sig").alias("v"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``.

    ``component_id`` is the smallest id that links reach from the row, its own included.
    Rows without words (or with null text) have size 0 and link with nothing. Every input
    row gives one output row, also when ids repeat; a null id is ignored as a component's
    smallest unless all are null, and ids are of any type that has an order. An empty table gives an empty result. Other columns of
    ``df`` are not read, whatever their names. Set and class identity rest on 64-bit hashes.
    """
    j = _Join(df, id_col, text_col, k, threshold)
    num, den = threshold
    led = j.scratch.table(j.postings.where("sig <> leader").select(F.col("leader").alias("u"), F.col("sig").alias("v")).distinct(), "led")
    # near a leader is any set that differs from it by NEAR times as much as linked sets may, at most
    close = j.compared(led, "close", NEAR * (den - num), num + den, difference=True)
    # where all that are near a leader link to it, they are one component already
    near = close.join(close.where(~j.linked()).select("u").distinct(), "u", "left_semi")
    centers = j.scratch.table(j.centers(near), "centers")
    around = near.select("u", "v").unionByName(centers.select("u", F.col("u").alias("v"))).join(centers, "u")
    around = j.scratch.table(around.where("v <> center").select(F.col("center").alias("u"), "v").distinct(), "around")
    new = j.compared(around.join(close, ["u", "v"], "left_anti"), "centred", 1, 1, difference=True)
    centred = new.unionByName(close.join(around, ["u", "v"], "left_semi"))
    links = close.where(j.linked()).select("u", "v").unionByName(new.where(j.linked()).select("u", "v"))
    comps = j.scratch.table(connected_components(links, j.scratch, "cc1"), "comps")
    p = j.postings.join(comps, j.postings["sig"] == comps["node"], "left").select(*j.postings.columns, F.coalesce("root", "sig").alias("comp"))
    p = j.scratch.table(p, "labelled")
    mixed = p.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    p = p.join(mixed, "token").where("sig <> leader").join(close.select(F.col("u").alias("leader"), F.col("v").alias("sig"), F.lit(False).alias("far")), ["leader", "sig"], "left")
    p = j.scratch.table(p.withColumn("far", F.coalesce("far", F.lit(True))), "mixed")
    members = p.where("not far").join(centers, p["leader"] == centers["u"]).where("sig <> center").select("center", "sig", "comp", "n").distinct()
    members = members.join(centred.select(F.col("u").alias("center"), F.col("v").alias("sig"), F.col("apart").alias("d"), "differ"), ["center", "sig"])
    done = [x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) for x in (led, new)]
    rest = j.met(p).unionByName(j.deviating(members)).distinct().join(done[0].unionByName(done[1]), ["u", "v"], "left_anti")
    more = j.compared(rest, "more", den - num, num + den)
    # the links that are new join components, so the second round is on components alone
    root = lambda c: comps.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = more.select("u", "v").join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).distinct()
    merged = connected_components(joined, j.scratch, "cc2").select(F.col("node").alias("comp"), F.col("root").alias("whole"))
    labelled = j.classes.join(comps, j.classes["sig"] == comps["node"], "left").select("sig", "first", F.coalesce("root", "sig").alias("comp"))
    labelled = labelled.join(merged, "comp", "left").select("sig", "first", F.coalesce("whole", "comp").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    ids = labelled.join(smallest, "comp").select("sig", "component_id")
    out = j.rows.select("id", "n", "sig").join(ids, "sig", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    out = j.scratch.table(out, "result")
    j.scratch.drop("rows", "classes", "postings", "sets", "sets-once", "led", "close", "agreed", "centers", "around", "centred", "comps", "labelled", "mixed", "deviations", "more")
    return out


def jaccard_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (8, 10)) -> tuple[DataFrame, DataFrame]:
    """All links between classes as (class_a, class_b, common, total), and membership as (id, class_id).

    A class is named by its smallest id. Rows without words are in no class. The work
    grows with the number of links, which is the result.
    """
    j = _Join(df, id_col, text_col, k, threshold)
    num, den = threshold
    pairs = j.met(j.postings.withColumns({"comp": F.col("sig"), "far": F.lit(True)})).distinct()
    links = j.compared(pairs, "all", den - num, num + den)
    names = j.classes.select("sig", "first")
    total = F.col("nu") + F.col("nv")
    pairs = (
        links.join(names.select(F.col("sig").alias("u"), F.col("first").alias("x")), "u").join(names.select(F.col("sig").alias("v"), F.col("first").alias("y")), "v")
        .select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), ((total - F.col("apart")) / 2).cast("long").alias("common"), ((total + F.col("apart")) / 2).cast("long").alias("total"))
    )
    return pairs, j.rows.join(names, "sig").select(F.col("id").alias(id_col), F.col("first").alias("class_id"))
