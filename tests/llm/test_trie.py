"""The prefix trie against a plain version."""

import hashlib
import random
import zlib

from tests.conftest import SF
from tidemark.llm.queries import op13_prefix_trie
from tidemark.llm.trie import grafted, in_order, member_digests, node_texts, prefix_trie, trie_nodes, turn_ids

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    """Turns (role, text) of each conversation by turn, null first; ties by digest."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    return {c: [t for _, t in sorted(turns, key=lambda t: t[0])] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[h:]
    return out


def trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m for m in members if len(convs[m]) == len(p)))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, node string, block int, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def sample(seed=1):
    rng, rows = random.Random(seed), []
    for c in [*range(-7, 30), 10**12]:
        for turn in range(rng.choice([1, 2, 3, 9, 17])):
            rows.append((c, turn, rng.choice(["user", "user", "tool", None]), rng.choice(["hi", "hi", "grüße", "", None, f"t{rng.randrange(3)}"])))
    rows += [(c, t, "user", f"{t % 4}") for c in (40, 41, 42) for t in range(60 + c)]
    rows += [(3, None, "user", "none"), (3, 0, "user", "again"), (3, 0, "user", "again"), (None, 1, "user", "lost"), (50, -5, "a", "x"), (50, 1 << 40, "b", "y")]
    return rows + [(c, t, "user", "copy") for c in range(100, 130) for t in range(3)]


def test_trie_against_plain_version(spark):
    rows = sample()
    for width in (8, 2):
        assert rows_of(prefix_trie(frame(spark, rows), width=width)) == trie(ordered(rows))


def test_grafted_trie_against_plain_version(spark):
    rows = sample(2)
    got = trie_nodes(*grafted(in_order(turn_ids(frame(spark, rows)))))
    assert rows_of(got) == trie(rebuilt(ordered(rows)))


def test_trie_of_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_prefix_trie(spark, SF)) == trie(rebuilt(ordered(table)))


def test_texts_and_empty_tables(spark):
    df = frame(spark, [(1, 1, "user", "a"), (1, 2, None, None), (2, 1, "user", "a")])
    got = node_texts(prefix_trie(df), df.select("role", "text"))
    assert sorted((r["depth"], r["role"], r["text"]) for r in got.collect() if r["depth"]) == [(1, "user", "a"), (2, "", "")]
    assert rows_of(prefix_trie(df.where("false"))) == [] and rows_of(prefix_trie(df.withColumn("conv_id", df.conv_id * None))) == []


def test_members_stream_through_the_digest(spark):
    """More ids than a piece holds, among other nodes."""
    ends = spark.range(20_000).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('n', id) END AS node", "id AS conv_id")
    got = {r["node"]: r["sha"] for r in member_digests(ends.repartition(7)).collect()}
    hot = ",".join(str(i) for i in range(20_000) if i % 3 < 2)
    assert got["hot"] == hashlib.sha256(hot.encode()).hexdigest() and got["n2"] == hashlib.sha256(b"2").hexdigest() and len(got) == 1 + 6666
