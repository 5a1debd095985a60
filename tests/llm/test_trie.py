from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import functions as F

from viatica.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string, node int, depth string, part long"


def brute(rows):
    """The nodes of rows (conv_id, turn, role, text), by the definition."""
    turns: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(donor, [])[:h] + own[h:])
    members: dict = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(1 for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below))
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(made[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_edges(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"w{(c * t) % 3} x") for c in range(60) for t in range(c % 6)]
    rows += [(100 + c, t, "user", "same words here") for c in range(25) for t in range(4)]  # copies; one block's head goes to another's
    rows += [(200, None, None, None), (200, None, "a", "first"), (200, 1, "", "é  ü\tx y"), (201, 5, "user", ""), (201, 5, "user", ""), (201, 5, "ab", "c"), (201, 5, "a", "bc")]
    rows += [(None, 1, "user", "no id"), (-7, 1, "user", "minus"), (-27, 2, "user", "minus"), (-20, 1, "user", "head"), (0, 3, "user", "more")]
    rows += [(300, t, "user", f"long {t}") for t in range(500)] + [(301, t, "user", f"long {t}") for t in range(8)]  # a long chain
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND)
    want = brute(rows)
    assert len(want) > 500 and built(trie.trie(df)) == want
    assert built(trie.trie(df.limit(0))) == []
    assert built(trie.trie(df.filter("conv_id = 301"))) == brute([r for r in rows if r[0] == 301])


def test_turnless(spark):
    """Conversations that are rebuilt to no turns end at the root; h turns that a head lacks are not made up."""
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in range(400)}
    short = [c for c in range(41, 400) if heads[c] >= 2 and c % 20]
    rows = [(c, 1, "user", "gone") for c in short] + [(20 * (short[0] // 20), 1, "user", "head of one")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND)
    got = built(trie.trie(df))
    assert got == brute(rows) and any(r[1] == 0 and r[7] != trie.NOTHING for r in got)


def test_crossing_partitions(spark):
    """One conversation with most turns crosses many partitions; a list of ends crosses pieces."""
    rows = [(7, t, "user", f"t{t % 11}") for t in range(3000)] + [(c, t, "user", f"t{t % 11}") for c in (8, 10) for t in range(40)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(20)
    placed, convs = trie.numbered_turns(df)
    assert sorted(r.pos for r in placed.filter("conv_id = 7").collect()) == list(range(1, 3001)) and convs.filter("conv_id = 7").first().n == 3000
    ends = spark.range(100_000).select(F.lit(2).alias("depth"), F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("end"))
    got = trie.ends_hashed(ends.repartition(9)).collect()
    assert [tuple(r) for r in got] == [(2, 5, hashlib.sha256(",".join(map(str, range(100_000))).encode()).hexdigest())]


def test_query_is_its_sql(same):
    same(queries.QUERIES["op13_trie"], queries.ORACLES["op13_trie"])
