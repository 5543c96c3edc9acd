from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from oracle import connect, of_spark, of_sql
from pyspark.sql import functions as F

from tidewell.llm import prefix_trie as pt
from tidewell.llm.ordered import running

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie by loops over all conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        stack, out = [node], []
        while stack:
            out.append(stack.pop())
            stack += kids[out[-1]]
        return out

    found = []
    for node, convs in members.items():
        sub = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x)
        ends = ",".join(str(c) for c in convs if len(made[c]) == len(node))
        found.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(kids[node]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_against_loops_with_nulls_and_long_conversations(spark):
    r = random.Random(5)
    rows = [(c, k, r.choice(["user", None, "tool"]), r.choice(["a", "b", "é", "", None])) for c in range(60) for k in range(r.randrange(1, 12)) if c not in (10, 25)]
    rows += [(3, k, "user", "x" * (k % 3)) for k in range(20, 400)]  # one with most of the turns
    rows += [(None, 1, "user", "lost"), (7, None, "system", "first"), (44, 3, "user", "z")]
    rows = list({(c, k): (c, k, a, b) for c, k, a, b in rows}.values())
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("depth", F.lit(9)).withColumn("conv", F.lit(1.5))
    want = plain(rows)
    for parts in (1, 7):
        assert got(pt.trie(pt.rebuilt(pt.turns(df.repartition(parts))))) == want
    assert any(n == 0 for n in [len(rows) - len(rows)]) and any(x[1] > 300 for x in want)


def test_turnless_conversations_end_at_the_root(spark):
    # c has fewer turns than its h, and nobody to borrow from
    c = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "only")]
    assert got(pt.trie(pt.rebuilt(pt.turns(spark.createDataFrame(rows, SCHEMA))))) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(pt.trie(pt.rebuilt(pt.turns(none)))) == []
    rows = [(5, 1, "user", "a"), (5, 1, "user", "a"), (6, 1, "user", "a")]
    assert got(pt.trie(pt.rebuilt(pt.turns(spark.createDataFrame(rows, SCHEMA))))) == plain(rows)


def test_running_is_the_same_over_any_ranges(spark):
    rows = [(k % 3 if k % 7 else 0, k, k * 31 % 11) for k in range(500)] + [(9, 1, 4)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    want, seen = [], {}
    for g, o, v in sorted(rows):
        n, s, x = seen.get(g, (0, 0, 0))
        seen[g] = (n + 1, s + v, x ^ v)
        want.append((g, o, v, *seen[g]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "5", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(tuple, running(df, ["g"], ["o"], nth="n", sums={"s": "v"}, xors={"x": "v"}).collect())) == want
            whole = running(df, [], ["g", "o"], nth="n").orderBy("n").collect()
            assert [tuple(r)[:2] for r in whole] == [w[:2] for w in want] and [r.n for r in whole] == list(range(1, len(rows) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query_agrees_with_its_sql(spark, sf_dir):
    assert of_spark(pt.op11_prefix_trie(spark, sf_dir)) == of_sql(connect(sf_dir), pt.ORACLE_SQL)
