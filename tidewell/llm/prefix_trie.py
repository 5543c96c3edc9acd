"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations
that begin with it, and it is owned by the smallest. Members only get fewer on
the way down, so what a conversation owns is a suffix of its path. A sum over a
node's subtree is then a sum over its members: of the bytes of the turns on
their paths (occurrences) less those of the nodes that they own, and of flags
of leaves that they own. One group-by of (node, conversation) rows by node thus
gives members, children, leaves and saved bytes of every node.

Nodes are named by their depth and 128 bits: the exclusive or of hashes of
(place, role, text), so that names of prefixes are running values along a
conversation (``ordered.running``), whose turns may lie in many tasks. Owners
come from a group-by, which reduces before it shuffles: a window over members
would put all conversations into the root's task. Texts are hashed where they
are read; only numbers are shuffled.

Defined results: a null role or text is empty; rows without ``conv_id`` take no
part; turns go by number, nulls first, then by hashes of role and text; a
conversation of no turns is a member of the root alone; an empty table has no
nodes; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.ordered import running

_NODE = ["depth", "ka", "kb"]
EMPTY = hashlib.sha256(b"").hexdigest()
#: Turns of a conversation that are joined in one task; a longer one is cut.
BLOCK = 128


def _block(place) -> Column:
    return F.floor(place / BLOCK).cast("long")


def _spread(convs: DataFrame, last: str) -> DataFrame:
    """A row of a conversation for each block of its places up to ``last``."""
    return convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _block(F.col(last)))))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns as numbers: conv_id, its place ``nth`` from 1, two hashes of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # a hash's seed is the hash before it, so that ("ab", "c") and ("a", "bc") differ
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes")
    )
    return running(rows, ["conv"], ["turn", "a", "b"], nth="nth", label="trie-turns").drop("turn")


def rebuilt(numbered: DataFrame, *, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin with the first turns of the one that their ``family`` is named by.

    Conversation c has the first h turns of c - c % family, then its own after
    its first h, with h = crc32(c) % most. Rows: conv, depth from 0 (the root),
    hashes, bytes and the conversation's number of turns ``n``.
    """
    own = numbered.groupBy("conv").agg(F.max("nth").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = own.withColumn("base", F.col("conv") - F.col("conv") % family).join(base, "base", "left")
    lent = F.least(F.coalesce("base_own", F.lit(0)), F.col("h"))
    convs = convs.select("conv", "base", "h", "own", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    heads = numbered.where((F.col("conv") % family == 0) & (F.col("nth") < most)).select(F.col("conv").alias("base"), "nth", "a", "b", "bytes")
    # a head of fewer than ``most`` turns goes to the few conversations of its family
    first = convs.join(heads, "base").where("nth <= h").select("conv", F.col("nth").alias("depth"), "a", "b", "bytes", "n")
    long = _spread(convs.where("own > h"), "own")
    rest = numbered.withColumn("block", _block(F.col("nth"))).join(long, ["conv", "block"]).where("nth > h").select("conv", (F.col("lent") + F.col("nth") - F.col("h")).alias("depth"), "a", "b", "bytes", "n")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"), "n")
    placed = first.unionByName(rest).withColumns({"a": F.xxhash64("depth", "a", "b"), "b": F.xxhash64("b", "a", "depth")})
    return placed.unionByName(root)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas.

    Such a hash is of one sequence by definition, so the rows of a node stream
    through one task, in order, with a hash's state in memory and nothing else.
    """

    def run(batches):
        key, state, found = None, None, []
        for batch in batches:
            *keys, conv = (c.to_pylist() for c in batch.columns)
            for k, c in zip(zip(*keys, strict=True), conv, strict=True):
                if k == key:
                    state.update(b",%d" % c)
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(b"%d" % c)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=[*_NODE, "ends_sha256"])
                found = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*_NODE, "ends_sha256"])

    dealt = ends.select(*_NODE, "conv").repartition(*_NODE).sortWithinPartitions(*_NODE, "conv")
    return dealt.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """A row for each node of conversations given as ``rebuilt`` gives them."""
    occ = running(paths, ["conv"], ["depth"], nth="_nth", sums={"upto": "bytes"}, xors={"ka": "a", "kb": "b"}, label="trie-paths")
    before = F.col("upto") - F.col("bytes")
    nodes = occ.groupBy(*_NODE).agg(F.min("conv").alias("owner"), F.max("n").alias("deepest"), F.min(before).alias("before"), F.min(F.col("ka").bitwiseXOR(F.col("a"))).alias("pa"), F.min(F.col("kb").bitwiseXOR(F.col("b"))).alias("pb"))
    # where each conversation's own suffix begins, and whether it ends in a leaf of its own
    suffix = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min(F.struct("depth", "before", "pa", "pb")).alias("top"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("owner").alias("above"))
    suffix = suffix.select("conv", "top.*", "leaf").join(above, ["depth", "pa", "pb"], "left")
    ends = occ.where("depth = n")
    starts = ends.select("conv", "n", "upto").join(suffix.drop("pa", "pb"), "conv", "left")
    starts = starts.select("conv", "n", F.coalesce("depth", F.col("n") + 1).alias("start"), F.coalesce("before", "upto").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "above")
    rows = occ.withColumn("block", _block(F.col("depth"))).join(_spread(starts, "n").drop("n"), ["conv", "block"])
    found = rows.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"),
        F.min_by(F.when(F.col("depth") > F.col("start"), F.col("conv")).otherwise(F.col("above")), "conv").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("depth") + 1 >= F.col("start")) & (F.col("depth") < F.col("n"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        # bytes on the member's path from here on, less those of nodes of its own
        F.sum(F.when(F.col("depth") < F.col("start"), F.col("shared") - before).otherwise(0)).alias("saved_tokens"),
    )
    out = found.join(_digests(ends), _NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


# ------------------------------------------------------------------- query
def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(common.table(spark, sf_dir, "conversations"))))


#: CRC-32 of a text's bytes as a DuckDB macro would have it: the table of its polynomial, then a byte at a time.
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs)"""
CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(octet_length(encode({0})) AS BIGINT)), lambda k: ('0x' || substr(hex(encode({0})), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT)), lambda c, x: xor(c >> 8, crcs[CAST(xor(c & 255, x) + 1 AS BIGINT)])))"

ORACLE_SQL = f"""
WITH {CRC_SQL},
turns AS (SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) own FROM turns GROUP BY c),
convs AS (SELECT c, own, {CRC_OF.format("CAST(c AS VARCHAR)")} % 9 h FROM own, crc_table),
lent AS (SELECT convs.c, convs.h, least(convs.h, coalesce(b.own, 0)) lent FROM convs LEFT JOIN own b ON b.c = convs.c - convs.c % 5),
parts AS (
  SELECT v.c, b.n d, b.r, b.x FROM convs v JOIN turns b ON b.c = v.c - v.c % 5 AND b.n <= v.h
  UNION ALL SELECT t.c, v.lent + t.n - v.h, t.r, t.x FROM turns t JOIN lent v ON v.c = t.c AND t.n > v.h),
paths AS (
  SELECT c, d, x, string_agg(sha256(r || chr(1) || x), '/') OVER (PARTITION BY c ORDER BY d) p FROM parts
  UNION ALL SELECT c, 0, '', '' FROM convs),
deep AS (SELECT c, max(d) n FROM paths GROUP BY c),
nodes AS (SELECT p, d, min(c) conv_id, count(*) n_convs, any_value(strlen(x)) bytes FROM paths GROUP BY p, d),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) ends FROM paths JOIN deep USING (c) WHERE d = n GROUP BY p),
parents AS (SELECT u.p, v.conv_id parent, q.p parent_p FROM nodes u JOIN paths q ON q.c = u.conv_id AND q.d = u.d - 1 JOIN nodes v ON v.p = q.p AND v.d = q.d),
children AS (SELECT parent_p p, count(*) k FROM parents GROUP BY 1),
sums AS (SELECT q.p, sum((u.n_convs - 1) * u.bytes) saved, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) leaves
  FROM nodes u JOIN paths q ON q.c = u.conv_id AND q.d <= u.d LEFT JOIN children ON children.p = u.p GROUP BY q.p)
SELECT CAST(u.conv_id AS BIGINT) conv_id, CAST(u.d AS BIGINT) AS depth, CAST(parent AS BIGINT) parent_conv_id, CAST(u.n_convs AS BIGINT) n_convs,
  CAST(coalesce(k, 0) AS BIGINT) n_children, CAST(leaves AS BIGINT) n_leaves, CAST(saved AS BIGINT) saved_tokens, coalesce(ends, sha256('')) ends_sha256
FROM nodes u JOIN sums ON sums.p = u.p LEFT JOIN parents ON parents.p = u.p LEFT JOIN children ON children.p = u.p LEFT JOIN ends ON ends.p = u.p
"""
