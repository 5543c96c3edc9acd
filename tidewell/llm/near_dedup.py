"""Near-duplicate classes by order MinHash.

A sketch takes, by one hash function, the ``KEEP`` smallest occurrence-labelled
five-word shingles of a text and keeps them in text order, so that it agrees
for texts that share shingles and their order. ``ROWS`` sketches make a bucket
key, ``BANDS`` keys a text. Candidates are verified by banded alignment of
their shingle sequences: with M aligned shingles the similarity is
M / (n1 + n2 - M), and 0.8 or more is a link. Classes are the connected texts.

Equal texts are one node, found by digest, before anything is compared. Inside
a bucket nobody emits all pairs: each member is compared with the bucket's most
popular text (that whose buckets are largest, which is the one its copies were
made from, where there is one). Where a bucket still holds several classes, an
index of its members' shingles finds for each that is apart the members that
share enough shingles to be a link, and those are verified. Buckets beyond
``SMALL`` texts, too large for one task, have the members apart from their
centre dealt again by two keys in common, round by round, until no bucket holds
more than one class. What is then still outside the largest class of such a
bucket is joined with all texts of large buckets by an exact prefix filter over
labelled shingles, rarest first (``crossed``). No bucket is capped.

Defined results: equal texts are of one class, and so are texts without words
if equal; a null text is a class of its own; fewer than five words are one
shingle; a class's id is its smallest document id (null ids come last); rows
that repeat belong to their text's class; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm import shingles as sh

KEEP, ROWS, BANDS = 2, 2, 14
#: Groups of up to so many texts and shingles are settled in one task.
SMALL, SMALL_SHINGLES = 4096, 2_000_000
SIMILARITY = 0.8
#: Shingles that are hashed at once, to bound memory on very long texts.
CHUNK = 8192
#: Slots of the counts by which shingles are ordered, rarest first, and the texts that a shingle may have before it is salted.
SLOTS, SALT = 1 << 20, 2000
#: Tasks over which the rows of a key with more than ``SALT`` of them are dealt.
SALTS = 64
_LAST = (1 << 63) - 1
_SEED = sh.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """The bucket keys of a text's shingle hashes."""
    if not len(h):
        return np.zeros(0, np.int64)
    h = sh.labelled(h)
    best_v, best_i = None, None
    for lo in range(0, len(h), CHUNK):
        v = h[None, lo : lo + CHUNK] * _SEED[:, None]
        v ^= v >> np.uint64(32)
        i = np.argpartition(v, KEEP - 1, axis=1)[:, :KEEP] if v.shape[1] > KEEP else np.broadcast_to(np.arange(v.shape[1]), v.shape)
        v, i = np.take_along_axis(v, i, 1), i + lo
        if best_v is not None:
            v, i = np.concatenate([best_v, v], 1), np.concatenate([best_i, i], 1)
            if v.shape[1] > KEEP:
                at = np.argpartition(v, KEEP - 1, axis=1)[:, :KEEP]
                v, i = np.take_along_axis(v, at, 1), np.take_along_axis(i, at, 1)
        best_v, best_i = v, i
    picked = h[np.sort(best_i, axis=1)]  # in text order
    total = np.arange(len(_SEED), dtype=np.uint64) // np.uint64(ROWS)
    total = sh.mixed(total.reshape(BANDS, ROWS)[:, 0] + np.uint64(7))
    for row in range(ROWS):
        for k in range(picked.shape[1]):
            total = sh.mixed(total * np.uint64(0x9E3779B97F4A7C15) + picked[row::ROWS, k])
    return total.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """M / (n1 + n2 - M) for the M shingles that align within the band that ``similarity`` leaves; 0 if it can't be reached.

    Of sequences that are similar enough at most D = (n1 + n2)(1 - s)/(1 + s)
    shingles are unaligned, so partners are at most D places apart.
    """
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    most = int((n1 + n2) * (1 - similarity) / (1 + similarity) + 1e-9)
    if abs(n1 - n2) > most:
        return 0.0
    m = min(n1, n2)
    same = a[:m] == b[:m]
    head = m if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    same = a[::-1][:m] == b[::-1][:m]
    tail = m if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    fixed = head + tail
    if fixed + (Counter(a) & Counter(b)).total() < (n1 + n2 - most) / 2:
        return 0.0
    got = fixed + (_run(a, b, most) if a and b else 0)
    s = got / (n1 + n2 - got)
    return s if s >= similarity - 1e-12 else 0.0


#: So many pairs of equal shingles a shingle are chained one by one; more, of texts that repeat themselves, a machine's word at a time.
CHAINED = 16


def _run(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence with partners at most ``band`` places apart.

    Pairs of equal shingles within the band are few where a text repeats little:
    then the longest chain of them is found in time in proportion to their
    number (and a logarithm), however long the texts.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if sum(len(places.get(x, ())) for x in a) > CHAINED * (len(a) + len(b)):
        return _packed(a, b, band)
    ends: list[int] = []  # the least last partner of a chain of each length
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            if j < i - band:
                break
            if j <= i + band:
                k = bisect_left(ends, j)
                if k == len(ends):
                    ends.append(j)
                else:
                    ends[k] = j
    return len(ends)


def _packed(a: list[int], b: list[int], band: int) -> int:
    """The same, a bit a shingle."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    wide = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        m = places.get(x)
        if m is None:
            continue
        m &= (wide << (j - band)) if j >= band else (wide >> (band - j))
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


_PIECES = sh.Pieces(sh.word_number)


def _shingled(text: str) -> np.ndarray:
    common.sole(_PIECES)
    return sh.shingles(_PIECES.codes(text))


@functools.lru_cache(8)
def _sequence(text: str) -> np.ndarray:
    return _shingled(text)


# ------------------------------------------------------------------ stages
def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, node: the text's digest, keys, size: its words at most)."""

    def run(batches):
        for part in common.slices(batches):
            texts = part.column(1).to_pylist()
            node = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
            known: dict = {}
            for n, t in zip(node, texts, strict=True):
                if n is not None and n not in known:
                    known[n] = band_keys(_shingled(t))
            none = np.zeros(0, np.int64)
            keys = [known.get(n, none) for n in node]
            size = [0 if t is None else t.count(" ") + t.count("\n") + 1 for t in texts]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = np.concatenate([none, *keys])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(size, pa.int64())], names=["doc_id", "node", "keys", "size"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, node binary, keys array<long>, size long")


def looked_up(rows: DataFrame, on: str, table: DataFrame) -> DataFrame:
    """``rows`` (a written table) left-joined with ``table``, which has a row a key; rows of frequent keys go to many tasks."""
    hot = common.written(rows.groupBy(on).count().where(F.col("count") > SALT).select(on), "hot")
    if hot.isEmpty():
        return rows.join(table, on, "left")
    few = common.marked(table, F.col(on), hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = common.marked(rows, F.col(on), hot).withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    rest = common.marked(rows, F.col(on), hot, other=True).join(table, on, "left")
    return rest.unionByName(some.join(few, [on, "salt"], "left").drop("salt"))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (member, centre, a, b) with both texts; ``pairs`` is a written table. A text that many pairs share goes to many tasks."""
    a = texts.select(F.col("node").alias("member"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("centre"), F.col("text").alias("b"))
    pairs = pairs.select("member", "centre")
    hot = common.written(pairs.groupBy("centre").count().where(F.col("count") > SALT).select("centre"), "hot")
    if hot.isEmpty():
        return pairs.join(a, "member").join(b, "centre").select("member", "centre", "a", "b")
    few = common.marked(b, F.col("centre"), hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = common.marked(pairs, F.col("centre"), hot).withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    rest = common.marked(pairs, F.col("centre"), hot, other=True).join(a, "member").join(b, "centre")
    return rest.select("member", "centre", "a", "b").unionByName(some.join(a, "member").join(few, ["centre", "salt"]).select("member", "centre", "a", "b"))


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs that are links."""

    def run(batches):
        for part in common.slices(batches, mb=8):
            m, c, a, b = (x.to_pylist() for x in part.columns)
            keep = [aligned(_sequence(x), _sequence(y)) > 0 for x, y in zip(a, b, strict=True)]
            yield part.select(["member", "centre"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "member binary, centre binary")


def joined(sequences: list[np.ndarray], own: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the classes ``own`` of a group's texts as far as they can be joined.

    Texts of the largest class ask for nothing: who isn't of it asks for all
    others. Of those, only texts that share enough labelled shingles for the
    similarity are aligned.
    """
    label, links = np.array(own), []
    size = np.array([len(x) for x in sequences])
    if not size.sum():
        return links
    _, term = np.unique(np.concatenate([sh.labelled(x) for x in sequences]), return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(term, kind="stable")
    posting, first = owner[order], np.searchsorted(term[order], np.arange(term.max() + 2))
    begin = np.cumsum(size) - size
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest).tolist():
        mine = term[begin[i] : begin[i] + size[i]]
        lengths = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[at], minlength=len(size))
        total = size + size[i]
        for j in np.flatnonzero((both >= total * similarity / (1 + similarity) - 1e-6) & (label != label[i])).tolist():
            if label[j] != label[i] and aligned(sequences[i], sequences[j], similarity) > 0:
                links.append((i, j))
                label[label == label[i]] = label[j]
    return links


def settled(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join what can be joined in groups; ``lists`` has rows (gid, node, label), a label a class."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes, group = rows["node"].tolist(), {lab: k for k, lab in enumerate(dict.fromkeys(rows["label"]))}
        links = joined([_shingled(t) for t in rows["text"]], [group[lab] for lab in rows["label"]])
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in links], columns=["member", "centre"])

    return lists.join(texts, "node").groupBy("gid").applyInPandas(run, "member binary, centre binary")


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many labelled shingles fall in each slot: a table of bounded size, whatever the number of shingles."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for part in common.slices(batches):
            for t in part.column(0).to_pylist():
                np.add.at(total, (sh.labelled(_shingled(t)) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 10_000):
            piece = at[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a text, in one order for all texts, of which it shares the first it shares with any text it is linked to.

    Linked texts of n1 and n2 shingles share at least (n1 + n2) s / (1 + s), so
    n2 >= s n1, and all but n1 (1 - s) of a text's shingles are shared.
    """
    h = sh.labelled(h)
    order = np.lexsort((h, counts[(h % np.uint64(len(counts))).astype(np.int64)]))
    return h[order[: int(len(h) * (1 - SIMILARITY) + 1e-6) + 1]]


def crossed(big: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join what can be joined in the large buckets ``big`` with rows (key, node).

    Who isn't of its bucket's largest class asks for all texts of such buckets.
    Candidates share a shingle of their prefixes, at places that leave room for
    enough shared shingles; all of them are verified.
    """
    spark = labels.sparkSession
    members = common.written(big.join(labels.select("node", F.col("label.node").alias("own")), "node"), "large")
    most = members.groupBy("key", "own").count().groupBy("key").agg(F.max(F.struct("count", "own")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
    role = looked_up(members, "key", most).where("most IS NOT NULL").groupBy("node", "own").agg(F.max(F.col("own") != F.col("most.own")).alias("asks"))
    role = common.written(role.join(texts, "node"), "asking")
    if role.isEmpty():
        return spark.createDataFrame([], "member binary, centre binary")
    counts = spark.sparkContext.broadcast(_slot_counts(role))

    def run(batches):
        for part in common.slices(batches):
            got = [_shingled(t) for t in part.column(3).to_pylist()]
            size = np.array([len(x) for x in got], np.int64)
            first = [prefix(x, counts.value) for x in got]
            n = np.array([len(x) for x in first], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = np.concatenate(first).view(np.int64)
            whole = pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in range(3)), pa.array(h), pa.array(place), pa.array(np.repeat(size, n))], names=["node", "own", "asks", "h", "place", "size"])
            for lo in range(0, whole.num_rows, 10_000):
                yield whole.slice(lo, 10_000)

    rows = role.select("node", "own", "asks", "text").mapInArrow(run, "node binary, own binary, asks boolean, h long, place long, size long")
    rows = common.written(rows, "prefixes")
    asked = rows.where("asks").select("h")
    rows = common.marked(rows, F.col("h"), asked)
    hot = common.written(rows.groupBy("h").count().where(F.col("count") > SALT).select("h", F.expr(f"count DIV {SALT} + 1").alias("salts")), "hot")
    rows = rows.join(hot, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = rows.where("asks").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("h", "salt", F.col("node").alias("member"), F.col("own").alias("a_own"), (F.col("size") - F.col("place")).alias("a_left"), F.col("size").alias("a_size"))
    b = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).select("h", "salt", F.col("node").alias("centre"), F.col("own").alias("b_own"), (F.col("size") - F.col("place")).alias("b_left"), F.col("size").alias("b_size"))
    room = F.least("a_left", "b_left") >= (F.col("a_size") + F.col("b_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a_own") != F.col("b_own")) & room
    pairs = common.written(a.join(b, same).select("member", "centre").distinct(), "pairs")
    return verified(with_texts(pairs, texts))


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label (rep, node) by connected node, from links and the labels so far.

    Each round every node takes the smallest label among its own, its
    neighbours' and its label's label; tables are written between the rounds,
    and go when the next one is there.
    """
    # what earlier links joined hangs on its label's node, and goes where that goes
    links = links.unionByName(labels.where(F.col("label.node") != F.col("node")).select(F.col("node").alias("member"), F.col("label.node").alias("centre")))
    edges = common.written(links.select(F.col("member").alias("u"), F.col("centre").alias("v")).unionByName(links.select(F.col("centre").alias("u"), F.col("member").alias("v"))).distinct(), "edges")
    now, old = labels, None
    while True:
        near = looked_up(edges, "v", now.select(F.col("node").alias("v"), "label")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node", "left").withColumn("best", F.least("label", F.coalesce("near", "label"))).withColumn("via", F.col("best.node"))
        step = common.written(step.select("node", "label", "best", "via"), "step")
        hop = now.select(F.col("node").alias("via"), F.col("label").alias("far")).where(F.col("far.node") != F.col("via"))
        after = common.written(looked_up(step, "via", hop).select("node", F.least("best", F.coalesce("far", "best")).alias("next"), "label"), "labels")
        changed = not after.where(F.col("next") != F.col("label")).isEmpty()
        common.dropped(step, old)
        old, now = after, after.select("node", F.col("next").alias("label"))
        if not changed:
            common.dropped(edges)
            return now


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, node, class_id, class_node) of every document; ``node`` is null for null texts."""
    rows = common.written(sketches(docs, id_col, text_col), "sketches")
    order = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    nodes = common.written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(order).alias("rep"), F.max("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.where(F.size("keys") > 0).select("node", "size", F.explode("keys").alias("key"))
    # keys of a single text go, by counts of short numbers, before texts' digests are dealt by key
    lone = nodes.where(F.size("keys") > 0).select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key")
    several = common.written(lone, "keys")
    maybe = common.marked(keyed, F.col("key"), several.select(F.col("key")))
    maybe = common.written(maybe, "maybe")
    groups = common.written(looked_up(maybe, "key", several.withColumn("several", F.lit(True))).where("several").select("node", "size", "key").distinct(), "groups")
    common.dropped(maybe, several)
    in_groups = common.written(groups.select("node").distinct().join(nodes, "node").select("node", "rep", "keys"), "in-groups")
    labels = common.written(in_groups.select("node", F.struct("rep", "node").alias("label")), "labels")
    keys = in_groups.select("node", F.explode("keys").alias("own"))
    texts = big = None
    while not groups.isEmpty():
        # the most popular member of each group is its centre
        sizes = groups.groupBy("key").agg(F.count("*").alias("n"))
        popular = looked_up(groups, "key", sizes).groupBy("node").agg(F.sum("n").alias("popularity"))
        members = common.written(groups.join(popular, "node").join(labels, "node"), "members")
        centres = members.groupBy("key").agg(F.max(F.struct("popularity", "node", "label")).alias("c"), F.count("*").alias("n"), F.sum("size").alias("words"))
        dealt = common.written(looked_up(members, "key", centres).select("key", F.col("node").alias("member"), F.col("c.node").alias("centre"), "n", "words", "size", (F.col("label") != F.col("c.label")).alias("apart")), "dealt")
        if texts is None:
            wanted = labels.select("node", F.col("label.rep").alias("rep"))
            own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("rep"), F.unhex(F.md5(text_col)).alias("node"), F.col(text_col).alias("text"))
            own = common.marked(own, F.col("node"), wanted.select("node"))
            texts = common.written(own.join(wanted, ["rep", "node"]).dropDuplicates(["node"]).select("node", "text"), "texts")
        pairs = common.written(dealt.where("apart").select("member", "centre").distinct(), "pairs")
        links = common.written(verified(with_texts(pairs, texts)), "links")
        common.dropped(members, pairs)
        if not links.isEmpty():
            labels = components(links, labels)
        mine = labels.select(F.col("node").alias("member"), "label")
        theirs = labels.select(F.col("node").alias("centre"), F.col("label").alias("c_label"))
        known = common.written(dealt.where("n > 2").drop("apart").join(mine, "member"), "known")
        still = common.written(looked_up(known, "centre", theirs).withColumn("apart", F.col("label") != F.col("c_label")), "still")
        common.dropped(links, dealt, known)
        open_ = still.groupBy("key").agg(F.max("apart").alias("open")).where("open").select("key", "open")
        whole, still = still, common.written(looked_up(still, "key", open_).where("open").drop("open"), "still")
        common.dropped(whole)
        # small groups are settled, once where bands have the same group
        one_task = (F.col("n") <= SMALL) & (F.col("words") <= SMALL_SHINGLES)
        small = still.where(one_task).groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.col("member").alias("node"), F.col("label.node").alias("label")))).alias("m"))
        lists = small.select(F.col("m").alias("gid_m")).distinct().select(F.xxhash64("gid_m").alias("gid"), F.explode("gid_m").alias("m")).select("gid", "m.node", "m.label")
        links = common.written(settled(lists, texts), "links")
        if not links.isEmpty():
            labels = components(links, labels)
        # large groups: what is apart from the centre is dealt again, by two keys in common; later groups are parts of the first ones
        if big is None:
            big = common.written(still.where(~one_task).select("key", F.col("member").alias("node")), "big")
        common.dropped(links, groups)
        rest = still.where(~one_task & F.col("apart")).select("key", F.col("member").alias("node"), "size")
        finer = rest.join(keys, "node").select(F.xxhash64("key", "own").alias("key"), "node", "size").distinct().join(labels, "node")
        several = finer.groupBy("key").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("key")
        groups = common.written(finer.join(several, "key", "left_semi").select("key", "node", "size"), "groups")
        common.dropped(still)
    if big is not None and not big.isEmpty():
        links = common.written(crossed(big, labels, texts), "links")
        if not links.isEmpty():
            labels = components(links, labels)
    linked = labels.where(F.col("label.node") != F.col("node")).select("node", F.col("label.rep").alias("l_rep"), F.col("label.node").alias("l_node"))
    own = nodes.join(linked, "node", "left").select("node", F.coalesce("l_rep", "rep").alias("class_id"), F.coalesce("l_node", "node").alias("class_node"))
    back = lambda c: F.when(F.col(c) != F.lit(_LAST), F.col(c))
    common.dropped(groups, texts, big)
    out = looked_up(rows.select("doc_id", "node"), "node", own)
    return out.select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(back("class_id")).alias("class_id"), "class_node")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id, with all its columns; null texts all stay.

    Of rows of one id and text the first by all columns in turn stays, nulls first.
    """
    found = classes(docs, id_col=id_col, text_col=text_col)
    found = common.written(found.where(F.col("node").isNotNull()), "classes")
    same_text = F.col("class_node") == F.col("node")
    rows = found.groupBy("doc_id", "node").agg(F.first(same_text & F.col("class_id").eqNullSafe(F.col("doc_id"))).alias("chosen"), F.count("*").alias("n"))
    touched = common.written(rows.where(~F.col("chosen") | (F.col("n") > 1)), "touched")
    # rows whose digest no dropped or repeated row has stay as they are; the few others are looked up
    node = F.unhex(F.md5(text_col))
    name = "_node"
    while name in docs.columns:
        name = "_" + name
    some = docs.where(F.col(text_col).isNotNull()).withColumn(name, node)
    keep = docs.where(F.col(text_col).isNull()).unionByName(common.marked(some, F.col(name), touched.select("node"), other=True).select(*docs.columns))
    asked = common.marked(some, F.col(name), touched.select("node"))
    t_id, t_node, chosen = common.fresh(some, "t_id", "t_node", "chosen")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(t_id)) & (F.col(name) == F.col(t_node))
    known = touched.select(F.col("doc_id").alias(t_id), F.col("node").alias(t_node), F.col("chosen").alias(chosen))
    free = asked.join(known, same, "left_anti").select(*docs.columns)
    once = asked.join(known.where(chosen), same, "left_semi")
    ordered = [F.to_json(F.struct(f"`{f.name}`")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema]
    row, = common.fresh(once, "row")
    once = once.groupBy(id_col, name).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*ordered)).alias(row)).select(f"{row}.*")
    return keep.unionByName(free).unionByName(once)


# ------------------------------------------------------------------- query
def op4_order_minhash(spark, sf_dir: str) -> DataFrame:
    """One row a document: its id and its class's id."""
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
