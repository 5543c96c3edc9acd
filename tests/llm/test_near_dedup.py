from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import plain as loops

from tidewell.llm import near_dedup as nd
from tidewell.llm import shingles as sh


def sequence(text):
    return sh.shingles(sh.Pieces(sh.word_number).codes(text))


def plain(a, b):
    """Similarity by a full table, without a band."""
    a, b = a.tolist(), b.tolist()
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def variants(r, n=60):
    out = []
    for _ in range(n // 10):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(4, 150))]
        for _ in range(10):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, f"x{r.randrange(9999)}"), lambda: w.insert(k, "ins"), lambda: w.__delitem__(k) if len(w) > 1 else None])()
            out.append(" ".join(w))
    return out


def test_banded_alignment_is_exact():
    r = random.Random(2)
    seqs = [sequence(t) for t in variants(r, 40)]
    for i in range(len(seqs)):
        for j in range(i):
            s = plain(seqs[i], seqs[j])
            assert abs(nd.aligned(seqs[i], seqs[j]) - (s if s >= 0.8 - 1e-12 else 0.0)) < 1e-9


def components(texts):
    own = {}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [None if t is None else sequence(t) for t in texts]
    for i, t in enumerate(texts):
        for j in range(i):
            if t is not None and texts[j] is not None and (t == texts[j] or len(seqs[i]) and len(seqs[j]) and plain(seqs[i], seqs[j]) >= 0.8 - 1e-12):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(texts)):
        own[i] = find(i)
    return own


def test_classes_as_by_brute_force(spark):
    texts = [*variants(random.Random(5), 60), None, None, "", "", "!!", "!!", "one two", "one two", "One  two"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert got == components(texts)
    kept = sorted(r.doc_id for r in nd.survivors(docs).collect())
    assert kept == sorted(set(got.values()))


def test_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (None, None), (8, "other")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.classes(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (8, 8)], key=str)
    assert sorted((str(r.doc_id), r.text is None) for r in nd.survivors(docs).collect()) == [("5", False), ("8", False), ("None", True)]
    assert nd.classes(docs.limit(0)).count() == 0


def test_large_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(30):
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(120)] = f"x{r.randrange(9999)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == components(texts)


def test_large_groups_find_links_to_texts_that_are_linked_already(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "SALT", 5)
    base = [f"w{k}" for k in range(204)]
    texts = [" ".join(base)]
    for k in range(24):
        b = list(base)
        b[7 * k + 10] = f"b{k}"
        c = list(b)
        for j in range(4):  # 0.82 similar to b, 0.78 to the base
            c[(7 * k + 40 + 35 * j) % 195 + 4] = f"c{k}x{j}"
        texts += [" ".join(b), " ".join(c)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == want


def test_frequent_keys_are_dealt_over_many_tasks(spark, monkeypatch):
    for name, value in (("SALT", 2), ("SALTS", 5), ("SMALL", 4)):
        monkeypatch.setattr(nd, name, value)
    texts = [*variants(random.Random(15), 50), *["one text " * 9] * 12, None]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, _t_id string, chosen string")
    want = components(texts)
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == want
    kept = nd.survivors(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_labelled_shingles_are_distinct():
    h = sequence("a b c d e " * 40)
    assert len(np.unique(sh.labelled(h))) == len(h) > len(np.unique(h))


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in nd.op4_order_minhash(spark, sf_dir).collect()}
    first, groups = {}, defaultdict(set)
    for d in rows:
        assert got[d.doc_id] == got[first.setdefault(d.text, d.doc_id)]
        groups[got[d.doc_id]].add(d.text)
    for g in groups.values():
        if len(g) == 2:
            a, b = (sequence(t) for t in g)
            assert nd.aligned(a, b) >= 0.8


def test_query_as_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    seqs, own = [sequence(r.text) for r in rows], [r.doc_id for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if own[i] != own[j] and (rows[i].text == rows[j].text or nd.aligned(seqs[i], seqs[j]) > 0):
                low, high = sorted((own[i], own[j]))
                own = [low if x == high else x for x in own]
    assert {r.doc_id: r.class_id for r in nd.op4_order_minhash(spark, sf_dir).collect()} == dict(zip([r.doc_id for r in rows], own, strict=True))


def test_the_first_of_equal_rows_stays_whatever_the_partitions(spark):
    rows = [(7, "one text that is the same in all rows", 39 - k, {"k": k}) for k in range(40)] + [(8, "one text that is the same in all rows", 5, None), (9, None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int, tags map<string,int>")
    for parts in (1, 3, 7, 13):
        got = sorted((r.doc_id, r.other, r.tags) for r in nd.survivors(df.repartition(parts)).collect())
        assert got == [(7, 0, {"k": 39}), (9, 1, None)], parts


def test_alignments_of_all_kinds_agree():
    r = random.Random(12)
    for k in range(300):
        letters = r.choice([2, 5, 1000])
        a = [r.randrange(letters) for _ in range(r.randrange(1, 60))]
        b = [x for x in a if r.random() > 0.2] + [r.randrange(letters) for _ in range(r.randrange(1, 9))]
        assert nd._run(a, b, 1000) == nd._packed(a, b, 1000) == loops.longest_common(a, b), k
        for band in (0, 3, 20):
            assert nd._run(a, b, band) == nd._packed(a, b, band)


def test_long_near_copies_take_little_time():
    r = random.Random(13)
    words = [f"w{r.randrange(30_000)}" for _ in range(500_000)]
    other = [f"v{k}" if r.random() < 0.01 else w for k, w in enumerate(words)]
    a, b = nd._sequence(" ".join(words)), nd._sequence(" ".join(other))
    start = time.process_time()
    assert 0.9 < nd.aligned(a, b) < 0.95
    assert time.process_time() - start < 20
    assert nd.aligned(a, nd._sequence(" ".join(other[250_000:] + words[:250_000]))) == 0.0
