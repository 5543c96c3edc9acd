from __future__ import annotations

import random
import time
from collections import Counter

import plain

from tidewell.llm import decontamination as dc


def index(items):
    df = Counter(w for _, t in items for w in set(dc.words(t)))
    return dc.Index(items, len(items), df, sum(len(dc.words(t)) for _, t in items) / len(items))


def brute(ix, text, theta, overlap):
    out, w = {}, dc.words(text)
    for tier in ix.tiers:
        segments = -(-len(w) // tier.stride)
        for k in range(max(segments - 1, 1 if segments else 0)):
            passage = w[k * tier.stride : (k + 2) * tier.stride]
            for place, item in enumerate(tier.items):
                score = 0.0
                for t in set(passage):
                    if t in ix.term:
                        p, v = tier.postings[ix.term[t]]
                        score += float(v[list(p).index(place)]) if place in p else 0.0
                if score >= theta - 1e-9:
                    q, a = dc.Scanner(ix, theta, overlap)._verify(item, passage)
                    if min(q, a) >= overlap:
                        out[item] = max(out.get(item, 0.0), score)
    return out


def test_wand_is_exhaustive():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([9, 20, 50, 90])))) for k in range(40)]
    ix = index(items)
    texts = [" ".join(r.choices(vocabulary, k=r.choice([3, 80, 300]))) + " " + r.choice(items)[1] * r.randint(0, 1) for _ in range(30)]
    for theta in (0.4, 0.7):
        for text, found in zip(texts, dc.Scanner(ix, theta, 0.5).scan(texts), strict=True):
            want = brute(ix, text, theta, 0.5)
            assert set(found) == set(want) and all(abs(found[k][0] - want[k]) < 1e-9 for k in want)


def test_leaks_and_edges(spark):
    item = "What is the capital of that old country by the sea? The capital is surely Quorvale"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "Yes indeed"), (4, item)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(500))
    edited = item.replace("old", "ancient")
    docs = spark.createDataFrame(
        [(1, f"{filler} {item.upper()} {filler}", "a"), (2, f"{filler} {edited}", "b"), (3, filler, "c"), (4, None, "d"), (5, "", "e"), (6, "it is yes indeed", "f"), (7, item.replace(" ", " | "), "g"), (8, item.split("?")[0] + "?", "h"), (1, filler, "i")],
        "doc_id long, text string, item_id string",
    )
    got = sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect())
    assert got == [(1, 1), (1, 4), (2, 1), (2, 4), (6, 3), (7, 1), (7, 4)]
    assert sorted(r.item_id for r in dc.clean(docs, bench).collect()) == ["c", "d", "e", "h", "i"]
    assert dc.leaks(docs.limit(0), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0


def test_blocks_of_the_index_give_the_same(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in df.collect())
    whole = key(dc.leaks(docs, bench))
    monkeypatch.setattr(dc, "INDEX_BYTES", 3000)
    assert key(dc.leaks(docs, bench)) == whole
    assert dc.clean(docs, bench).count() == docs.count() - len({d for d, *_ in whole})


def test_query_against_loops(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in dc.op2_decontamination(spark, sf_dir).collect()}
    assert found == plain.leaks(docs, items) and found


def test_words_of_all_scripts_count_alike_in_all_blocks(spark, monkeypatch):
    r = random.Random(2)
    words = ["नमस्ते", "दुनिया", "क्षत्रिय", "हिन्दी", "भाषा", "ज्ञान", "पुस्तक", "विद्या", "café", "naïve", "İstanbul", "e\u0301te", "x_y", "don't"]
    items = [(k, " ".join(r.choice(words) + r.choice(["", "ा", "1"]) for _ in range(24)) + "? " + " ".join(r.choices(words, k=6))) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{' '.join(r.choices(words, k=300))} {items[k * 4][1]} {' '.join(r.choices(words, k=9))}") for k in range(5)], "doc_id long, text string")
    key = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in dc.leaks(docs, bench).collect())
    whole = key()
    assert {(k, k * 4) for k in range(5)} <= {x[:2] for x in whole}
    monkeypatch.setattr(dc, "INDEX_BYTES", 700)
    assert key() == whole


def test_an_index_is_small_and_bounds_pay_for_few_blocks():
    import pickle

    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30_000)]
    items = [(k, " ".join(r.choices(vocabulary, k=120))) for k in range(2400)]
    start = time.process_time()
    ix = index(items)
    assert time.process_time() - start < 5
    assert len(pickle.dumps(ix)) < 12 * sum(len(t) for _, t in items)
    texts = [" ".join(r.choices(vocabulary, k=3000)) for _ in range(20)] + [items[5][1]]
    found = dc.Scanner(ix, 0.6, 0.8).scan(texts)
    assert [sorted(f) for f in found] == [[]] * 20 + [[5]]


def test_a_very_long_text_in_linear_time():
    items = [(k, " ".join(f"w{k * 30 + j}" for j in range(60))) for k in range(50)]
    filler = " ".join(f"v{k % 5000} w{k % 1500}" for k in range(200_000))
    start = time.process_time()
    assert dc.Scanner(index(items), 0.6, 0.8).scan([f"{filler} {items[3][1]} {filler}"])[0].keys() >= {3}
    assert time.process_time() - start < 20
