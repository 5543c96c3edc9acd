from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import language_id as li


def plain_grams(text):
    """n-grams of marked words, one at a time, by the module's own hash of one word."""
    out = []
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        marked = f"\n{w}\n"
        out += [w[k] for k in range(len(w))] + [marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1)]
    return out


def number(gram):
    """The bucket of one n-gram, from the sets of a word's grams."""
    return _BUCKET[gram]


_BUCKET: dict[str, int] = {}


def learn(texts):
    """Buckets of all grams of the texts' words, each from a text of its own."""
    for w in {w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower())}:
        found, _ = li.grams([w])
        marked = f"\n{w}\n"
        names = [*w, *(marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1))]
        assert len(found) == len(names)
        for g, b in zip(names, found.tolist(), strict=True):
            assert _BUCKET.setdefault(g, b) == b  # the same gram, the same bucket, wherever it is


def plain_bayes(train, texts):
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in train:
        counts[lang].update(map(number, plain_grams(text)))
        docs[lang] += 1
    out = []
    for text in texts:
        grams = plain_grams(text)
        if not grams:
            out.append(("und", 0.0))
            continue
        s = {}
        for lang in sorted(docs):
            n = sum(counts[lang].values()) + li.SMOOTHING * li.BUCKETS
            s[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][number(g)] + li.SMOOTHING) / n) for g in grams)
        best = max(s, key=lambda x: (s[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


TEXTS = ["The cat, the hat 42!", "le chat et la souris", "der Hund und die Katze", "", None, "1234 --- 5", "Ünï çödé", "日本語", "a", "x\x00y the"]


def test_against_a_plain_classifier(spark):
    rows = [(k, TEXTS[k % 10], ["en", "fr", "de", None][k % 4 if k % 10 < 3 else (k * 7) % 4], "s") for k in range(200)] + [(None, "the the", "en", "s")]
    learn(TEXTS + ["the the"])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x")).withColumn("n", F.lit(3))
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    want = plain_bayes([(t, x) for i, t, x, _ in rows if x is not None and not out(i)], [t for _, t, _, _ in rows])
    for parts in (1, 6):
        d = df.repartition(parts)
        got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in li.predictions(d, li.train(d)).collect()), key=repr)
        expected = sorted(((i, out(i), x, s) for (i, *_), (x, s) in zip(rows, want, strict=True)), key=repr)
        assert [g[:3] for g in got] == [e[:3] for e in expected]
        assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=1e-9)


def test_nothing_learnt_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    model = li.train(df)
    assert [(r.lang_pred, r.score) for r in li.predictions(df, model).collect()] == [("und", 0.0)] * 2
    assert li.predictions(df.limit(0), li.train(df.limit(0))).collect() == []


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    text = " ".join(f"wört{'x' * (k % 9)}" for k in range(3000)) + "9" * 50
    whole = Counter(li.grams([text])[0].tolist())
    monkeypatch.setattr(li, "PIECE", 700)
    parts = Counter()
    for _, pieces in li._groups([text, "", text[:10]]):
        parts.update(li.grams(pieces)[0].tolist())
    assert parts == whole + Counter(li.grams([text[:10]])[0].tolist())
    assert "".join(li._cut("y" * 5000, 700)) == "y" * 5000


def test_languages_beyond_the_held_ones_and_beyond_the_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, "abc " * (k % 5), f"l{k % 50:02d}") for k in range(400)], "doc_id long, text string, lang string")
    many = li.train(df)
    monkeypatch.setattr(li, "HELD", 1 << 20)
    one = li.train(df.repartition(2))
    assert many.languages == one.languages and np.allclose(many.matrix, one.matrix) and len(many.languages) == 50
    monkeypatch.setattr(li, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError):
        li.train(df)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = li.op13_language_bayes(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99 and all(0 <= r.score <= 1 for r in rows)
