from __future__ import annotations

import hashlib

import plain
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import common, decontamination, near_dedup, quality, secrets


def plain_run(spark, folder):
    """The pipeline's rows (id, tokens, hashes), by loops over all documents; what isn't in ``plain`` is the model, the secrets' forest and the tokenizers library."""
    table = {t: common.table(spark, folder, t) for t in ("documents", "labels", "benchmark")}
    model = quality.train(table["documents"], table["labels"])
    docs = [r for r in table["documents"].collect() if plain.quality(model, r.text) >= quality.THRESHOLD]
    # of a class the smallest id stays, nulls last, and of equal texts and ids the first by all columns; null texts all stay
    order = lambda r: (r.doc_id is None, r.doc_id or 0, [(x is not None, x) for x in r])
    empty, docs = [r for r in docs if r.text is None], sorted((r for r in docs if r.text is not None), key=order)
    own = plain.classes([r.text for r in docs])
    docs = empty + [d for k, d in enumerate(docs) if own[k] == k]
    leaked = {d for d, _ in plain.leaks([(k, d.text) for k, d in enumerate(docs)], [(r.item_id, r.text) for r in table["benchmark"].collect()])}
    lib, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for k, d in enumerate(docs):
        if k in leaked:
            continue
        text, end, parts = d.text or "", 0, []
        for c, _ in secrets.secrets(text, d.source, secrets.forest()):
            parts += [text[end : c.start], "[SECRET]"]
            end = c.end
        ids = lib.encode("".join([*parts, text[end:]]), add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        out.append((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def piped(spark, folder):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()), key=repr)


def test_run_as_plain_loops(spark, sf_dir):
    want = plain_run(spark, sf_dir)
    assert piped(spark, sf_dir) == want and len(want) > 50


def test_every_stage_takes_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    classes = near_dedup.classes(docs).select("class_id").distinct().count()
    assert classes == counts[4]
    assert decontamination.leaks(docs, common.table(spark, sf_dir, "benchmark")).count() == 0
    assert secrets.scan(docs).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_run_on_nulls_repeats_and_no_rows(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    some = docs.where("doc_id < 40")
    odd = spark.createDataFrame([(None, None, None, None, None), (901, None, "en", "s", 0), (901, None, "en", "s", 0), (900, "", "en", "s", 0), (None, some.first().text + " and more", "en", None, 1)], docs.schema)
    long = some.limit(1).selectExpr("5000L AS doc_id", "repeat(concat(text, ' '), 400) AS text", "lang", "source", "n_chars")
    rows = some.unionByName(odd).unionByName(some.where("doc_id < 5")).unionByName(some.where("doc_id = 6").withColumn("source", F.lit("another"))).unionByName(long)
    for k, frame in enumerate((rows, docs.limit(0))):
        root = str(tmp_path / str(k))
        frame.repartition(3).write.parquet(f"{root}/documents.parquet")
        for t in ("labels", "benchmark"):
            common.table(spark, sf_dir, t).write.parquet(f"{root}/{t}.parquet")
        want = plain_run(spark, root)
        assert piped(spark, root) == want
        assert not k or want == []
