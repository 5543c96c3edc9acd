"""Target-distribution importance resampling by a position table of n-grams.

Words are exploded with their positions; for each order, windows over a
document's positions put the following words behind each. Runs of words are
hashed into buckets and counted, in the corpus and in a target text. A bucket's
gain is the floored 1000-fold log ratio of its two smoothed shares, a document's
weight the floored mean of its runs' gains. Gumbel noise from a hash of the id
makes the highest scores a sample without replacement, in proportion to
exp(weight / 1000).

Bucket counts and gains have at most ``buckets`` rows, whatever the corpus, and
are broadcast. Ranks come from ``ordered.running`` over ranges of scores, so no
task ranks all documents.

Defined results: a null text has no words; a null id counts as the text "" in
the hash and is the smallest in ties; repeated rows are ranked one after the
other; an empty table gives no rows, an empty target only lowers all gains
alike; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.ordered import running
from tidewell.llm.prefix_trie import CRC_OF, CRC_SQL

#: Capitals that are made small, and what words are.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024


def words(text: Column) -> Column:
    """The words of a whole text in order, small letters for A-Z."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def features(df: DataFrame, keys: list[str], words_col: str, orders: range, buckets: int) -> DataFrame:
    """A row for each run of words: the document's ``keys`` and the run's ``bucket``, null once for a document without words.

    ``keys`` must tell rows apart where an order is above 1, as following words
    come from windows over one row's positions.
    """
    place = df.select(*keys, F.posexplode_outer(words_col).alias("_at", "_word"))
    if orders.stop <= 2:
        run = F.col("_word")
    else:
        ahead = W.partitionBy(*keys).orderBy("_at")
        place = place.withColumns({f"_next{k}": F.lead("_word", k).over(ahead) for k in range(1, orders.stop - 1)})
        behind = [F.col(f"_next{k}") for k in range(1, orders.stop - 1)]
        whole = [F.when(behind[n - 2].isNotNull(), F.concat_ws(" ", "_word", *behind[: n - 1])) if n > 1 else F.col("_word") for n in orders]
        run = F.explode_outer(F.array_compact(F.array(*whole)))
    return place.select(*keys, run.alias("_run")).select(*keys, (F.crc32(F.col("_run")) % buckets).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, orders: range, buckets: int) -> DataFrame:
    """bucket and gain, for buckets that documents have; both frames have a key ``_row`` and ``_words``."""
    counted = lambda df, n: features(df, ["_row"], "_words", orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(n))
    both = counted(docs, "s").join(counted(target, "t"), "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    all_ = W.partitionBy(F.lit(0))  # at most ``buckets`` rows
    both = both.withColumns({"all_s": F.sum("s").over(all_), "all_t": F.sum("t").over(all_)})
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, 1000-fold and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """Every document's features, weight, score, and rank in the sample (null: not drawn).

    Drawn are the ``percent`` of the documents of at least ``least_words`` words
    whose scores are highest, ties to the smaller id. Features are runs of 1 to
    ``longest`` words.
    """
    orders = range(1, longest + 1)
    # a row's number and id go with its words, so that it needs to be unique only
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("_words")).withColumns({"_row": F.monotonically_increasing_id(), "_in": F.size("_words") >= least_words})
    aims = target.select(words(F.col(target_col)).alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    gain = common.written(gains(texts, aims, orders, buckets), "resampling-gains")
    keys = ["_row", "doc_id", "_in"]
    own = features(texts, keys, "_words", orders, buckets).join(F.broadcast(gain), "bucket", "left")
    total = own.groupBy(*keys).agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    n = F.greatest("n_features", F.lit(1))
    mean = ((F.col("gain") - F.pmod("gain", n)) / n).cast("long")  # whole by then
    scored = total.withColumn("weight", mean).select("doc_id", "_row", "_in", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    scored = common.written(scored, "resampling-scores")
    drawn = scored.where("_in").count() * percent // 100
    ranked = running(scored.where("_in"), [], [F.desc("score"), F.col("doc_id").asc_nulls_first(), "_row"], nth="rank", label="resampling-ranks")
    out = ["doc_id", "n_features", "weight", "score"]
    inside = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return inside.unionByName(scored.where("NOT _in").select(*out, F.lit(None).cast("long").alias("rank")))


# ------------------------------------------------------------------- query
def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce({{0}}, ''), '{CAPITALS}', '{SMALL}'), '{WORD}')"
ORACLE_SQL = f"""
WITH {CRC_SQL},
docs AS (SELECT row_number() OVER () k, doc_id, {_WORDS.format("text")} w FROM documents),
runs AS (SELECT k, unnest(w) f FROM docs),
aims AS (SELECT unnest({_WORDS.format("text")}) f FROM benchmark),
known AS (SELECT f, {CRC_OF.format("f")} % {BUCKETS} bucket FROM (SELECT f FROM runs UNION SELECT f FROM aims), crc_table),
s AS (SELECT bucket, count(*) s FROM runs JOIN known USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) t FROM aims JOIN known USING (f) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM runs) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aims) + {BUCKETS})::DOUBLE))) AS BIGINT) gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT k, count(*) n, CAST(floor(sum(gain) / count(*)) AS BIGINT) weight FROM runs JOIN known USING (f) JOIN gains USING (bucket) GROUP BY k),
scored AS (
  SELECT k, doc_id, CAST(coalesce(n, 0) AS BIGINT) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))) AS BIGINT) score
  FROM docs LEFT JOIN sums USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank
FROM scored LEFT JOIN ranked USING (k)
"""
