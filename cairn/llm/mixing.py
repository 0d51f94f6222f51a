"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

The mix is a row of slots, one block of tokens each. Slots are van der Corput points: point j of N has the place bitreverse(j).
Points are dealt to the sources in runs, as the cumulative slot counts say, so every stretch of the schedule holds each
source in its share. A source's slots, ranked by place, take its blocks in turn, again from the first when all are used; the
blocks cut the source's documents, laid end to end in a hashed order, at every block_tokens words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import stage, word_count

WEIGHTS, MAX_REPEAT, BLOCK_TOKENS, SEED = (5, 2, 1), 3, 1024, 42
#: Running sums are made in so many shards a source, then over the shards' sums: no task holds a whole source.
SHARDS = 4096
#: A table of sources is broadcast up to so many rows (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
_POINTS = 8192


def source_plan(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per source of sizes (source, size): its size, weight, target, quota in words, blocks and slots.

    Sources by code point, null last, weigh as the weights repeat. A target is the weight's share of all words, but at most
    max_repeat times the source's size: with sources by the level at which they fill up, the common level is the largest of
    (words - filled before) / (weights from here on). The windows hold a row per source, not per document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy("fill", "sid")
    before, after = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(0, W.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("fill", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("target", F.least("cap", F.max("level").over(W.partitionBy()) * F.col("weight")))
    s = s.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_repeat))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block_tokens - 1}) div {block_tokens}"))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
    s = s.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block_tokens - 1}) div {block_tokens}"))
    s = s.withColumn("first_point", F.coalesce(F.sum("slots").over(by_name.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return s.select("sid", "source", "weight", "source_size", "target", "quota", "blocks", "passes", "rest", "slots", "first_point")


def _running(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same sid that come earlier by shard, then by order."""
    own = W.partitionBy("sid", "shard").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = df.groupBy("sid", "shard").agg(F.sum(value).alias("n"))
    sums = sums.withColumn("earlier", F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")).drop("n")
    return df.withColumn("own", F.sum(value).over(own)).join(sums.hint("merge"), ["sid", "shard"]).withColumn("before", F.col("earlier") + F.col("own") - F.col(value)).drop("own", "earlier", "shard")


def schedule(plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per slot: place in the schedule, sid, rank among the source's slots, pass, block and words taken of it.

    plan: a staged source_plan. The points of a source are a run of integers, made in two steps so that no task makes them all.
    """
    points = plan.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, int(points - 1).bit_length())
    runs = plan.where("slots > 0").select("sid", "source_size", "blocks", "passes", "rest", "slots", "first_point", F.explode(F.expr(f"sequence(0L, slots - 1, {_POINTS}L)")).alias("run"))
    point = runs.repartition("sid", "run").select("*", F.explode(F.expr(f"sequence(run, least(run + {_POINTS - 1}L, slots - 1))")).alias("i"))
    point = point.withColumn("place", F.conv(F.reverse(F.lpad(F.bin(F.col("first_point") + F.col("i")), bits, "0")), 2, 10).cast("long"))
    point = point.withColumn("shard", F.shiftright("place", max(0, bits - SHARDS.bit_length() + 1))).withColumn("one", F.lit(1).cast("long"))
    ranked = _running(point.drop("run", "i"), "one", ["place"]).withColumnRenamed("before", "rank")
    ranked = ranked.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    length = F.least(F.lit(block_tokens), F.col("source_size") - F.col("block") * block_tokens)
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("block") * block_tokens))
    return ranked.select("place", "sid", "rank", "pass", "block", words.alias("words"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_repeat=MAX_REPEAT, block_tokens=BLOCK_TOKENS, seed=SEED) -> DataFrame:
    """One row per row of docs: uid, doc_id, size, source_size, target, taken.

    size counts words (null: 0); taken is how many words the mix takes of the document, repeats counted, at most max_repeat times
    its size. Each source's taken words are its target, rounded. A null source is a source, the last. Rows that repeat an
    id, or have none, are documents of their own, told by their texts. A text without words has taken 0, and so has all in a table without words. The same table gives the same mix.
    """
    base = stage(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("th")))
    plan = stage(source_plan(base, weights, max_repeat, block_tokens).coalesce(1))
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda x: x
    own = base.join(small(plan.select("sid", F.col("source").alias("name"))), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    own = own.withColumn("mixed", F.xxhash64(F.lit(seed), "doc_id", "th")).withColumn("shard", F.pmod("mixed", F.lit(SHARDS)))
    laid = _running(own, "size", ["mixed", "doc_id", "uid"]).withColumn("end", F.col("before") + F.col("size")).drop("mixed", "th")
    b = block_tokens
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(before div {b}, (end - 1) div {b})"))
    pieces = laid.select("*", F.explode_outer(spans).alias("block"))
    slots = schedule(plan, b).select("sid", "block", "words")
    start = F.col("block") * b
    overlap = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least("end", start + F.col("words")) - F.greatest("before", start)))
    taken = pieces.join(slots.hint("merge"), ["sid", "block"], "left").groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("sid").alias("sid"), F.first("size").alias("size"), F.sum(F.coalesce(overlap, F.lit(0))).cast("long").alias("taken"))
    return taken.join(small(plan.select("sid", "source_size", "target")), "sid").select("uid", "doc_id", "size", "source_size", "target", "taken")


#: The targets by filling sources in the order in which they fill up, a step each: as many steps as there are sources.
TARGETS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM d GROUP BY source),
step(k, level) AS (
  SELECT 0, (SELECT sum(n) / sum(weight) FROM s)
  UNION ALL
  SELECT k + 1, (SELECT (sum(n) - sum(CASE WHEN weight * level >= 3 * n THEN 3 * n ELSE 0 END)) / nullif(sum(CASE WHEN weight * level >= 3 * n THEN 0 ELSE weight END), 0) FROM s) FROM step WHERE k < (SELECT count(*) FROM s)
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(3 * n, weight * (SELECT max(level) FROM step)), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""
