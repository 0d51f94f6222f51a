"""Exact duplicates by content-defined chunk recipes, in DataFrame operations alone.

A text is cut where its own content says so: after the first line or sentence end beyond MIN_CHUNK code points, or at
MAX_CHUNK. That is no rolling hash, but as one does it finds its cuts again after an insertion, at the next end that both texts share. Each distinct chunk gets one identifier, its first occurrence, and a text becomes its recipe, the ordered
list of identifiers. Texts are equal when their recipes are, and nothing else decides; what moves between machines are digests of chunks and
short lists, never the texts. A chunk's identifier is verified by length, a 64-bit hash and a SHA-256. The SHA-256 of the whole
text is carried for the result, and a group whose texts differ in it would end the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lower_ascii, stage

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text, and an empty text has none."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:[\n.!?]|\z)|.{{{MAX_CHUNK}}}|.+"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per chunk (uid, id, sha, pos, hash, proof, length); an empty text has one row without a chunk.

    uid tells rows apart that repeat an id. Narrow: nothing is shuffled.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select("uid", "id", F.unhex(F.sha2("t", 256)).alias("sha"), F.posexplode_outer(chunks(F.col("t"))).alias("pos", "c"))
    return rows.select("uid", "id", "sha", "pos", F.xxhash64("c").alias("hash"), F.unhex(F.sha2("c", 256)).alias("proof"), F.octet_length("c").alias("length"))


def chunk_dictionary(rows: DataFrame) -> DataFrame:
    """A row per distinct chunk: its digests, its identifier (first_id, first_pos) and how often it occurs."""
    distinct = rows.where("hash IS NOT NULL").groupBy("hash", "proof", "length")
    return distinct.agg(F.min(F.struct("id", "uid", "pos")).alias("first"), F.count("*").alias("uses")).select("hash", "proof", "length", F.col("first.uid").alias("first_uid"), F.col("first.pos").alias("first_pos"), "uses")


def recipes(rows: DataFrame) -> DataFrame:
    """(uid, id, sha, recipe): each text's identifiers in order.

    The dictionary has one row a chunk, so a chunk that a third of all texts hold makes one side of the join long;
    it joins on fewer columns than it groups by, so both sides are dealt anew and Spark may split the long partitions.
    """
    known = chunk_dictionary(rows).select("hash", "proof", "first_uid", "first_pos")
    named = rows.join(known, ["hash", "proof"], "left")
    item = F.when(F.col("first_uid").isNotNull(), F.struct("pos", "first_uid", "first_pos"))
    lists = named.groupBy("uid").agg(F.first("id").alias("id"), F.first("sha").alias("sha"), F.sort_array(F.collect_list(item)).alias("r"))
    return lists.select("uid", "id", "sha", F.transform("r", lambda x: F.struct(x["first_uid"].alias("u"), x["first_pos"].alias("p"))).alias("recipe"))


def same_recipes(lists: DataFrame) -> DataFrame:
    """(key, recipe, keep, group_size, sha) per distinct recipe of staged lists (uid, id, sha, recipe, key), key a hash of recipe; texts of one recipe must have one SHA-256."""
    groups = lists.groupBy("key", "recipe").agg(F.max(F.struct("id", "uid")).alias("keep"), F.count("*").alias("group_size"), F.min("sha").alias("sha"), F.max("sha").alias("last"))
    verified = F.when(F.col("sha") == F.col("last"), F.col("sha")).otherwise(F.raise_error(F.lit("texts of one recipe have different SHA-256")).cast("binary"))
    return groups.select("key", "recipe", "keep", "group_size", verified.alias("sha"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty, and all empty texts are equal. The row with the
    largest id of a group stays (a null id is smaller than any; of rows that repeat the id one stays). Columns other than
    id_col and text_col are not read. An empty table gives an empty result.
    """
    rows = stage(chunk_rows(docs, id_col, text_col))
    lists = stage(recipes(rows).withColumn("key", F.xxhash64("recipe")))
    # written: both sides of the join are dealt anew, so Spark may split a group that a third of all rows are in
    groups = stage(same_recipes(lists)).select("key", F.col("recipe").alias("same"), "keep", "group_size", F.col("sha").alias("verified"))
    out = lists.select("uid", "id", "recipe", "key").join(groups, ["key"]).where(F.col("recipe") == F.col("same"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.uid") == F.col("uid")).alias("kept"), F.lower(F.hex("verified")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay. Ids must be unique and not null, for they name the rows to keep."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
