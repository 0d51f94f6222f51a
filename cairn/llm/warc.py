"""WARC archives of pages: writing captures, reading records, and joining a capture's records again.

A capture is what WARC-Concurrent-To holds together, whichever record names which: here the response (or a revisit of an earlier equal
payload), and the request and metadata that name it. Spark's text writer puts records down, with the blank lines that end a record between them, in gzip files; so archives
are committed as any other table is, on any file system. Reading streams each file through its lengths, never by searching content.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.llm.common import shared_dir, stage

#: Payloads of fewer bytes are never revisits. The time that records of a table without times bear.
REVISIT_BYTES, DATE = 1000, "2024-01-01T00:00:00Z"
#: Bytes of payload in an archive file, about; beyond 2 GB no file can be read.
FILE_BYTES = 128 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str | Column, record_id: Column, uri: Column, content_type: str, block: Column, more: list[Column] = ()) -> Column:
    """The record's text; more: further header lines, each with its own line end, or null."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    lines += [F.coalesce(x, F.lit("")) for x in more]
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes three records per row of pages.

    Of rows with equal payloads of revisit_bytes or more, that with the largest id is the response and the others revisit it, without their
    payload; payloads are equal when length, SHA-1 and a 64-bit hash are. A null payload is empty, a null or odd address is made
    printable, a null id is the smallest. Rows that repeat an id and payload are captures of their own. An empty table makes no record.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:none")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    # rows without an id, or with one that many share, are told by their address besides
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("hash"), F.pmod(F.xxhash64("url"), F.lit(4096)).alias("salt"))
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    per_file = max(1, 3 * int(FILE_BYTES * n / max(size or 0, 512 * n, 1)))
    small = rows.where(F.col("size") >= revisit_bytes).select("id", "sha1", "size", "hash", "salt")
    first = small.groupBy("sha1", "size", "hash").agg(F.max(F.struct("id", "salt")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "size", "hash", "first.*")
    first = first.select("sha1", "size", "hash", F.col("id").alias("first"), F.col("salt").alias("first_salt"))
    # joined on fewer columns than grouped by: both sides are dealt anew, and a payload that a third of all rows share may be split
    revisits = small.join(first.drop("size"), ["sha1", "hash"]).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha1", "first", "first_salt").distinct()
    rows = rows.drop("hash").withColumn("key", F.coalesce("id", F.lit(-(2**63)))).join(revisits.select(F.coalesce("id", F.lit(-(2**63))).alias("key"), "sha1", "first", "first_salt"), ["key", "sha1"], "left")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("key", "sha1", "salt").orderBy("url")))
    name = lambda kind, i, salt, n: _uuid(F.lit(kind), i.cast("string"), F.col("sha1"), salt.cast("string"), n.cast("string"))
    own = (F.col("key"), F.col("salt"), F.col("nth"))
    capture, is_revisit = name("response", *own), F.col("first").isNotNull()
    concurrent = [F.concat(F.lit("WARC-Concurrent-To: "), capture, F.lit("\r\n"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"))
    refers = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), name("response", F.col("first"), F.col("first_salt"), F.lit(1)), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n")))
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("payload")))
    records = F.array(
        _record("request", name("request", *own), F.col("url"), "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")), concurrent),
        _record(F.when(is_revisit, "revisit").otherwise("response"), capture, F.col("url"), "application/http; msgtype=response", block, [digest, refers]),
        _record("metadata", name("metadata", *own), F.col("url"), "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")), concurrent),
    )
    out = rows.select(F.explode(records).alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, digest string, content_type string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def parse_records(file) -> Iterator[dict]:
    """The records of an open WARC file. Block is cut at the HTTP header's end for application/http; a digest is bare lower-case hex."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"a record can't begin with {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head.setdefault(k.strip().lower(), []).append(v.strip())
        one = lambda k: head.get(k, [None])[0]  # noqa: E731, B023
        size = int(one("content-length"))
        block = file.read(size)
        if len(block) < size:
            raise ValueError(f"the file ends within record {one('warc-record-id')}")
        kind, payload = one("content-type") or "", block
        if kind.startswith("application/http"):
            payload = block[at + 4 :] if (at := block.find(b"\r\n\r\n")) >= 0 else b""
        fields = None
        if kind.startswith("application/warc-fields"):
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)]
        yield {"record_id": one("warc-record-id"), "type": one("warc-type"), "uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "digest": (one("warc-payload-digest") or "").rpartition(":")[2].lower() or None, "content_type": kind, "fields": fields, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives under path, plain or gzip of one or many members; without payload that column is null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                file = gzip.open(raw) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, size = [], 0
                for r in parse_records(io.BufferedReader(file, 1 << 16) if file is not raw else raw):
                    size += r["payload_bytes"]
                    rows.append(r if payload else r | {"payload": None})
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


#: Records that a capture is about; all others of a capture are listed beside it.
ANCHORS = ("response", "revisit", "resource")


def _belongs(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) for every record of records (record_id, type, concurrent_to) that another one is concurrent to and that is no anchor itself.

    Concurrent-To is taken in both directions and through other records. A record belongs to the nearest anchor, of several as near the one with
    the least id; where no anchor can be reached, to the least id of all that hold together.
    """
    spark = records.sparkSession
    named = records.select("record_id", F.explode(F.array_distinct("concurrent_to")).alias("other"))
    anchors = records.where(F.col("type").isin(*ANCHORS)).select("record_id").distinct()
    both = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).where("record_id <> other")
    is_anchor = anchors.withColumnRenamed("record_id", "other").withColumn("anchor", F.lit(True))
    linked = both.join(is_anchor, "other", "left")
    near = linked.groupBy("record_id").agg(F.min(F.when(F.col("anchor"), F.col("other"))).alias("capture_id"), F.max(F.col("anchor").isNull()).alias("more"))
    # what only a name without a record, or an anchor, stands for is dropped here
    near = near.join(records.where(~F.col("type").isin(*ANCHORS)).select("record_id").distinct(), "record_id", "left_semi")
    done = stage(near)
    found, rest = [done.where("capture_id IS NOT NULL").select("record_id", "capture_id")], done.where("capture_id IS NULL AND more")
    if rest.isEmpty():
        return found[0]
    links = stage(linked.where("anchor IS NULL").select("record_id", "other").join(rest.select("record_id"), "record_id", "left_semi"))
    known, reached = found[0], 1
    while reached:  # one record further from the anchors each time
        new = links.join(known.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        for f in found:
            new = new.join(f.select("record_id"), "record_id", "left_anti")
        known = stage(new)
        reached = known.count()
        found.append(known)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # groups without an anchor: the least id spreads until it has reached all
    links = links.join(records.select(F.col("record_id").alias("other")).distinct(), "other", "left_semi").join(out.select("record_id"), "record_id", "left_anti")
    links = stage(links)
    least, before = stage(links.select("record_id").distinct().withColumn("capture_id", F.col("record_id"))), None
    while before != (state := least.agg(F.sum(F.xxhash64("record_id", "capture_id").cast("decimal(38,0)"))).first()[0]):
        before = state
        seen = links.join(least.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id")
        least = stage(seen.unionByName(least).groupBy("record_id").agg(F.min("capture_id").alias("capture_id")))
    return out.unionByName(least)


def captures(records: DataFrame) -> DataFrame:
    """A nested row per capture: capture_id, response, and the lists request, metadata and other, empty where there is none.

    A capture has one response, revisit or resource, and all records that WARC-Concurrent-To joins to it: any of its values, in either
    direction, through other records too. capture_id is the response's id. Records that hold together without a response make a row
    with a null response under the least of their ids, and so does a request or metadata record that nothing is concurrent to; records of
    other types that stand alone (warcinfo, conversion) are no captures. Records of one id are read as they come; a writer must not
    repeat ids. An empty table gives an empty result.
    """
    of = _belongs(records.select("record_id", "type", "concurrent_to"))
    # joined under another name and a hash: both sides are dealt anew
    of = of.select(F.col("record_id").alias("member"), F.col("capture_id"))
    whole = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    anchor = F.col("type").isin(*ANCHORS)
    joined = records.join(of, (F.col("record_id") == F.col("member")) & ~anchor, "left")
    alone = F.when(anchor | F.col("type").isin("request", "metadata"), F.col("record_id"))
    joined = joined.select(F.coalesce("capture_id", alone).alias("capture_id"), "type", whole.alias("record")).where("capture_id IS NOT NULL")
    pick = lambda test: F.collect_list(F.when(test, F.col("record")))
    listed = [pick(F.col("type") == k).alias(k) for k in ("request", "metadata")]
    return joined.groupBy("capture_id").agg(F.first(F.when(anchor, F.col("record")), ignorenulls=True).alias("response"), *listed, pick(~anchor & ~F.col("type").isin("request", "metadata")).alias("other"))


def page_report(pages: DataFrame) -> DataFrame:
    """Per row of pages, from the archives written of it: page_id, payload_bytes, payload_digest, record_type, refers_to, the response's page_id.

    A null payload is empty and a response. Of rows with one payload and the same largest id each is a response; a null id counts as
    smaller than any and comes back null. Rows that repeat are captures of their own. Columns but id, address and payload are not read. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_captures(pages, path)
    # parsed once; without payloads the records are small
    records = stage(read_records(spark, path, payload=False).select("record_id", "type", "concurrent_to", "refers_to", "fields", "payload_bytes", "payload_digest"))
    found = captures(records)
    page = F.expr("try_cast(metadata[0].fields['pageId'] AS BIGINT)")
    found = stage(found.select("capture_id", page.alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest"))
    revisits, responses = found.where("type = 'revisit'"), found.where("type = 'response'")
    target = responses.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("sha1"))
    seen = revisits.join(target, "refers_to", "left").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("target").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(seen)


ORACLE = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN last END AS refers_to
FROM (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last,
    strlen(h) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) AS revisit
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)
)
"""
