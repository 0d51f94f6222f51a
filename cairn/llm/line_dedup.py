"""Lines that repeat across documents are dropped, except in the first document, through a sharded minimal perfect hash.

All distinct line hashes are dealt to shards. A shard is three flat arrays (fingerprint, count of
holders, first holder) behind a minimal perfect hash of its lines: levels of bits, where a line that meets no other at its place of
a level takes that place's rank, and all others go on to the next level. A line that isn't in the shard
also gets a rank, and the fingerprint there gives it away. Blocks of documents send each distinct line's hash once to the
line's shard; the count there decides, and the first holders come back. The lines themselves are never joined or moved apart from their document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.llm.common import arrow_schema, fresh, give_back, lean, stage

MIN_CHARS = 10
WHITE = b" \t\n\x0b\x0c\r"
#: Hashes in a shard; documents and bytes of text in a block, about; bytes in a partition of the last shuffle.
SHARD_LINES, BLOCK_DOCS, BLOCK_BYTES, PART_BYTES = 1 << 18, 512, 4 << 20, 64 << 20
_GAMMA, _LEVELS = 2, 48
_blocks = itertools.count()  # that this worker has cut
NO_ID = -(2**63)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line's 16-byte hash after stripping and lower-casing; None if it has fewer than min_chars code points."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: bytes) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, blocks: int = 1) -> DataFrame:
    """(h1, h2, id, block): a row per document and distinct line that counts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                keys, reps = [], []
                for text in b.column(2).cast(pa.binary()).to_pylist():
                    own = {k for x in (text or b"").split(b"\n") if (k := line_key(x, min_chars))}
                    keys += own
                    reps.append(len(own))
                ids, block = (pa.array(np.repeat(np.asarray(b.column(k)), reps), pa.int64()) for k in (0, 1))
                yield pa.record_batch([*_halves(b"".join(keys)), ids, block], names=["h1", "h2", "id", "block"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("t"))
    return rows.select("id", F.pmod(F.xxhash64("id", F.xxhash64("t")), F.lit(blocks)).cast("long").alias("block"), "t").mapInArrow(run, "h1 long, h2 long, id long, block long")


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: sizes of the levels, their bits as words, ones before each word, and what no level placed."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.ranks, self.rest = sizes, words, ranks, rest

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, words = np.unique(hashes), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-len(left) * _GAMMA // 64) * 64
            at = _places(left, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        w = np.concatenate([np.zeros(0, np.uint64), *words])
        ones = np.bitwise_count(w).astype(np.int64)
        return cls(np.array(sizes, np.int64), w, np.cumsum(ones) - ones, np.sort(left))

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, below the number of hashes built from; -1 or any place for one that wasn't among them."""
        out = np.full(len(hashes), -1, np.int64)
        todo, first = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(hashes[todo], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + first, at & np.uint64(63)
            w = self.words[word]
            hit = (w >> bit & np.uint64(1)).astype(bool)
            out[todo[hit]] = self.ranks[word[hit]] + np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            todo, first = todo[~hit], first + size // 64
        if len(self.rest) and len(todo):
            k = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            same = self.rest[k] == hashes[todo]
            out[todo[same]] = int(np.bitwise_count(self.words).sum()) + k[same]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.rest)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.sizes.astype("<i8"), self.words.astype("<u8"), self.ranks.astype("<i8"), self.rest.astype("<u8")))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n, w, r = np.frombuffer(data, "<i8", 3).tolist()
        return cls(np.frombuffer(data, "<i8", n, 24), np.frombuffer(data, "<u8", w, 24 + 8 * n), np.frombuffer(data, "<i8", w, 24 + 8 * (n + w)), np.frombuffer(data, "<u8", r, 24 + 8 * (n + 2 * w)))


def build_index(lines: DataFrame) -> DataFrame:
    """(shard, hash, starts, fingerprint, holders, first) a shard, as flat arrays; lines: (shard, h1, h2, n, lo), a row per distinct line, n how many documents hold it. Lines that agree in h1 share a place."""
    schema = "shard long, hash binary, starts binary, fingerprint binary, holders binary, first binary"
    target = arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        h1, h2, n, lo = (np.asarray(t.column(c).combine_chunks()) for c in ("h1", "h2", "n", "lo"))
        ph = PerfectHash.build(h1.view(np.uint64))
        at = ph.index(h1.view(np.uint64))
        order = np.argsort(at, kind="stable")
        # two lines with equal h1 (1 in 2**64) stand side by side: starts has each place's first entry
        starts = np.searchsorted(at[order], np.arange(at.max() + 2))
        arrays = {"hash": ph.dump(), "starts": starts.astype("<i4").tobytes(), "fingerprint": h2[order].astype("<i8").tobytes(), "holders": np.minimum(n[order], 2**32 - 1).astype("<u4").tobytes(), "first": lo[order].astype("<i8").tobytes()}
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in arrays.items()}).cast(target)

    return lines.groupBy("shard").applyInArrow(run, schema)


def probe(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(block, h1, h2, first) for the asked (shard, h1, h2, block) whose line the index counts in two documents or more."""

    def run(t: pa.Table, shard: pa.Table) -> pa.Table:
        h1, h2 = (np.asarray(t.column(c).combine_chunks()) for c in ("h1", "h2"))
        found, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = lambda c, kind: np.frombuffer(shard.column(c)[0].as_py(), kind)
        first = np.zeros(0, np.int64)
        if shard.num_rows and t.num_rows:
            starts, prints, first, holders = get("starts", "<i4"), get("fingerprint", "<i8"), get("first", "<i8"), get("holders", "<u4")
            at = PerfectHash.load(shard.column("hash")[0].as_py()).index(h1.view(np.uint64))
            known = np.nonzero(at >= 0)[0]
            lo, hi = starts[at[known]], starts[at[known] + 1]
            for k in range(int((hi - lo).max(initial=0))):
                here = lo + k < hi
                same = (prints[(lo + k)[here]] == h2[known[here]]) & (holders[(lo + k)[here]] > 1)
                found, place = np.append(found, known[here][same]), np.append(place, (lo + k)[here][same])
        block = np.asarray(t.column("block").combine_chunks()) if t.num_rows else found
        return pa.table({"block": pa.array(block[found], pa.int64()), "h1": pa.array(h1[found], pa.int64()), "h2": pa.array(h2[found], pa.int64()), "first": pa.array(first[place], pa.int64())})

    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, "block long, h1 long, h2 long, first long")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text_col cut down to the lines that stay, and the columns n_lines and n_dropped (lengthened by _ if docs has such).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of min_chars code points or more
    that two ids hold lose all their lines but those of the smallest id. Null and empty texts have one empty line and stay as
    they are. Rows that repeat an id count as one document; a null id counts as smaller than any. Other columns pass through.
    """
    n_lines, n_dropped, block, key = fresh(docs, "n_lines", "n_dropped", "block", "key")
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    blocks = max(1, -(-rows // BLOCK_DOCS), -(-(size or 0) // BLOCK_BYTES))
    # rows that share an id are dealt by their text besides, so that an id, or none, that many have makes no block of its own
    in_block = F.pmod(F.xxhash64(F.col(key), F.xxhash64(text_col)), F.lit(blocks))
    held = line_rows(docs, id_col, text_col, min_chars, blocks).withColumnRenamed("id", key)
    held = stage(held.groupBy("h1", "h2", "block").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")))
    shards = max(1, -(-held.count() // SHARD_LINES))
    shard = F.pmod("h1", F.lit(shards)).cast("long").alias("shard")
    lines = held.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    index = stage(build_index(lines.select(shard, "h1", "h2", F.when(F.col("lo") < F.col("hi"), F.greatest(F.lit(2), "n")).otherwise(F.lit(1)).alias("n"), "lo")))
    answers = stage(probe(index, held.select(shard, "h1", "h2", "block")))

    out_schema = StructType(docs.schema.fields[:]).add(n_lines, "long").add(n_dropped, "long")
    target = arrow_schema(out_schema)
    ids, text_at, width = docs.columns.index(id_col), docs.columns.index(text_col), len(docs.columns)

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        pairs = np.column_stack([np.asarray(known.column(c).combine_chunks()) for c in ("h1", "h2")]).astype(">i8").tobytes() if known.num_rows else b""
        first = dict(zip((pairs[i : i + 16] for i in range(0, len(pairs), 16)), known.column("first").to_pylist(), strict=True))
        texts, n, gone = [], [], []
        for doc, text in zip(t.column(ids).to_pylist(), t.column(text_at).cast(pa.binary()).to_pylist(), strict=True):
            doc, parts = NO_ID if doc is None else doc, (text or b"").split(b"\n")
            stay = [x for x in parts if first.get(line_key(x, min_chars), doc) == doc]
            texts.append(text if len(stay) == len(parts) else b"\n".join(stay))
            n.append(len(parts))
            gone.append(len(parts) - len(stay))
        if next(_blocks) % 8 == 7:
            give_back()
        cols = [t.column(i) for i in range(width)]
        cols[text_at] = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        return pa.table([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=out_schema.names).cast(target)

    dealt = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(block, in_block).drop(key)
    parts = max(1, min(blocks, -(-(size or 0) // PART_BYTES)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if (size or 0) > PART_BYTES else 1)
    return dealt.repartition(parts, block).groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(run, out_schema)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), held AS (
  SELECT k, min(doc_id) AS lo FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, i, l, lo IS NOT NULL AND lo <> doc_id AS gone FROM lines LEFT JOIN held USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
