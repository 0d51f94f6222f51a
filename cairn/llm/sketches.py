"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of all hashes.

A sketch's size follows the document's, so a short document can be looked for in a very long one, and the sketch of a union is the
union of sketches. Two sketches are compared below the smaller of their two limits, where both know everything.

With floor=0 the limit is the fraction for every document. A text of n distinct shingles then keeps n/8 hashes on average, none at all
with probability (7/8)^n, and little can be said of short texts. FLOOR is a parameter that raises a short text's limit until so many of its
smallest hashes are below; the README has the measured errors with it and without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.token_files import slices
from cairn.llm.words import shingle_hashes

SHINGLE, FRACTION, FLOOR = 5, 1 / 8, 32
#: Documents and bytes of text in a run of neighbours, about; bytes in a partition of runs. Runs get longer only beyond MOST_RUNS of them.
RUN_DOCS, RUN_BYTES, PART_BYTES, MOST_RUNS = 1024, 16 << 20, 64 << 20, 1_000_000
_ALL = 1 << 64
NO_ID = -(2**63)


class Sketch:
    """Sorted distinct hashes, all that the document has below limit."""

    def __init__(self, hashes: np.ndarray, limit: int):
        self.hashes, self.limit = hashes, limit

    @classmethod
    def of(cls, shingles: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> Sketch:
        limit = int(fraction * _ALL)
        kept = np.unique(shingles[shingles <= np.uint64(limit - 1)])
        if len(kept) >= floor:
            return cls(kept, limit)
        h = np.unique(shingles)
        return cls(h[:floor], _ALL if len(h) <= floor else max(limit, int(h[floor - 1]) + 1))

    def below(self, limit: int) -> np.ndarray:
        return self.hashes if limit >= self.limit else self.hashes[: np.searchsorted(self.hashes, np.uint64(limit))]

    def __str__(self) -> str:
        return f"{self.limit:017x}:{self.hashes.astype('>u8').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        limit, _, hashes = text.partition(":")
        return cls(np.frombuffer(bytes.fromhex(hashes), ">u8").astype(np.uint64), int(limit, 16))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together."""
        limit = min(self.limit, other.limit)
        return Sketch(np.union1d(self.below(limit), other.below(limit)), limit)

    def _common(self, other: Sketch) -> tuple[int, int, int]:
        limit = min(self.limit, other.limit)
        a, b = self.below(limit), other.below(limit)
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Estimated shared shingles among those that either has; two documents without shingles are alike."""
        shared, a, b = self._common(other)
        return shared / (a + b - shared) if a + b else float(not len(self.hashes) and not len(other.hashes))

    def contained(self, other: Sketch) -> float | None:
        """Estimated share of this document's shingles that the other has; 1 if it has none, None if no hash of it lies below the common limit.

        Against a long document that limit is FRACTION of the range: n distinct shingles all lie above with probability (7/8)^n, 7 % at 20 and
        below 0.1 % from 52 on. Shorter texts may be unknown.
        """
        shared, a, _ = self._common(other)
        return shared / a if a else None if len(self.hashes) else 1.0


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """(doc_id, fingerprint) per row of docs, each of all shingle hashes below the fraction (and, for a short text, at least its `floor` smallest); a null text is empty, and an empty text has a sketch without hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 512, 1 << 20):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([str(Sketch.of(h, fraction, floor)) for h in shingle_hashes(texts, size)])], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(run, halo, id, t) sorted by run, halo, id downwards: each run of neighbouring ids in one partition, its last own row followed by a copy of the row after it.

    The runs' bounds are ids of the table, so a row sees by its own id whether it also follows another run. After the
    smallest id comes the largest. Rows that share an id are in one run, in the order of their texts: an id, or none, that very many have makes
    a run that long, which is sorted outside of memory and read in slices. Texts move once.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(ids.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    runs = max(1, min(MOST_RUNS, max(n // RUN_DOCS, (size or 0) // RUN_BYTES)))
    cuts = [k / runs for k in range(1, runs)]
    found = rows.agg(F.max("id").alias("top"), F.percentile_approx("id", cuts or [0.5], max(10_000, 10 * runs)).alias("cuts")).first()
    top = found["top"]
    bounds = np.array(sorted({x for x in found["cuts"] or [] if x != top} if cuts else []), np.int64)

    @F.pandas_udf("long")
    def place(own: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, own.to_numpy())
        last = np.append(bounds, NO_ID)[at] == own.to_numpy()
        return pd.Series(2 * at + (last & (at < len(bounds))))

    rows = rows.withColumn("place", place("id")).withColumn("run", F.expr("place div 2"))
    halo = lambda when, run, kind: F.when(when, F.struct(run.alias("run"), F.lit(kind).alias("halo")))
    copies = F.array(F.struct("run", F.lit(0).alias("halo")), halo(F.col("place") % 2 == 1, F.col("run") + 1, 1), halo(F.col("id") == F.lit(top), F.lit(0).cast("long"), 2))
    rows = rows.withColumn("copy", F.explode(F.filter(copies, lambda x: x.isNotNull()))).select("copy.run", "copy.halo", "id", "t")
    parts = max(1, -(-(size or 0) // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if runs > 1 else 1)
    return rows.repartition(min(parts, runs), "run").sortWithinPartitions("run", "halo", F.desc("id"), "t")


def edited(text: str, after: str) -> str:
    """text with its last third, rounded down, replaced by as much of the start of the text after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    near_edited is the likeness of the document's sketch to that of its edited text, near_next to that of the next document by falling
    id, after the smallest the largest; a table of one row is next to itself. A null text is empty. Rows that repeat an id
    follow each other by text; a null id is the smallest. Equal texts have equal fingerprints.
    """

    def report(rows: list[tuple], after: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        changed = [edited(t, x[3]) for t, x in zip(texts, after, strict=True)]
        raw = [t.encode() for t in changed]
        done = [Sketch.of(h, fraction, floor) for h in shingle_hashes([t.encode() for t in texts] + raw + [after[-1][3].encode()])]
        own, new, follow = done[: len(rows)], done[len(rows) : -1], [*done[1 : len(rows)], done[-1]]
        for k, (r, x) in enumerate(zip(rows[1:], after)):
            if r is not x:  # another run began here
                follow[k] = Sketch.of(shingle_hashes([x[3].encode()])[0], fraction, floor)
        cols = [
            [None if r[2] == NO_ID else r[2] for r in rows], list(map(len, texts)), [hashlib.sha256(t).hexdigest() for t in raw], list(map(str, own)), list(map(str, new)),
            [a.likeness(b) for a, b in zip(own, new, strict=True)], [a.likeness(b) for a, b in zip(own, follow, strict=True)],
        ]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, after, last, size = [], [], None, 0
        for b in slices(batches, 3, 512, 1 << 20):
            for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and last[1] == 0 and r[0] == last[0]:
                    rows.append(last)
                    after.append(r)
                    size += len(last[3])
                    if size > 1 << 20 or len(rows) >= 512:
                        yield report(rows, after)
                        rows, after, size = [], [], 0
                last = r
        if rows:
            yield report(rows, after)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_runs(docs, id_col, text_col).mapInArrow(run, schema)


EDITED = """
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(after, 1, length(t) // 3)) AS edited_sha256 FROM (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
