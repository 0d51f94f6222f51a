"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a row of words: runs of letters and digits, and runs of signs. Its features are its word n-grams, single words and pairs of neighbours,
and, as an addition to those, its triples of word shapes (case, digits, glued to or repeating the word before; a run of signs is its own shape), each hashed to one of 2**BITS weights. A score is one sparse dot
product over the features' frequencies. Labels, language, source and id are never among the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lean
from cairn.llm.token_files import slices
from cairn.llm.words import mix, spans_hash

BITS, KEEP_FROM = 18, 0.3
#: The sample of labelled rows to learn from: those with the least hashes of their ids. Passes over it, and the update's constants.
TRAIN_ROWS, EPOCHS = 6000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002

_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[[*range(9, 14), 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER, _DIGIT, _LOWER = ((np.arange(256) >= a) & (np.arange(256) <= z) for a, z in ((65, 90), (48, 57), (97, 122)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and where each text's begin and the last's end."""
    joined = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    kind = _KIND[joined]
    edge = np.nonzero(kind[1:] != kind[:-1])[0] + 1
    starts, ends = edge, np.append(edge[1:], len(joined))
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    upto = np.searchsorted(starts, at)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = spans_hash(joined, starts, ends)
    has = [np.add.reduceat(np.append(m[joined], False).astype(np.int32), np.column_stack([starts, ends]).ravel())[::2] for m in (_UPPER, _LOWER, _DIGIT)]
    first_up = _UPPER[joined[starts]]
    shape = np.where(kind[starts] == 2, h, ((has[0] > 1).astype(np.uint64) * np.uint64(8) + (has[1] > 0) * np.uint64(4) + (has[2] > 0) * np.uint64(2) + first_up) + np.uint64(1))
    glued = np.append(False, starts[1:] == ends[:-1]).astype(np.uint64)
    begins = upto[:-1][upto[:-1] < upto[1:]]  # nothing spans two texts
    again = np.append(False, h[1:] == h[:-1])
    again[begins] = False
    shape = mix(shape * np.uint64(4) + glued * np.uint64(2) + again)
    pair, triple = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    pair[1:] = mix(h[:-1] * np.uint64(3) + h[1:])
    triple[2:] = mix(shape[:-2] * np.uint64(5) + shape[1:-1] * np.uint64(3) + shape[2:])
    pair[begins] = mix(h[begins] + np.uint64(1))
    stop = upto[1:][upto[:-1] < upto[1:]]
    for k in (0, 1):
        here = begins[begins + k < stop] + k
        triple[here] = mix(shape[here] + np.uint64(7 + k))
    every = np.stack([mix(h), pair, triple], 1).ravel()
    return (every >> np.uint64(64 - BITS)).astype(np.int64), upto * 3


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """The weights, the bias last, learnt from (features, values, label) in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(epochs):
        for at, x, y in examples:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _scale(n):
    return 8.0 / np.sqrt(np.maximum(n, 1) * np.maximum(n, 64))


def example(text: bytes, label: int) -> tuple[np.ndarray, np.ndarray, int]:
    at, _ = features([text])
    idx, counts = np.unique(at, return_counts=True)
    return np.append(idx, 1 << BITS), np.append(counts * _scale(len(at)), 1.0), label


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    at, upto = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
    n = np.diff(upto)
    return 1 / (1 + np.exp(-np.clip((sums[upto[1:]] - sums[upto[:-1]]) * _scale(n) + weights[-1], -35, 35)))


def _bucket(id_col: str, of: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most `rows` labelled documents that aren't held out; one task learns, and the driver gets 2**BITS numbers.

    Of labels that disagree on a document the larger counts; null labels and ids don't. Of documents that repeat an id one is learnt from, that
    whose text has the least hash. Without labelled rows every score is 1/2.
    """
    known = labels.where(F.col(label_col).isNotNull() & (_bucket(id_col, 5) != 0)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    sample = known.select(F.col(id_col).alias("id"), "label").orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("t", F.xxhash64("t")).alias("t"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [example(t or b"", y) for b in batches for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.record_batch([pa.array([ftrl(found).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    # at most `rows` rows meet in one task; the documents are read and joined by all
    one = texts.select("t", "label", F.xxhash64("id").alias("h")).repartition(1).sortWithinPartitions("h", "t").select("t", "label")
    found = [r[0] for r in one.mapInArrow(run, "weights binary").collect()]
    return np.frombuffer(bytes(found[0]), "<f4") if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, score, predicted) per row of docs. A null text is empty; an empty text gets the bias's score. Ids pass as they are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 512, 1 << 20):
            s = scores([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], weights)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= keep_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. A null id is not held out."""
    out = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select("doc_id", F.coalesce(_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that score keep_from or more, all columns as they were; rows are scored one by one, so repeated ids don't matter."""
    weights = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 512, 1 << 20):
            s = scores([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], weights)
            yield b.filter(pa.array(s >= keep_from))

    return docs.mapInArrow(run, docs.schema)
