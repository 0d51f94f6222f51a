"""Near duplicates: 64-bit SimHash fingerprints, linked through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours share most of their bits. A node of the index is a run in that
order with its masked pattern: the bits that all its fingerprints share. Two nodes whose patterns differ in more than the allowed bits
hold no link, and the whole pair of groups is dropped; bits that an upper pair has compared are not compared again,
the differences accumulate on the way down. The upper levels are small tables, joined parent by parent. The lowest
pairs that survive are blocks of BLOCK fingerprints. A task descends further, through nodes of LEVELS fingerprints, and compares what is left
one by one. A pair of blocks returns the edges of a spanning forest, not its links. How much a level can prune depends on how many bits
its nodes share, about the logarithm of all nodes: below some 2**18 fingerprints the upper levels drop little, and prune_report tells how much.

similar_groups links by the share of word shingles instead, which 64 bits can't tell. A set of shingles has PRINTS SimHash fingerprints of PRINT_BITS
bits there, each led by a code of its number, and all go through the same index at once: codes differ in more bits than are allowed, so it links
equal numbers only. Within a pair of blocks only PRINT_BITS bits are left, few enough for half_forest, which finds the nodes that are near by their
patterns. Sets whose fingerprints of one number are linked, by others too, share a bucket; what shares a bucket is a candidate, and whole
sets of shingles decide. Of a bucket, pairs of blocks of sets move and are compared in numpy, and edges of a forest come back; never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, lean, passing, stage
from cairn.llm.components import components, union
from cairn.llm.token_files import slices
from cairn.llm.words import mix, shingle_hashes
from cairn.operators.table import few

SHINGLE, BITS_APART, SEED = 3, 3, 42
BLOCK, FANOUT = 32768, 8
#: Fingerprints in the nodes that a task descends through; each is a multiple of the next.
LEVELS = (2048, 256, 32)
#: Pairs of fingerprints for one task, before any are pruned; rows of one file of an upper level.
TASK_PAIRS, NODES = BLOCK * BLOCK // 4, 100_000
#: Pairs of blocks that are broadcast to the blocks, some 30 bytes each.
FEW_PAIRS = 100_000
_SPREAD = 200_000  # distances worked out at once
#: Of similar_groups: words of a shingle, least similarity, fingerprints of a set and bits of each. At a similarity of 0.8 a bit differs in 15 % of cases, so that
#: 3 bits or fewer of a fingerprint differ with probability 0.152, and those of at least one with 0.9999.
WORDS, SIMILAR, PRINTS, PRINT_BITS = 5, 0.8, 56, 38
#: A fingerprint's number stands above its bits, each bit of it CODE times, which is more than BITS_APART; TAG bits in all.
CODE, TAG = BITS_APART + 1, 24
#: Tagged fingerprints in a block of the index, which is split where a number ends, so that few meet other blocks.
TAGGED_BLOCK = 1 << 20
#: Fingerprints of a near node that each is compared with before those that are linked by then are left out.
DENSE = 8
#: A candidate's sets are compared if no more of all signature bits differ; at 0.8 that is 15 %, of unlike sets half.
DIFFER = 0.25
#: Sets, and shingles of theirs, in a block of a bucket; a longer set is a block of its own length.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, -(-PRINTS * PRINT_BITS // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; 0 if it has no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) per row: th is a hash of the text, which tells rows apart that repeat an id, fp the fingerprint's 64 bits as a long."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([*b.columns[:2], pa.array(fp.view(np.int64))], names=["id", "th", "fp"])

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, th long, fp long")


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("th"), F.col(text_col).alias("t"))


def gray_rank(fp: str):
    """The rank of the fingerprint in Gray order, as a long that sorts so."""
    x = F.col(fp)
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(2**63)))


def _pattern(x: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The mask of the bits that all of x share, and their values."""
    both = np.bitwise_and.reduce(x)
    mask = both | ~np.bitwise_or.reduce(x)
    return mask, both


def index_blocks(fps: DataFrame, block: int = BLOCK, *, tag: int = 0) -> DataFrame:
    """(node, mask, value, fps) per block of distinct fingerprints `fp`; blocks are numbered in Gray order, fps are 8 bytes each. No block holds fingerprints that differ in their first `tag` bits; of tagged ones some may be equal."""
    parts = max(1, -(-fps.count() // block))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if len(x := np.concatenate([np.zeros(0, np.uint64), *(np.asarray(b.column(0)).view(np.uint64) for b in batches)])):
            x ^= np.uint64(1 << 63)
            x ^= x >> np.uint64(1)  # the fingerprint of that rank
            tags = x >> np.uint64(64 - tag) if tag else np.zeros(len(x), np.uint64)
            first = TaskContext.get().partitionId() * (1 << tag // CODE)
            for k, part in enumerate(np.split(x, np.nonzero(tags[1:] != tags[:-1])[0] + 1)):
                mask, value = (pa.array(v.reshape(1).view(np.int64)) for v in _pattern(part))
                yield pa.record_batch([pa.array([first + k], pa.int64()), mask, value, pa.array([part.astype("<u8").tobytes()], pa.binary())], names=["node", "mask", "value", "fps"])

    ranked = fps.select(gray_rank("fp").alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    return stage(ranked.mapInArrow(run, "node long, mask long, value long, fps binary"))


def index_levels(blocks: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The index from the top: a table (node, parent, mask, value) a level, the last of the blocks. All nodes of the first have parent 0."""
    levels, top = [], blocks.agg(F.max("node")).first()[0] or 0
    level = blocks.select("node", "mask", "value", (F.octet_length("fps") / 8).alias("n"))
    while True:
        levels.append(level.withColumn("parent", F.expr(f"node div {fanout}")))
        top //= fanout
        if not top:
            return levels[::-1]
        shared = levels[-1].groupBy("parent").agg(F.expr("bit_and(mask)").alias("m"), F.expr("bit_and(value)").alias("every"), F.expr("bit_or(value)").alias("some"), F.sum("n").alias("n"))
        mask = F.col("m").bitwiseAND(F.bitwise_not(F.col("every").bitwiseXOR(F.col("some"))))
        level = stage(shared.select(F.col("parent").alias("node"), mask.alias("mask"), F.col("every").bitwiseAND(mask).alias("value"), "n").coalesce(1 + top // NODES))


def near_blocks(levels: list[DataFrame], apart: int = BITS_APART) -> DataFrame:
    """(a, b, work) for the pairs of blocks, a <= b, whose patterns allow fingerprints at most `apart` bits from each other; work is how many pairs they hold."""
    pairs = None
    for level in levels:
        a, b = (level.select(*(F.col(c).alias(f"{c}_{x}") for c in level.columns)) for x in "ab")
        if pairs is None:
            pairs = a.join(b, F.col("parent_a") == F.col("parent_b")).withColumns({"apart": F.lit(0), "seen": F.lit(0).cast("long")})
        else:
            pairs = pairs.join(a, F.col("parent_a") == F.col("a")).join(b, F.col("parent_b") == F.col("b"))
        common = F.col("mask_a").bitwiseAND(F.col("mask_b"))
        more = F.bit_count(F.col("value_a").bitwiseXOR(F.col("value_b")).bitwiseAND(common).bitwiseAND(F.bitwise_not(F.col("seen"))))
        pairs = pairs.where("node_a <= node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("apart") + more).alias("apart"), common.alias("seen"), (F.col("n_a") * F.col("n_b")).alias("work")).where(F.col("apart") <= apart)
    return pairs.select("a", "b", "work")


def block_forest(a: np.ndarray, b: np.ndarray, same: bool, apart: int = BITS_APART, levels: tuple = LEVELS, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a forest that spans the links between two blocks in Gray order, or within one. counts gets, by level, how many pairs of nodes were looked at and how many were left."""
    x = a if same else np.concatenate((a, b))
    parent, base = np.arange(len(x)), 0 if same else len(a)
    nodes = [[_nodes(y, n) for n in levels] for y in (a, b)]

    def descend(k: int, left: np.ndarray, right: np.ndarray, far: np.ndarray, seen: np.ndarray) -> None:
        """Pairs of nodes of level k, how many bits of them differ as far as looked at, and which bits those were."""
        (every_a, mask_a), (every_b, mask_b) = (side[k] for side in nodes)
        both = mask_a[left] & mask_b[right]
        far = far + np.bitwise_count((every_a[left] ^ every_b[right]) & both & ~seen)
        stay = far <= apart
        if counts is not None:
            counts[k] += len(left), stay.sum()
        left, right, far, both = left[stay], right[stay], far[stay], both[stay]
        last = k + 1 == len(levels)
        own = levels[k] if last else levels[k] // levels[k + 1]
        step = max(1, _SPREAD // own**2)
        for at in range(0, len(left), step):
            i = left[at : at + step, None] * own + np.arange(own)
            j = right[at : at + step, None] * own + np.arange(own)
            if last:  # a node's last place is taken again where the block ends
                i, j = np.minimum(i, len(a) - 1), np.minimum(j, len(b) - 1)
                p, q, r = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= apart)
                union(parent, i[p, q], j[p, r] + base)
                continue
            i, j = (np.broadcast_to(v, (len(i), own, own)).ravel() for v in (i[:, :, None], j[:, None, :]))
            keep = (i < len(nodes[0][k + 1][0])) & (j < len(nodes[1][k + 1][0]))
            if same:
                keep &= i <= j
            deeper = (np.repeat(v[at : at + step], own * own)[keep] for v in (far, both))
            descend(k + 1, i[keep], j[keep], *deeper)

    if len(a) and len(b):
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(nodes[0][0][0])), np.arange(len(nodes[1][0][0])), indexing="ij"))
        keep = i <= j if same else np.ones(len(i), bool)
        descend(0, i[keep], j[keep], np.zeros(keep.sum(), np.int64), np.zeros(keep.sum(), np.uint64))
    far = np.nonzero(parent != np.arange(len(x)))[0]
    return x[far], x[parent[far]]


def half_forest(a: np.ndarray, b: np.ndarray, same: bool, apart: int = BITS_APART, bits: int = PRINT_BITS, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As block_forest, for two blocks that share all but the last `bits` bits of a fingerprint. counts gets how many pairs of fingerprints were compared.

    What differs in `apart` bits differs in half as many, rounded down, of one half of them. So each half in turn leads the order: a node is a run that shares
    that half, its masked pattern, and instead of comparing nodes by pairs each goes to the nodes of the few patterns that near.
    """
    x = a if same else np.concatenate((a, b))
    parent, base = np.arange(len(x)), 0 if same else len(a)

    def compare(rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """Each of rows with those from first to end on the other side, both as they are ordered."""
        rows, first, many = (v[end > first] for v in (rows, first, end - first))
        upto = np.cumsum(many)
        for part in np.split(np.arange(len(rows)), np.searchsorted(upto, np.arange(_SPREAD * 8, upto[-1] if len(upto) else 0, _SPREAD * 8))):
            m = many[part]
            i = np.repeat(rows[part], m)
            j = np.arange(len(i)) + np.repeat(first[part] - (np.cumsum(m) - m), m)
            near = np.nonzero(np.bitwise_count(left[i] ^ right[j]) <= apart)[0]
            if counts is not None:
                counts[:] += len(i)
            if len(near):
                union(parent, rank_a[i[near]], rank_b[j[near]] + base)

    for shift, width in ((0, bits // 2), (bits // 2, bits - bits // 2)):
        keys = [(y >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64) for y in (a, b)]
        rank_a, rank_b = (np.argsort(k, kind="stable") for k in keys)
        key, left, right = keys[0][rank_a], a[rank_a], b[rank_b]
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(keys[1], minlength=1 << width))))
        for flip in (sum(1 << k for k in f) for n in range(apart // 2 + 1) for f in combinations(range(width), n)):
            other = key ^ flip
            rows = np.nonzero(other > key)[0] if same and flip else np.arange(len(key))
            first, end = (starts[other[rows] + k] for k in (0, 1))
            if same and not flip:
                first = rows + 1
            if (end - first).sum() <= DENSE * len(rows):
                compare(rows, first, end)
                continue
            # long runs, as many near copies make, are mostly one component after a few of each; then only those of others are met, a run ordered by component
            compare(rows, first, np.minimum(end, first + DENSE))
            group = parent[rank_b + base]
            again = np.lexsort((group, keys[1][rank_b]))
            rank_b, right = rank_b[again], right[again]
            own = other[rows] * len(x) + parent[rank_a[rows]]
            low, high = (np.searchsorted(keys[1][rank_b] * len(x) + group[again], own, side) for side in ("left", "right"))
            compare(rows, starts[other[rows]], low)
            compare(rows, high, starts[other[rows] + 1])
    far = np.nonzero(parent != np.arange(len(x)))[0]
    return x[far], x[parent[far]]


def _nodes(y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pattern of each run of n fingerprints: values and mask."""
    starts = np.arange(0, len(y), n)
    every, some = (f.reduceat(y, starts) if len(y) else y for f in (np.bitwise_and, np.bitwise_or))
    return every, every | ~some


def _block_pairs(fps: DataFrame, apart: int, tag: int = 0) -> DataFrame:
    """(a, b, fps_a, fps_b): the pairs of blocks that the upper levels leave, dealt by the work that they are. fps_b is null in a block's pair with itself."""
    blocks = index_blocks(fps, TAGGED_BLOCK, tag=tag) if tag else index_blocks(fps)
    pairs = stage(near_blocks(index_levels(blocks), apart))
    number, work = pairs.agg(F.count("*"), F.sum("work")).first()
    tasks = max(1, min(number, int((work or 0) // TASK_PAIRS)))
    sides = (pairs.select("a", "b", F.col(x).alias("node"), F.lit(x).alias("side")) for x in "ab")
    sides = next(sides).union(next(sides).where("a < b"))
    sent = blocks.select("node", "fps").join(F.broadcast(sides) if number <= FEW_PAIRS else sides, "node").repartition(tasks, "a", "b")
    return sent.groupBy("a", "b").agg(*(F.max(F.when(F.col("side") == x, F.col("fps"))).alias(f"fps_{x}") for x in "ab"))


def fingerprint_links(fps: DataFrame, apart: int = BITS_APART, tag: int = 0) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints `fp` as links of at most `apart` bits do; at most one a fingerprint and pair of blocks.

    Those whose first `tag` bits differ must differ in more than `apart`. Of equal ones, which only tagged ones may be, an edge (u, u) tells.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (a, more), (b, _) = (_once(x) for x in _sides(row))
                same = row["a"] == row["b"]
                u, v = (np.concatenate((x, more[: len(more) * same])) for x in (half_forest if tag else block_forest)(a, b, same, apart))
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return _block_pairs(fps, apart, tag).mapInArrow(run, "u long, v long")


def _sides(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a pair of blocks, the same array twice for a block and itself."""
    a = np.frombuffer(row["fps_a"], "<u8")
    return a, a if row["fps_b"] is None else np.frombuffer(row["fps_b"], "<u8")


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, in which equal ones are neighbours, without those that equal the one before, and those."""
    new = np.concatenate((np.ones(1, bool), x[1:] != x[:-1]))
    return x[new], x[~new]


def prune_report(fps: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """(size, looked, left) per level within blocks: pairs of nodes of `size` fingerprints that were looked at, and those not pruned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEVELS), 2), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block_forest(*_sides(row), row["a"] == row["b"], apart, counts=counts)
        yield pa.record_batch([pa.array(LEVELS, pa.int64()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["size", "looked", "left"])

    found = _block_pairs(fps, apart).mapInArrow(run, "size long, looked long, left long")
    return found.groupBy("size").agg(F.sum("looked").alias("looked"), F.sum("left").alias("left"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", apart: int = BITS_APART) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest id whose fingerprint links lead to.

    Words are runs of anything but ASCII white space, A-Z in lower case; a null or empty text has fingerprint 0 and links
    like any other. Rows that repeat an id or a text have equal components. A null id takes part, but names no component
    while another id is there. An empty table gives an empty result.
    """
    own = stage(fingerprints(docs, id_col, text_col))
    distinct = _distinct(own)
    return _members(own, _roots(distinct, fingerprint_links(distinct.select("fp"), apart)))


def _distinct(own: DataFrame) -> DataFrame:
    """(fp, root): the first row of each fp, by id (nulls last) and hash of the text."""
    return stage(own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("root")))


def _roots(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) with the first row of the whole component instead; links connect fps."""
    reached = components(links).withColumnRenamed("node", "fp")
    names = distinct.join(reached, "fp").groupBy("least").agg(F.min("root").alias("name"))
    named = distinct.join(reached.join(names, "least").select("fp", "name"), "fp", "left")
    return stage(named.select("fp", F.coalesce("name", "root").alias("root")))


def _members(own: DataFrame, roots: DataFrame) -> DataFrame:
    # hashed besides: a fingerprint that a third of all rows share may then be split
    own, roots = (x.withColumn("h", F.xxhash64("fp")) for x in (own, roots))
    return own.join(roots, ["fp", "h"]).select(F.col("id").alias("doc_id"), "fp", F.col("root.id").alias("component_id"))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The SimHash bits of a set of shingle hashes, 64 in each number. A bit is set where the votes for it outnumber the others by more than one: with that, a tie of an
    even number and the single vote over it of an odd one tell alike, and few shingles differ no more than many do."""
    counts = np.zeros(len(_FACTORS) * 64, np.int64)
    for at in range(0, len(shingles), 255):
        votes = mix(shingles[at : at + 255, None] * _FACTORS).astype("<u8").view(np.uint8)
        counts += np.unpackbits(votes, axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles) + 1, bitorder="little").view("<u8")


def tagged(signatures: np.ndarray) -> np.ndarray:
    """The fingerprints of each signature (a row of bytes), PRINTS a row, below the codes of their numbers."""
    bits = np.unpackbits(signatures, axis=1, count=PRINTS * PRINT_BITS, bitorder="little").reshape(-1, PRINTS, PRINT_BITS)
    wide = np.zeros((*bits.shape[:2], 64), np.uint8)
    wide[:, :, :PRINT_BITS] = bits
    number = np.arange(PRINTS)[:, None] >> np.arange(TAG // CODE) & 1
    wide[:, :, 64 - TAG :] = np.repeat(number, CODE, axis=1)
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, th, fp, n, values, shingles) per row: the text's n distinct shingles, sorted, 8 bytes each, their hash fp, and their signature's bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 512, 1 << 20):
            sets = [np.unique(h) for h in shingle_hashes([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()], words)]
            sizes = np.array([len(h) for h in sets], np.int64)
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64)
            cols = [*b.columns[:2], pa.array(fp.view(np.int64)), pa.array(sizes), pa.array([signature(h).tobytes() for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.record_batch(cols, names=["id", "th", "fp", "n", "values", "shingles"])

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, th long, fp long, n long, values binary, shingles binary")


def set_prints(sets: DataFrame) -> DataFrame:
    """(fp, n, tag): the tagged fingerprints of each of sets (fp, n, values)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                tags = tagged(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1))
                fp, n = (pa.array(np.repeat(np.asarray(b.column(k)), PRINTS)) for k in (0, 1))
                yield pa.record_batch([fp, n, pa.array(tags.ravel().view(np.int64))], names=["fp", "n", "tag"])

    return sets.select("fp", "n", "values").mapInArrow(run, "fp long, n long, tag long")


def _buckets(sets: DataFrame, similar: float) -> DataFrame:
    """(key, fp, n, hub): the sets (fp, n, values) of each bucket, hub (fp, n) its least, key the hub's fp: buckets of one hub are one.

    Two sets that share no bucket but their own must have like signatures: most of such pairs are met by chance, and whole sets of them needn't be read.
    """
    prints = set_prints(sets)  # made anew where they are read: they are several times what sets are
    links = stage(fingerprint_links(prints.select(F.col("tag").alias("fp")), tag=TAG))
    met = links.select(F.col("u").alias("tag")).union(links.select("v")).distinct()
    reached = components(links).withColumnRenamed("node", "tag")
    names = stage(met.join(reached, "tag", "left").select("tag", F.coalesce("least", "tag").alias("bucket")))
    held = stage(prints.join(few(names, 1_000_000), "tag").select("bucket", "fp", "n"))
    hubs = held.groupBy("bucket").agg(F.min(F.struct("fp", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    others = held.join(hubs, "bucket").where("fp <> hub.fp").groupBy(F.col("hub.fp").alias("key"), "fp").agg(F.first("n").alias("n"), F.first("hub").alias("hub"), F.max("many").alias("many"))
    others = stage(others)
    pairs = others.where((F.col("many") == 2) & _alike(similar)).select(F.col("key").alias("u"), F.col("fp").alias("v"))
    u, v = (sets.select(F.col("fp").alias(x), F.col("values").alias(f"s_{x}")) for x in "uv")
    like = pairs.join(u, "u").join(v, "v").select("u", "v", "s_u", "s_v").mapInArrow(_both(_agree), "u long, v long").select(F.col("u").alias("key"), F.col("v").alias("fp"))
    left = stage(others.where("many > 2").unionByName(others.join(like, ["key", "fp"], "left_semi")).select("key", "fp", "n", "hub"))
    return left.unionByName(left.select("key", F.col("hub.fp").alias("fp"), F.col("hub.n").alias("n"), "hub").distinct())


def _alike(similar: float):
    """Whether a bucket's set n may be that similar to its hub: far fewer shingles can't."""
    n, m = F.col("n"), F.col("hub.n")
    return F.least(n, m) >= F.lit(similar) * F.greatest(n, m)


def _agree(p: bytes, q: bytes) -> bool:
    """Whether no more than DIFFER of two signatures' bits differ."""
    return int(np.bitwise_count(np.frombuffer(p, np.uint8) ^ np.frombuffer(q, np.uint8)).sum()) <= DIFFER * 8 * len(p)


def _both(test):
    """The pairs (u, v) of (u, v, s_u, s_v) whose s pass the test."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [test(p, q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_links(own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(u, v): edges that connect the distinct sets of staged shingle_sets as links do between sets that share a bucket and at least `similar` of their shingles.

    A set is first compared with the least of all buckets' least sets that it meets, then with those of other components, and last come all
    pairs of a bucket that are still in different components, by blocks of the bucket. Of pairs, signatures are compared before whole sets.
    """
    # another set has at least one shingle more or less, so that a smaller one can't be that similar to any
    sets = own.where(F.col("n") >= F.lit(similar) * (F.col("n") + 1)).groupBy("fp").agg(F.first("n").alias("n"), F.first("values").alias("values"))
    sets = stage(sets)
    with passing(own.sparkSession):
        buckets = stage(_buckets(sets, similar), outlive=True)
    # of all sets only those that share a bucket are read again
    shared = few(buckets.select("fp").distinct())
    held = own.select("fp", "values", "shingles").join(shared, "fp", "left_semi").groupBy("fp").agg(F.first("values").alias("values"), F.first("shingles").alias("shingles"))
    held = stage(held)
    def share(p: bytes, q: bytes) -> bool:
        common = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
        return common >= similar * ((len(p) + len(q)) // 8 - common)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs)
        for column, test in (("values", _agree), ("shingles", share)):
            needed = few(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct())
            some = held.select("fp", F.col(column).alias("s")).join(needed, "fp", "left_semi")
            a, b = (some.select(F.col("fp").alias(x), F.col("s").alias(f"s_{x}")) for x in "uv")
            pairs = stage(pairs.join(a, "u").join(b, "v").select("u", "v", "s_u", "s_v").mapInArrow(_both(test), "u long, v long"))
        return pairs

    met = stage(buckets.where((F.col("fp") != F.col("hub.fp")) & _alike(similar)).select(F.col("hub.fp").alias("u"), F.col("fp").alias("v")).distinct())
    least_met = met.groupBy("v").agg(F.min("u").alias("u"))
    links = compared(least_met.select("u", "v"))
    names = stage(components(links))
    of = lambda x: names.select(F.col("node").alias(x), F.col("least").alias(f"c_{x}"))
    apart = met.join(least_met.withColumnRenamed("u", "least"), "v").where("u > least").join(of("u"), "u", "left").join(of("v"), "v", "left")
    links = links.unionByName(compared(apart.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")))
    names = stage(components(links))
    placed = stage(buckets.join(names.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", F.col("hub.fp").alias("hub"), F.coalesce("least", "fp").alias("c")))
    mixed = placed.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q"), F.count("*").alias("many"), F.sum("n").alias("all")).where("p < q")
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("many") / BLOCK_SETS, F.col("all") / BLOCK_SHINGLES))).cast("int")
    mixed = stage(mixed.select("key", blocks.alias("blocks")))
    return links.unionByName(stage(_bucket_links(held, placed.where("fp <> hub").join(mixed, "key"), mixed, similar)))


def _bucket_links(held: DataFrame, members: DataFrame, buckets: DataFrame, similar: float) -> DataFrame:
    """(u, v): edges that connect what the links of each bucket connect. held: (fp, values, shingles); members: (key, fp, c, blocks), c the component as known; buckets: (key, blocks).

    The members of a bucket are dealt to blocks by hash; each pair of blocks is one row, so a bucket of m sets moves about m / BLOCK_SETS times.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).join(held, "fp")
    packed = stage(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("fp", "c", "values", "shingles")).alias("sets")))
    pairs = buckets.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), "blocks").select("key", "a", F.explode(F.sequence("a", F.col("blocks") - 1)).alias("b"))
    a = packed.select("key", F.col("block").alias("a"), F.col("sets").alias("left"))
    b = packed.select("key", F.col("block").alias("b"), F.col("sets").alias("right"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u, v = set_forest(row["left"], row["right"] if row["a"] < row["b"] else None, similar)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    both = pairs.join(a, ["key", "a"]).join(b, ["key", "b"]).select("a", "b", "left", F.when(F.col("a") < F.col("b"), F.col("right")).alias("right"))
    return both.mapInArrow(run, "u long, v long")


def set_forest(left: list[dict], right: list[dict] | None, similar: float = SIMILAR) -> tuple[list[int], list[int]]:
    """Edges of a forest that spans the links between two blocks of sets, or within one (right None), of those that aren't in one component c already."""
    every = left + (right or [])
    cut, n = len(left) if right else 0, len(every)
    _, parent = np.unique(np.array([x["c"] for x in every], np.int64), return_inverse=True)
    first = np.full(n, n)
    np.minimum.at(first, parent, np.arange(n))
    parent, known = first[parent], first[parent]  # a set points to the first set of its component
    signs = np.frombuffer(b"".join(x["values"] for x in every), np.uint8).reshape(n, -1)
    sizes = np.array([len(x["shingles"]) // 8 for x in every])
    rows = range(cut) if right else range(n - 1)
    chosen = []
    for i in rows:
        others = np.arange(max(cut, i + 1), n)
        others = others[known[others] != known[i]]
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[small >= similar * large]  # fewer can't be that similar
        others = others[np.bitwise_count(signs[others] ^ signs[i]).sum(1) <= DIFFER * 8 * signs.shape[1]]
        if len(others):
            chosen.append((i, others))
    if not chosen:
        return [], []
    used = np.unique(np.concatenate([np.append(o, i) for i, o in chosen]))
    _, ids = np.unique(np.concatenate([np.frombuffer(every[k]["shingles"], np.uint64) for k in used.tolist()]), return_inverse=True)
    ends = np.cumsum(sizes[used])
    spans = {k: ids[z - s : z] for k, z, s in zip(used.tolist(), ends.tolist(), sizes[used].tolist(), strict=True)}
    has = np.zeros(int(ids.max()) + 1, bool)
    for i, others in chosen:
        others = others[parent[others] != parent[i]]  # linked meanwhile
        if not len(others):
            continue
        has[spans[i]] = True
        flat = np.concatenate([spans[k] for k in others.tolist()])
        common = np.add.reduceat(has[flat], np.concatenate(([0], np.cumsum(sizes[others])[:-1])), dtype=np.int64)
        has[spans[i]] = False
        linked = others[common >= similar * (sizes[i] + sizes[others] - common)]
        if len(linked):
            union(parent, np.full(len(linked), i), linked)
    far = np.nonzero(parent != known)[0]
    return [every[k]["fp"] for k in far.tolist()], [every[k]["fp"] for k in parent[far].tolist()]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """As near_groups, but rows are linked whose sets of shingles of so many words share at least `similar` of their union; texts without words are alike. fp is the hash of the set."""
    own, roots = _similar_roots(docs, id_col, text_col, words, similar)
    return _members(own, roots)


def _similar_roots(docs: DataFrame, id_col: str, text_col: str, words: int, similar: float) -> tuple[DataFrame, DataFrame]:
    own = stage(shingle_sets(docs, id_col, text_col, words))
    return own.select("id", "th", "fp"), _roots(_distinct(own), similar_links(own, similar))


def _first_rows(docs: DataFrame, own: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their component, told by id and hash of the text; of rows equal in both one stays."""
    i, h, x, y = fresh(docs, "root_id", "root_th", "gone_id", "gone_th")
    h_own, roots = own.withColumn("h", F.xxhash64("fp")), roots.withColumn("h", F.xxhash64("fp"))
    first = F.col("id").eqNullSafe(F.col("root.id")) & (F.col("th") == F.col("root.th"))
    gone = stage(h_own.join(roots, ["fp", "h"]).where(~first).select(F.col("id").alias(x), F.col("th").alias(y)).distinct(), outlive=True)
    marked = docs.withColumns({i: F.col(id_col).cast("long"), h: _text_hash(text_col)})
    kept = marked.join(gone, marked[i].eqNullSafe(gone[x]) & (marked[h] == gone[y]), "left_anti")
    unique = own.groupBy("id", "th").count().where("count > 1").isEmpty()
    return (kept if unique else kept.dropDuplicates([i, h])).drop(i, h)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", apart: int = BITS_APART) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays, a null id after all others.

    Columns are those of docs. Rows that repeat an id are documents of their own, told by their texts; rows that repeat id and text are one document, of which one row stays.
    """
    own = stage(fingerprints(docs, id_col, text_col))
    distinct = _distinct(own)
    return _first_rows(docs, own, _roots(distinct, fingerprint_links(distinct.select("fp"), apart)), id_col, text_col)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """As drop_near, by the components of similar_groups."""
    with passing(docs.sparkSession):
        return _first_rows(docs, *_similar_roots(docs, id_col, text_col, words, similar), id_col, text_col)
