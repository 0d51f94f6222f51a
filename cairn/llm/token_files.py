"""Token ids as binary files: ids are ranked by how often the corpus uses them, and ranks written in 1 to 4 whole bytes.

Two bits an id, in control bytes of their own, hold the rank's length less one. Decoding looks the control bytes up in a table of
lengths and places all data at once. A file holds blocks in ascending document order, each with all control bytes before all data:

    magic 4s | documents u4 | control bytes u8 | data bytes u8 | ids i8 each | flags u1 each | tokens u4 each | control | data | newline

all little-endian. Spark's text writer puts the blocks down, so files are committed as any other table of Spark's is, on any file system.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import shared_dir, stage
from cairn.llm.letters import Pieces

MAGIC, END_ID = b"CVB1", 2
FILE_BYTES, BLOCK_BYTES = 8 << 20, 2 << 20
#: Words whose ids a worker remembers; when full it forgets them all.
CACHED_WORDS = 600_000

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)  # lengths less one of the four ids of a control byte
_PLACES = np.arange(4) < np.arange(1, 5)[:, None]  # which of four bytes a rank of each length uses


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes."""
    code = (ranks >= 1 << 8).view(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    four[: len(code)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, ranks.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[_PLACES[code]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks."""
    out = np.zeros((n, 4), np.uint8)
    out[_PLACES[_CODES[control].reshape(-1)[:n]]] = data
    return out.view("<u4").reshape(-1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


_ENCODERS: dict = {}


class WordEncoder(dict):
    """The packed ids of each run of text without ASCII white space, which a piece of the tokenizer never spans.

    The library's normalizer and model do the work, once for each distinct piece; its pattern is read from the tokenizer's
    file. A text with a special token, or any run under a file of another build, goes through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.pieces = self.tokenizer.model.tokenize, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        normalizers = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = normalizers == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and not splits[1]["use_regex"]
        self.find = Pieces(splits[0]["pattern"]["Regex"]) if known else None
        self.letters = dict(enumerate(byte_alphabet()))

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __missing__(self, run: bytes) -> bytes:
        if self.find is None:
            out = self._whole(run)
        else:
            text = run.decode()
            # up to U+024F nothing composes, lower case doesn't depend on the neighbours, and all agree on what a letter is
            text = text.lower() if (low := max(text) < Pieces.FIRST) else self.tokenizer.normalizer.normalize_str(text)
            if low and text.isalpha():
                out = self._piece(text)
            elif low and text[-1] in ".,;:!?" and text[:-1].isalpha():
                out = self._piece(text[:-1]) + self._piece(text[-1])
            else:
                out = b"".join(map(self._piece, self.find(text)))
        self[run] = out
        return out

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            out = self.pieces[piece] = array(self.kind, [t.id for t in self.model(shown)]).tobytes()
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as packed integers of `kind`."""
        for held in (self, self.pieces):
            if len(held) > CACHED_WORDS:
                held.clear()
        return [self._whole(t) if any(x in t for x in self.special) else b"".join(map(self.__getitem__, t.split())) for t in texts]

    def _whole(self, text: bytes) -> bytes:
        return array(self.kind, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, but for a longer single one, about so many bytes of a text column."""
    for b in batches:
        ends = _ends(b.column(column)) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends[at + 1 :], ends[at] + size, side="right")) + at
            to = min(max(to, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def _ends(column: pa.Array) -> np.ndarray:
    """Where the texts or bytes of a column begin, and the last ends; large Arrow types have offsets of 8 bytes."""
    kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind.itemsize)


def values(column: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column without nulls as one array."""
    ends = _ends(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def token_rows(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(id, n, ids): each text's ids, the end id after them, as packed unsigned integers (2 bytes if the vocabulary allows, else 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = array(encoder.kind, [] if end_id is None else [end_id]).tobytes()
        for b in slices(batches, 1):
            ids = [x + end for x in encoder.ids([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])]
            n = [len(x) // array(encoder.kind).itemsize for x in ids]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n long, ids binary")


def id_ranks(tokens: DataFrame, width: int, most: int) -> np.ndarray:
    """The ids by falling frequency over all of tokens, ties by id. One count an id of the vocabulary comes to the driver."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(most, np.int64)
        for b in slices(batches, 0, 4096):
            n += np.bincount(values(b.column(0), kind), minlength=most)
        used = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(n[used])], names=["id", "n"])

    n = np.zeros(most, np.int64)
    for k, v in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        n[k] = v
    return np.argsort(-n, kind="stable").astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes path/blocks, the files in ascending id order (null first), and path/ranks, the ids by rank."""
    spark = docs.sparkSession
    encoder = WordEncoder.of(tokenizer)
    width, most = array(encoder.kind).itemsize, max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1)
    tokens = stage(token_rows(docs, tokenizer, id_col, text_col, end_id), spark, codec="zstd")
    by_rank = id_ranks(tokens, width, most)
    rank = np.empty(most, np.uint32)
    rank[by_rank] = np.arange(most, dtype=np.uint32)
    spark.createDataFrame([(bytearray(by_rank.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 1 << 16, BLOCK_BYTES):
            ids, n = b.column(0), np.asarray(b.column(1))
            control, data = pack(rank[values(b.column(2), f"<u{width}")])
            head = MAGIC + np.array([len(n)], "<u4").tobytes() + np.array([len(control), len(data)], "<u8").tobytes()
            index = (np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_valid().cast(pa.uint8())), n.astype("<u4"))
            yield pa.record_batch([pa.array([b"".join([head, *(x.tobytes() for x in (*index, control, data))])], pa.binary())], names=["block"])

    total = tokens.agg(F.sum("n")).first()[0] or 0
    files = tokens.repartitionByRange(max(1, -(-total * 3 // 2 // file_bytes)), "id").sortWithinPartitions("id")
    files.mapInArrow(block, "block binary").select(F.col("block").cast("string")).write.text(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """(file, id, n, local, ids): each document of the files; local counts the ids before it in its file. With crc, ids is the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    row = spark.read.parquet(f"{path}/ranks").first()
    by_rank = np.frombuffer(bytes(row[0]), "<u4")

    def blocks(content):
        raw, pos = np.frombuffer(content.as_buffer(), np.uint8), 0
        while pos < len(raw):
            if raw[pos : pos + 4].tobytes() != MAGIC:
                raise ValueError(f"no block at byte {pos}")
            docs = int(raw[pos + 4 : pos + 8].view("<u4")[0])
            controls, datas = raw[pos + 8 : pos + 24].tobytes(), pos + 24
            controls, data_bytes = np.frombuffer(controls, "<u8").tolist()
            fields = []
            for kind, size in (("<i8", 8 * docs), ("u1", docs), ("<u4", 4 * docs), ("u1", controls), ("u1", data_bytes)):
                fields.append(np.frombuffer(raw[datas : datas + size].tobytes(), kind))
                datas += size
            yield fields
            pos = datas + 1  # the newline

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                local = 0
                for ids, valid, n, control, data in blocks(content):
                    n = n.astype(np.int64)
                    packed = by_rank[unpack(control, data, int(n.sum()))].astype("<u4").tobytes()
                    ends = np.cumsum(n)
                    each = [packed[4 * a : 4 * z] for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                    got = pa.array(list(map(zlib.crc32, each)), pa.int64()) if crc else pa.array(each, pa.binary())
                    yield pa.record_batch([pa.array(np.full(len(n), file)), pa.array(ids.astype(np.int64), mask=valid == 0), pa.array(n), pa.array(local + ends - n), got], names=["file", "id", "n", "local", "ids"])
                    local += int(n.sum())

    content = spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return content.select(number.alias("file"), "content").mapInArrow(run, f"file long, id long, n long, local long, ids {'long' if crc else 'binary'}")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Per row of docs, from the files written of it: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id alone. Rows that repeat an id follow each other; a null id comes first. An empty table
    makes files without a block and an empty result. A text may be of any length below 2 GB; it is one row.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_tokens(docs, tokenizer, path, id_col, text_col, end_id)

    found = stage(read_tokens(spark, path, crc=True))
    # a row a file: the window holds no documents
    files = found.groupBy("file").agg(F.sum("n").alias("all")).select("file", (F.sum("all").over(W.orderBy("file")) - F.col("all")).alias("before"))
    return found.join(files, "file").select(F.col("id").alias("doc_id"), (F.col("before") + F.col("local")).alias("start"), F.col("n").alias("n_tokens"), F.col("ids").alias("ids_crc32"))
