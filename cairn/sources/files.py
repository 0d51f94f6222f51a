"""Opening inputs by path or address, and writing one file from a table's blocks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are copied at once where a file's parts are put together.
COPY = 1 << 24


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def size_of(path: str) -> int:
    store, at = _store(path)
    return store.get_file_info(at).size


def read_range(path: str, offset: int = 0, size: int | None = None) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return f.read_at(size if size is not None else f.size() - offset, offset)


def read_ranges(path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """Bytes (offset, size) of a file that is opened once; neighbours are read at once."""
    store, at = _store(path)
    joined: list[list[int]] = []
    for offset, size in ranges:
        if joined and sum(joined[-1]) == offset:
            joined[-1][1] += size
        else:
            joined.append([offset, size])
    with store.open_input_file(at) as f:
        for offset, size in joined:
            data = f.read_at(size, offset)
            if len(data) < size:
                raise ValueError(f"{path} ends within its data")
            yield data


def read_gzip_ranges(path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """Bytes (offset, size), in order, of what a file in gzip holds; the rest is passed over."""
    import gzip

    store, at = _store(path)
    out, here = [], 0
    with store.open_input_stream(at) as raw, gzip.GzipFile(fileobj=raw) as f:
        for offset, size in ranges:
            while here < offset:
                if not (n := len(f.read(min(COPY, offset - here)))):
                    raise ValueError(f"{path} ends early")
                here += n
            out.append(f.read(size))
            here += size
            if len(out[-1]) < size:
                raise ValueError(f"{path} ends early")
    return out


def read_header(path: str, limit: int) -> bytes:
    return read_range(path, 0, min(limit, size_of(path)))


def read_member(path: str, name: str) -> bytes:
    """One member of a ZIP archive; of the rest only the directory is read."""
    import zipfile

    store, at = _store(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        return z.read(name)


def list_files(path: str, suffix: str = "") -> list[str]:
    """The file itself, or a folder's files by name."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = [f for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File]
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(root + f.path for f in found if f.path.lower().endswith(suffix))


def write_file(path: str, parts: Iterator[bytes], overwrite: bool = True) -> None:
    """The parts in order, under a name of their own until all are there: two attempts at one file don't meet."""
    store, at = _store(path)
    from pyarrow import fs

    if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(os.path.dirname(at) or ".", recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    store.move(part, at)


def write_tables(spark: SparkSession, path: str, parts: list[bytes | DataFrame], overwrite: bool = True) -> None:
    """Bytes and tables of one binary column, one after another in one file that executors reach.

    Tasks write what they hold beside the file, and one task puts it together, COPY bytes at a time: a row a partition comes to the driver.
    """
    from pyarrow import fs

    store, at = _store(path)
    if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(os.path.dirname(at) or ".", recursive=True)
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/{uuid.uuid4().hex}"  # each attempt has a file of its own
        store, at = _store(name)
        with store.open_output_stream(at) as f:
            for b in batches:
                for x in b.column(0):
                    f.write(x.as_buffer())
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([name])], names=["at", "name"])

    names: list[bytes | str] = []
    for x in parts:
        names += [x] if isinstance(x, bytes) else [r.name for r in sorted(x.mapInArrow(keep, "at long, name string").collect())]

    def copied() -> Iterator[bytes]:
        for x in names:
            if isinstance(x, bytes):
                yield x
                continue
            store, at = _store(x)
            with store.open_input_stream(at) as f:
                while data := f.read(COPY):
                    yield data

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            write_file(path, copied(), overwrite)
            yield b

    spark.range(1, numPartitions=1).mapInArrow(join, "id long").collect()
    _store(folder)[0].delete_dir(_store(folder)[1])
