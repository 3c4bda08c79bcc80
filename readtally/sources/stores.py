"""Files by path, local or in a store that Arrow's file systems know, and folders for files that queries write."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

#: Bytes that are copied at once.
PIECE = 4 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def uri(path: str) -> str:
    """The path with its scheme, so that Spark does not look for a local one in its default store."""
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def open_input(path: str):
    where, place = store(path)
    return where.open_input_file(place)


def open_output(path: str):
    where, place = store(path)
    return where.open_output_stream(place)


def is_file(path: str) -> bool:
    where, place = store(path)
    return where.get_file_info(place).type == fs.FileType.File


def make_folder(path: str) -> None:
    where, place = store(path)
    where.create_dir(place)


def files(path: str) -> list[tuple[str, int]]:
    """Files of a folder, by name, with their sizes."""
    where, place = store(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((head + x.path, x.size) for x in where.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File)


def move(source: str, target: str) -> None:
    """Renames a file, over one that is there."""
    where, place = store(source)
    where.move(place, store(target)[1])


def remove_folder(path: str) -> None:
    """Removes a folder and what it holds, if it is there."""
    where, place = store(path)
    if where.get_file_info(place).type == fs.FileType.Directory:
        where.delete_dir(place)


def takes_ranges(where: fs.FileSystem) -> bool:
    """Whether tasks can write at places of one file."""
    return isinstance(where, fs.LocalFileSystem)


def join(spark: SparkSession, target: str, head: bytes, parts: list[tuple[str, int]], tail: bytes = b"") -> None:
    """Makes one file of ``head``, the parts (paths and sizes) in order, and ``tail``. The driver reads no part: in a local (shared)
    file system tasks write the parts at their places, in other stores one task streams them."""
    where, place = store(target)
    sizes = [size for _, size in parts]
    at = [len(head) + sum(sizes[:i]) for i in range(len(parts))]
    if takes_ranges(where):
        with open(place, "wb") as f:
            f.write(head)
            f.seek(len(head) + sum(sizes))
            f.write(tail)
            f.truncate(len(head) + sum(sizes) + len(tail))
        rows, run = [(p, n, a) for (p, n), a in zip(parts, at, strict=True) if n], _copier(place)
    else:
        rows, run = [(p, n, a) for (p, n), a in zip(parts, at, strict=True)], _streamer(target, head, tail)
        rows = rows or [("", 0, 0)]
    if rows:
        # a row for each part, a task for each, or one task for all
        df = spark.createDataFrame(rows, "path string, size long, place long")
        df = df.repartition(len(rows), "place") if takes_ranges(where) else df.coalesce(1).sortWithinPartitions("place")
        copied = sum(r[0] for r in df.mapInArrow(run, "n long").collect())
        if copied != sum(sizes):
            raise OSError(f"{copied} bytes of {sum(sizes)} were copied to {target}")


def _pieces(path: str) -> Iterator[bytes]:
    with open_input(path) as f:
        while piece := f.read(PIECE):
            yield piece


def _copier(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                with open(target, "r+b") as f:
                    f.seek(row["place"])
                    for piece in _pieces(row["path"]):
                        f.write(piece)
                        n += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _streamer(target: str, head: bytes, tail: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open_output(target) as out:
            out.write(head)
            for batch in batches:
                for row in batch.to_pylist():
                    for piece in _pieces(row["path"]) if row["path"] else ():
                        out.write(piece)
                        n += len(piece)
            out.write(tail)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in ``spark.checkpoint.dir``; a local one where that is unset and the master
    is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        base = tempfile.mkdtemp(prefix="readtally-")
    path = f"{base.rstrip('/')}/readtally-files-{uuid.uuid4().hex}"
    make_folder(re.sub(r"^file:/+", "file:///", path))
    return re.sub(r"^file:/+", "file:///", path)
