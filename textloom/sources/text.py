"""Line files, plain or compressed."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How compressed files begin.
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}


def decompress(data: bytes) -> bytes:
    """Plain bytes of a file, by its first bytes: gzip, bzip2 or xz, of one member or several; anything else as it is."""
    for magic, kind in MAGIC.items():
        if data.startswith(magic):
            if kind == "gzip":
                return gzip.GzipFile(fileobj=io.BytesIO(data)).read()
            return bz2.decompress(data) if kind == "bzip2" else lzma.decompress(data)
    return data


def lines_of(data: bytes) -> list[bytes]:
    """Lines between newlines, without one carriage return before each; a last line without a newline counts as it is."""
    parts = data.split(b"\n")
    last = parts.pop()
    out = [p[:-1] if p.endswith(b"\r") else p for p in parts]
    return [*out, last] if last else out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line)`` of text files that Spark can split (plain, .gz, .bz2), without the carriage return before a line end."""
    df = spark.read.option("lineSep", "\n").text(path)
    return df.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def open_stream(path: str, plain: bool = True) -> BinaryIO:
    """A file's bytes as a stream, if ``plain`` decompressed as it is read; the path may name any file system that Arrow knows."""
    name = unquote(path) if path.startswith("file:") else path
    name = re.sub("^file:/*", "/", name)
    fs, at = (LocalFileSystem(), name) if name.startswith("/") else FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        head = f.read(8)
    raw = io.BufferedReader(fs.open_input_file(at), 1 << 20)
    kind = next((k for magic, k in MAGIC.items() if head.startswith(magic)), None)
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[kind](raw) if kind and plain else raw


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of all files, a task for each of the largest; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.repartitionByRange(F.col("length").desc(), "path").select("path")


def batched(rows: Iterator[tuple], columns: list[str], size: Callable[[tuple], int], limit: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Rows as frames of about ``limit`` bytes each."""
    block, held = [], 0
    for r in rows:
        block.append(r)
        held += size(r) + 64
        if held > limit:
            yield pd.DataFrame(block, columns=columns)
            block, held = [], 0
    if block:
        yield pd.DataFrame(block, columns=columns)


def stream_lines(f: BinaryIO) -> Iterator[bytes]:
    """The lines of ``lines_of``, one at a time."""
    for raw in f:
        if raw.endswith(b"\n"):
            yield raw[:-2] if raw.endswith(b"\r\n") else raw[:-1]
        else:
            yield raw


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, line)`` of files whose compression is told by their content; a task reads a file line by line."""

    def rows(p: str) -> Iterator[tuple]:
        with open_stream(p) as f:
            yield from ((p, i, x.decode("utf-8", "replace")) for i, x in enumerate(stream_lines(f)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.path:
                yield from batched(rows(p), ["path", "pos", "line"], lambda r: 2 * len(r[2]))

    return files_of(spark, path).mapInPandas(run, "path string, pos long, line string")


def write_lines(df: DataFrame, path: str, line: str = "line", compression: str = "none") -> None:
    """Text files; compression none, gzip or bzip2."""
    if compression not in ("none", "gzip", "bzip2"):
        raise ValueError(f"no compression {compression!r}")
    df.select(line).write.mode("overwrite").option("compression", compression).text(path)


def cat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files' lines, decompressed, in the order of the paths: ``(file_no, path, pos, line)``."""
    parts = [read_any(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
