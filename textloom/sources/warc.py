"""Web archive files: records with headers and payload."""

from __future__ import annotations

import gzip
import io
import itertools
import subprocess
import threading
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.text import batched, files_of, open_stream

#: Longest headers of a record.
HEADER_BYTES = 1 << 20
SCHEMA = "path string, record_no long, version string, headers map<string,string>, payload binary"


def records_of(f: BinaryIO) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``(version, headers, payload)`` of each record of a stream of plain bytes; header names are lower-cased.

    ValueError for another first line than WARC/1.0, headers that don't end or are longer than HEADER_BYTES, a missing or
    repeated Content-Length, a short payload, or a record that doesn't end with two line ends. One record is held at a time.
    """
    while first := f.readline(HEADER_BYTES):
        if first != b"WARC/1.0\r\n":
            raise ValueError(f"a record begins with {first[:40]!r}")
        headers: dict[str, str] = {}
        left = HEADER_BYTES
        while (ln := f.readline(left)) != b"\r\n":
            left -= len(ln)
            if not ln.endswith(b"\n") or left <= 0:
                raise ValueError("a record's headers do not end")
            name, _, value = ln.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            if name == "content-length" and name in headers:
                raise ValueError("a record has two lengths")
            headers[name] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record has no length")
        size = int(headers["content-length"])
        payload = f.read(size)
        if len(payload) < size or f.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short or goes on after its length")
        yield "WARC/1.0", headers, payload


def parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``records_of`` plain bytes."""
    return records_of(io.BytesIO(data))


def dump(headers: dict[str, str], payload: bytes, compress: bool = False) -> bytes:
    """One record; its length is set anew. ``compress``: as a gzip member of its own."""
    names = {k: v for k, v in headers.items() if k.lower() != "content-length"} | {"Content-Length": str(len(payload))}
    raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in names.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"
    return gzip.compress(raw, 9) if compress else raw


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain or compressed archives; a task reads a file record by record."""

    def rows(p: str) -> Iterator[tuple]:
        with open_stream(p) as f:
            yield from ((p, i, v, h, body) for i, (v, h, body) in enumerate(records_of(f)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.path:
                yield from batched(rows(p), ["path", "record_no", "version", "headers", "payload"], lambda r: len(r[4]))

    return files_of(spark, path).mapInPandas(run, SCHEMA)


def pipe_warc(records: DataFrame, argv: list[str], jobs: int | None = None) -> DataFrame:
    """Records through an external program that reads an archive and writes one, started once for each task; it may write
    more or fewer records. Their order is not kept. An error if it fails or writes something else."""
    if jobs:
        records = records.repartition(jobs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is None:
            return
        child = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def feed() -> None:
            try:
                for b in itertools.chain([first], batches):
                    for h, p in zip(b.headers, b.payload):
                        child.stdin.write(dump(dict(h), bytes(p)))
            except BrokenPipeError:  # the program ended early; its status tells why
                pass
            finally:
                child.stdin.close()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        out = (("", i, v, h, body) for i, (v, h, body) in enumerate(records_of(child.stdout)))
        yield from batched(out, ["path", "record_no", "version", "headers", "payload"], lambda r: len(r[4]))
        feeder.join()
        if child.wait():
            raise RuntimeError(f"{argv[0]} ended with status {child.returncode}")

    return records.mapInPandas(run, SCHEMA)


def map_records(records: DataFrame, f: Callable[[bytes], bytes], jobs: int | None = None) -> DataFrame:
    """Records with the payload mapped by ``f`` in ``jobs`` parallel tasks; their order is not kept."""
    if jobs:
        records = records.repartition(jobs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(payload=[f(bytes(x)) for x in b.payload])

    return records.mapInPandas(run, records.schema)


def as_bytes(records: DataFrame, compress: bool = False) -> DataFrame:
    """``(path, record_no, record)``: each record as bytes of an archive."""

    @F.pandas_udf("binary")
    def one(headers: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([dump(dict(h), bytes(p), compress) for h, p in zip(headers, payload)])

    return records.select("path", "record_no", one("headers", "payload").alias("record"))
