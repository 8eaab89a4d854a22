"""Lines through an external program that writes one line for each line it reads."""

from __future__ import annotations

import itertools
import subprocess
import threading
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def _fed(child: subprocess.Popen, batches: Iterator[pd.DataFrame], line: str, waiting: deque, failed: list) -> None:
    """Write the lines of all batches to the program; ``waiting`` gets each batch with its number of lines before they go."""
    try:
        for b in batches:
            lines = b.loc[b[line].notna(), line].tolist()
            waiting.append((b, len(lines)))
            child.stdin.write("".join(x + "\n" for x in lines).encode())
    except BrokenPipeError:  # the program ended early; its status or its lines tell
        pass
    except BaseException as e:  # noqa: BLE001 - goes on in the reading thread
        failed.append(e)
    finally:
        waiting.append(None)
        try:
            child.stdin.close()
        except BrokenPipeError:
            pass


def pipe_lines(df: DataFrame, argv: list[str], line: str = "line", out: str = "line") -> DataFrame:
    """``df`` with ``out`` from the program, which is started once for each task and reads and writes at the same time.

    Null lines stay null and are not sent. An error if the program fails or writes more or fewer lines. A carriage return
    at a line's end is lost. A line must hold no line feed.
    """
    schema = df.schema if out == line else StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is None:
            return
        child = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        waiting: deque = deque()
        failed: list = []
        feeder = threading.Thread(target=_fed, args=(child, itertools.chain([first], batches), line, waiting, failed), daemon=True)
        feeder.start()
        total = 0
        while True:
            while not waiting:
                feeder.join(0.001)
            item = waiting.popleft()
            if item is None:
                break
            b, n = item
            raw = list(itertools.islice(child.stdout, n))
            total += len(raw)
            if len(raw) < n:
                child.wait()
                _check(argv, child, f"{total} lines, too few")
            got = pd.Series([None] * len(b), index=b.index, dtype=object)
            got[b[line].notna()] = [x.decode().removesuffix("\n").removesuffix("\r") for x in raw]
            yield b.assign(**{out: got})
        feeder.join()
        if failed:
            raise failed[0]
        more = child.stdout.readline()
        child.stdout.close()
        child.wait()
        _check(argv, child, f"{total} lines and more" if more else "")

    return df.mapInPandas(run, schema)


def _check(argv: list[str], child: subprocess.Popen, wrote: str) -> None:
    if child.returncode and not wrote.endswith("more"):
        raise RuntimeError(f"{argv[0]} ended with status {child.returncode if child.returncode > 0 else 256}")
    if wrote:
        raise RuntimeError(f"{argv[0]} wrote {wrote}")
