"""Delimited text as a grid, split by Spark like any text, with quoted fields that may hold separators and line breaks.

Whether a line begins inside a quoted field depends on all lines before it in its file. Each part of a file that a
task reads is therefore summed up first as a map from the state at its start to the state at its end;
these maps, one row per part, are chained per file, and then every part can be read by itself. Only a record
that crosses the border of two parts is put together from pieces.

Rules are those of the usual CSV reader: a quote opens a quoted field only at the field's start, a doubled one inside
stands for itself, what follows the closing quote up to the separator is kept as it is. A byte order mark goes; each
file is decoded as UTF-8 or, if any of its bytes do not form that, as Latin-1 as a whole.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegrid.runtime import Scratch, small_enough

MARK = b"\xef\xbb\xbf"
PARTS = "file string, block long, lines long, valid boolean, open0 boolean, open1 boolean, last0 long, last1 long"
CHAINED = "file string, block long, first long, latin boolean, open boolean, record long, tail long"
GRID = "file string, row_idx long, piece long, cells array<string>"


def ends_open(line: bytes, inside: bool, separator: bytes) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or at the start of a record."""
    at = 0
    if b'"' not in line:
        return inside
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line.startswith(b'"', at + 1):
                at += 2
                continue
            at = line.find(separator, at + 1)
            if at < 0:
                return False
            at, inside = at + 1, False
        elif line.startswith(b'"', at):
            at, inside = at + 1, True
        else:
            at = line.find(separator + b'"', at)
            if at < 0:
                return False
            at, inside = at + 2, True


def separator_of(file: str, separator: str | None) -> str:
    return separator or ("\t" if file.lower().endswith(".tsv") else ",")


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The lines of each part in their order, as a stream per part."""

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(n).to_pylist() for n in names], batch.column("line").to_pylist(), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[:-1]):
        yield key, (r[-1] or b"" for r in group)


def _sum_up(separator: str | None):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines in _runs(batches, "file", "block"):
            mark = separator_of(file, separator).encode()
            n, valid, state, last = 0, True, [False, True], [-1, -1]
            for line in lines:
                if n == 0 and block == 0:
                    line = line.removeprefix(MARK)
                valid = valid and (line.isascii() or _is_utf8(line))
                for k in (0, 1):
                    if not state[k]:
                        last[k] = n
                    state[k] = ends_open(line, state[k], mark)
                n += 1
            yield pa.RecordBatch.from_pylist(
                [{"file": file, "block": block, "lines": n, "valid": valid, "open0": state[0], "open1": state[1], "last0": last[0], "last1": last[1]}],
                pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("valid", pa.bool_()), ("open0", pa.bool_()), ("open1", pa.bool_()), ("last0", pa.int64()), ("last1", pa.int64())]),
            )

    return parts


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode()
    except UnicodeDecodeError:
        return False
    return True


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """Start state of every part of a file; ``record`` is where the open record began, ``tail`` the first line of the part that its successor goes on with."""
    parts = parts.sort_values("block")
    latin, first, inside, record, out = not parts["valid"].all(), 0, False, -1, []
    for i, p in enumerate(parts.itertuples()):
        after, last = (p.open1, p.last1) if inside else (p.open0, p.last0)
        ends = bool(after) and i < len(parts) - 1
        began = first + last if last >= 0 else record
        out.append((p.file, p.block, first, latin, inside, record, first + last if ends and last >= 0 else first + p.lines if not ends else first))
        first, inside, record = first + p.lines, ends, began if ends else -1
    return pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])


def _parse(lines: Iterator[str], separator: str) -> Iterator[tuple[int, list[str]]]:
    """(number of the first line, cells) of every record."""
    csv.field_size_limit(sys.maxsize)
    reader, at = csv.reader((x + "\n" for x in lines), delimiter=separator), 0
    for cells in reader:
        yield at, cells
        at = reader.line_num


def _read_parts(separator: str | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (file, block, first, latin, inside, record, tail), lines in _runs(batches, "file", "block", "first", "latin", "open", "record", "tail"):
            mark, at = separator_of(file, separator), first

            def text(line, file=file, latin=latin):
                return line.decode("latin-1" if latin else "utf-8")

            def own(lines=lines, tail=tail, text=text):
                """Lines up to the tail; what an earlier part began and what a later one ends become pieces."""
                nonlocal at, inside
                for line in lines:
                    if at == 0:
                        line = line.removeprefix(MARK)
                    if inside:
                        out.append((file, record, at, [text(line)]))  # noqa: B023
                        inside = ends_open(line, True, mark.encode())  # noqa: B023
                        at += 1
                        starts[0] = at  # noqa: B023
                    elif at >= tail:
                        out.append((file, tail, at, [text(line)]))  # noqa: B023
                        at += 1
                    else:
                        at += 1
                        yield text(line)

            starts = [first]
            for number, cells in _parse(own(), mark):
                out.append((file, starts[0] + number, None, cells))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "row_idx", "piece", "cells"])


def _join_pieces(separator: str | None):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        lines = [x[0] for x in rows["cells"]]
        found = list(_parse(iter(lines), separator_of(rows["file"].iloc[0], separator)))
        first = int(rows["row_idx"].iloc[0])
        return pd.DataFrame({"file": rows["file"].iloc[0], "row_idx": [first + n for n, _ in found], "piece": None, "cells": [c for _, c in found]})

    return join


def read_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, row_idx, cells) of all records, blank ones too; ``row_idx`` is the number of a record's first line.

    Without a ``separator`` files named ``.tsv`` are cut at tabs and others at commas. A record's lines are held in one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    parts = lines.mapInArrow(_sum_up(separator), PARTS)
    chained = Scratch(spark).save(parts.groupBy("file").applyInPandas(_chain, CHAINED), "parts")
    crossing = chained.where("open").limit(1).count()
    if small_enough(chained, F.octet_length("file") + 64):
        rows = lines.join(F.broadcast(chained), ["file", "block"])
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        rows = numbered.join(chained, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at")
    read = rows.select("file", "block", "first", "latin", "open", "record", "tail", "line").mapInArrow(_read_parts(separator), GRID)
    whole = read.where("piece IS NULL")
    if crossing:
        pieces = read.where("piece IS NOT NULL").groupBy("file", F.col("row_idx").alias("record"))
        whole = whole.unionByName(pieces.applyInPandas(_join_pieces(separator), GRID))
    return whole.select("file", "row_idx", "cells")
