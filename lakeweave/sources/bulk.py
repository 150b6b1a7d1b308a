"""Reading many files in one job.

Each file is read by one task as bytes and taken apart there, so a lake of a
million small files is one plan and not one per file.  A file that can't be
read, or has no rows, is noted as such and doesn't touch the others.  Files too
large for one task are read by the readers in ``readers.py`` instead.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from lakeweave.sources.readers import few_listing_tasks, literal

#: header and rows of cells as text; None is a missing value.
Parsed = tuple[list[str], list[list[str | None]]]
#: Files that one scan lists and reads.
FILES_PER_SCAN = 50_000
SCHEMA = "path string, status string, rowid long, cells array<string>"


def decoded(raw: bytes) -> str:
    """Text of a whole file: UTF-8 if all of it is, else Latin-1; without a byte order mark."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def text_of(value: object) -> str | None:
    """A value as text; None if it is missing."""
    if value is None or isinstance(value, float) and value != value:
        return None
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def delimited(text: str, sep: str | None = None) -> Parsed:
    """A delimited file with a header; the delimiter is told from its first line.  ValueError if a row has more fields than the header."""
    if sep is None:
        sep = csv.Sniffer().sniff(text.split("\n", 1)[0], delimiters=",;\t|:").delimiter
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True) if r]
    if not rows:
        raise ValueError("no header")
    header = [c.strip() for c in rows[0]]
    if any(len(r) > len(header) for r in rows):
        raise ValueError("a row has more fields than the header")
    return header, [[*(c if c != "" else None for c in r), *([None] * (len(header) - len(r)))] for r in rows[1:]]


def from_csv(raw: bytes) -> Parsed:
    return delimited(decoded(raw))


def from_tsv(raw: bytes) -> Parsed:
    """Tab-separated; types are inferred, so numbers come in their usual form."""
    header, rows = delimited(decoded(raw), "\t")
    return header, inferred(rows, len(header))


def inferred(rows: list[list[str | None]], width: int) -> list[list[str | None]]:
    """Rows with columns of numbers only in the form that numbers have."""
    columns = []
    for i in range(width):
        column = pd.Series([r[i] for r in rows], dtype=object)
        number = pd.to_numeric(column, errors="coerce")
        if len(column) and not (number.isna() & column.notna()).any() and number.notna().any():
            whole = (number.dropna() % 1 == 0).all() and not column.dropna().astype(str).str.contains(r"[.eE]").any()
            columns.append([None if x != x else str(int(x)) if whole else str(float(x)) for x in number])
        else:
            columns.append(list(column))
    return [list(r) for r in zip(*columns, strict=True)]


def from_json(raw: bytes) -> Parsed:
    """JSON lines, an array of records, or one object of columns (arrays of equal length, or row label -> value)."""
    text = decoded(raw)
    try:
        found = json.loads(text)
    except ValueError:
        found = [json.loads(line) for line in text.split("\n") if line.strip()]
    if isinstance(found, dict):
        values = list(found.values())
        if values and all(isinstance(v, list) for v in values):
            if len({len(v) for v in values}) > 1:
                raise ValueError("columns of different lengths")
            return list(found), [[text_of(v) for v in r] for r in zip(*values, strict=True)]
        if values and all(isinstance(v, dict) for v in values):
            labels = list(dict.fromkeys(k for v in values for k in v))
            return list(found), [[text_of(v.get(k)) for v in values] for k in labels]
        found = [found]
    if not all(isinstance(r, dict) for r in found):
        raise ValueError("no records")
    header = list(dict.fromkeys(k for r in found for k in r))
    return header, [[text_of(r.get(k)) for k in header] for r in found]


def from_parquet(raw: bytes) -> Parsed:
    table = pq.read_table(io.BytesIO(raw))
    columns = [[text_of(v) for v in c.to_pylist()] for c in table.columns]
    return table.column_names, [list(r) for r in zip(*columns, strict=True)] if columns else []


_ATTRIBUTE = re.compile(r"^\s*@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+?)\s*$", re.I)


def from_arff(raw: bytes) -> Parsed:
    """ARFF: names of the attributes, and all rows after @data but comments and blank lines; ? is missing."""
    header, rows, data = [], [], False
    for line in decoded(raw).splitlines():
        bare = line.strip()
        if not data:
            m = _ATTRIBUTE.match(line)
            if m:
                header.append((m[1].strip("'\""), m[2].lower().split()[0] in ("numeric", "real", "integer")))
            data = bare.lower().startswith("@data")
        elif bare and not bare.startswith("%"):
            quote = "'" if "'" in bare and '"' not in bare else '"'
            row = next(csv.reader([bare], quotechar=quote, skipinitialspace=True))
            if len(row) != len(header):
                raise ValueError("a row has another number of values than there are attributes")
            rows.append([None if c.strip() == "?" else str(float(c)) if number else c.strip() for c, (_, number) in zip(row, header, strict=True)])
    if not data:
        raise ValueError("no @data")
    return [n for n, _ in header], rows


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"csv": from_csv, "tsv": from_tsv, "json": from_json, "parquet": from_parquet, "arff": from_arff}


def parse(path: str, raw: bytes) -> tuple[str, Parsed]:
    """(status, header and rows): "read", "data error" (unreadable, or no rows) or "file error" (no known kind of file)."""
    parser = PARSERS.get(path.rsplit(".", 1)[-1].lower())
    if parser is None:
        return "file error", ([], [])
    try:
        header, rows = parser(bytes(raw))
    except Exception:
        return "data error", ([], [])
    return ("read", (header, rows)) if header and rows else ("data error", ([], []))


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, status, rowid, cells): of every file one row without row id that has its status and header, and its rows in order.

    ``paths`` must be files, each of which fits in one task; they are listed
    and read by the cluster, ``FILES_PER_SCAN`` by one scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                status, (header, rows) = parse(path, raw.as_py())
                names = ["path", "status", "rowid", "cells"]
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([status]), pa.array([None], pa.int64()), pa.array([header], kind)], names=names)
                for k in range(0, len(rows), 20_000):
                    some = rows[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(some)), pa.nulls(len(some), pa.string()), pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, kind)], names=names
                    )

    if not paths:
        return spark.createDataFrame([], SCHEMA)
    found = None
    with few_listing_tasks(spark):
        for k in range(0, len(paths), FILES_PER_SCAN):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([literal(p) for p in paths[k : k + FILES_PER_SCAN]])
            one = files.select("path", "content").mapInArrow(run, SCHEMA)
            found = one if found is None else found.unionByName(one)
    return found
