"""Reading the files of a lake."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's start that are read to tell the delimiter from its first line, and first to find an ARFF header's end.
SNIFF_BYTES = 65536


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """Files of a folder, sorted by path.  ``recursive``: those of all folders below it, without its own."""
    return sorted(listed(spark, path, recursive))


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Many paths are listed by a few tasks for each core, not by one task for each path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(int(usual), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def literal(path: str) -> str:
    """A path of which no sign is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def listed(spark: SparkSession, path: str, recursive: bool = False) -> dict[str, int]:
    """File -> its bytes, as for :func:`list_files`.  Files whose name begins with _ or . are hidden.

    A tree of folders is listed by the cluster.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if recursive:
        base = fs.makeQualified(root).toString().rstrip("/")
        with few_listing_tasks(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal(path)).select("path", "length").toArrow()
        found = dict(zip(files.column("path").to_pylist(), files.column("length").to_pylist(), strict=True))
        return {p: n for p, n in found.items() if "/" in p[len(base) + 1 :]}
    statuses = [s for s in fs.listStatus(root) if s.isFile()]
    return {s.getPath().toString(): s.getLen() for s in statuses if s.getPath().getName()[:1] not in ("_", ".")}


def _head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def sniff(head: bytes) -> str:
    """The delimiter of a delimited file; ValueError if its first line has none."""
    text = head.decode("utf-8", "replace")
    line = text.splitlines()[0] if text.strip() else ""
    try:
        return csv.Sniffer().sniff(line, delimiters=",;\t|:").delimiter
    except csv.Error as e:
        raise ValueError(f"no delimiter in {line[:80]!r}") from e


def text_options(spark: SparkSession, path: str) -> dict[str, object]:
    """Encoding, and whether quotes span lines, told from the whole file in one pass of the cluster.

    A file is Latin-1 if any of its lines isn't UTF-8.  Only where a line has
    an odd number of quotes records may go over lines; any other file is read
    in splits.
    """
    lines = spark.read.text(path)
    r = lines.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("other"), F.count_if(F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1).alias("odd")
    ).first()
    return {"encoding": "ISO-8859-1" if r.other else "UTF-8", "multiLine": bool(r.odd)}


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited file with a header, all columns strings; the delimiter is told from its first line, the encoding from all of it."""
    options = text_options(spark, path)
    found = sep or sniff(_head(spark, path))
    return spark.read.csv(path, header=True, sep=found, inferSchema=False, escape='"', mode="FAILFAST", **options)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file with a header; types inferred."""
    return spark.read.csv(path, header=True, sep="\t", inferSchema=True, escape='"', **text_options(spark, path))


def _several_values(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds more than one value, as JSON lines do; an error if its first value isn't JSON.

    Values are skipped by the driver's JVM: of lines the first one, of a document all, which one task reads anyhow.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        parser = jvm.com.fasterxml.jackson.core.JsonFactory().createParser(stream)
        for also in ("ALLOW_SINGLE_QUOTES", "ALLOW_NON_NUMERIC_NUMBERS"):  # as Spark's reader does
            parser.enable(getattr(jvm.com.fasterxml.jackson.core.JsonParser.Feature, also))
        parser.nextToken()
        parser.skipChildren()
        return parser.nextToken() is not None
    finally:
        stream.close()


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one record per line; ValueError if a line isn't exactly one value, of which Spark would read the first only."""

    @F.pandas_udf("boolean")
    def one_value(lines: pd.Series) -> pd.Series:
        def good(line: str) -> bool:
            try:
                json.loads(line)
            except ValueError:
                return False
            return True

        return lines.map(good).astype(bool)

    lines = spark.read.text(path).where(F.trim("value") != "")
    if not lines.where(~one_value("value")).isEmpty():
        raise ValueError(f"not one JSON value per line: {path}")
    return spark.read.json(path, mode="FAILFAST")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or a document: an array of records, or one object of columns (arrays of equal length, or row label -> value)."""
    if _several_values(spark, path):
        return read_json_lines(spark, path)
    df = spark.read.json(path, multiLine=True)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    if kinds and all(k == "array" for k in kinds.values()) and df.count() == 1:
        cols = df.columns
        zipped = F.arrays_zip(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
        one = df.select(F.inline(zipped))
        return one.toDF(*cols)
    if kinds and all(k == "struct" for k in kinds.values()) and df.count() == 1:
        labels = df.schema.fields[0].dataType.names
        rows = [F.struct(*(F.col(f"`{c}`.`{r}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns))) for r in sorted(labels, key=lambda x: (not x.isdigit(), int(x) if x.isdigit() else 0, x))]
        return df.select(F.inline(F.array(*rows))).toDF(*df.columns)
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_ATTRIBUTE = re.compile(r"^\s*@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+?)\s*$", re.I)


def _arff_header(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(lines up to @data, bytes of the file's start that hold them); ValueError if there is no @data."""
    size = SNIFF_BYTES
    while True:
        head = _head(spark, path, size)
        whole = len(head) < size
        lines = head.splitlines() if whole else head.splitlines()[:-1]  # the last one may be cut
        for i, line in enumerate(lines):
            if line.strip().lower().startswith(b"@data"):
                return [x.decode("utf-8", "replace") for x in lines[: i + 1]], size
        if whole:
            raise ValueError(f"no @data in {path}")
        size *= 2


def _after(spark: SparkSession, path: str, count: int, size: int) -> DataFrame:
    """(value): the lines of a file after its first ``count``, which begin in its first ``size`` bytes.

    Lines are numbered within the file's blocks as they are read; only of the
    blocks that may hold the first lines the starts and lengths are collected.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    kept = F.lit(True)
    blocks = lines.groupBy("block").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("block") < size).collect()
    for b in sorted(blocks):
        kept = kept & ((F.col("block") != b.block) | (F.col("at") >= b.start + min(count, b.n)))
        count -= min(count, b.n)
    return lines.where(kept).select("value")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF file: numeric attributes as doubles, all others as strings; ? is null.

    The header is read on the driver, whatever its length; the data rows are
    parsed by the cluster.  Comments and blank lines are no rows.
    """
    header, size = _arff_header(spark, path)
    names, kinds = [], []
    for line in header:
        m = _ATTRIBUTE.match(line)
        if m:
            names.append(m[1].strip("'\""))
            kinds.append("double" if m[2].lower().split()[0] in ("numeric", "real", "integer") else "string")
    lines = _after(spark, path, len(header), size).where((F.trim("value") != "") & ~F.trim("value").startswith("%"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    quote = F.when(F.col("value").contains("'") & ~F.col("value").contains('"'), F.translate("value", "'", '"')).otherwise(F.col("value"))
    parsed = lines.select(F.from_csv(quote, schema, {"sep": ",", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    def value(i: int):
        v = F.when(F.col(f"r.c{i}") != "?", F.col(f"r.c{i}"))
        return v.cast("double") if kinds[i] == "double" else v

    return parsed.select(*(value(i).alias(n) for i, n in enumerate(names)))


#: Reader by file extension.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet, "arff": read_arff,
}


@dataclass
class IndexReport:
    """What became of the files of a lake."""

    inserted: list[str] = field(default_factory=list)
    file_errors: list[str] = field(default_factory=list)
    data_errors: list[str] = field(default_factory=list)


def read_any(spark: SparkSession, path: str, report: IndexReport) -> DataFrame | None:
    """A file by its extension; None, and a note in the report, if it can't be read or has no rows."""
    reader = READERS.get(path.rsplit(".", 1)[-1].lower())
    if reader is None:
        report.file_errors.append(path)
        return None
    try:
        df = reader(spark, path)
        if df.isEmpty():
            report.data_errors.append(path)
            return None
    except Exception:
        report.data_errors.append(path)
        return None
    return df


def read_dataset(spark: SparkSession, path: str, sep: str, columns: Sequence[str] = ()) -> DataFrame:
    """An input dataset; types inferred, header names stripped.  ValueError if it lacks one of ``columns``."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=True, escape='"', **text_options(spark, path))
    df = df.toDF(*(c.strip() for c in df.columns))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
