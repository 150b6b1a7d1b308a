"""How often every n-gram occurs, and in how many records, by one sorted suffix array.

The suffixes of all token sequences, cut after ``max_n`` tokens, are
range-partitioned and sorted once, with their record and position as
tie-breaks.  The length of the common prefix of neighbours tells the intervals
of every n at the same time: suffixes that share their first ``n`` tokens stand
together, and a neighbour with a shorter common prefix begins the next
interval.  An interval's length is the number of occurrences of its n-gram.
Its number of records is that length less the suffixes that share the interval
with an earlier one of their record.  A position that occurs twice is an
adjacent equal entry and counts once.

Intervals inside a partition are complete as they stand.  Those at its ends may
go on in other partitions: of them each partition reports the length of its
part and the distinct records in it, and the parts are put together
afterwards.  A part that holds many records is reported piece by piece, so no
task keeps more than ``HELD`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lakeweave.plans.scratch import written

#: Records of an open interval that are kept before they are handed on.
HELD = 500_000


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before; nulls equal nulls."""
    n = len(column)
    a, b = column.slice(1, n - 1), column.slice(0, n - 1)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        out |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return out


def common_prefixes(tokens: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix of each suffix with the one before, length of each suffix) of sorted suffixes given as token columns.

    A suffix's tokens are those before its first null; the first suffix has nothing before it.
    """
    m = len(tokens[0])
    common, length = np.zeros(m, np.int32), np.zeros(m, np.int32)
    same, there = np.ones(max(m - 1, 0), bool), np.ones(m, bool)
    for c in tokens:
        there &= c.is_valid().to_numpy(zero_copy_only=False)
        length += there
        same &= there[1:] & ~_differs(c)
        common[1:] += same
    return common, length


class _Level:
    """The interval of one n that hasn't ended yet: its part in this partition."""

    def __init__(self, n: int):
        self.n = n
        self.term: list[str] | None = None
        self.occ = 0
        self.recs: list[pa.Array] = []
        self.held = 0
        self.edge = True  # the part begins with the partition, or was handed on in pieces


class _Intervals:
    """Common-prefix intervals of one sorted partition, batch by batch, for all n at once."""

    def __init__(self, n_tokens: int, kinds: pa.Schema, held: int):
        self.k, self.kinds, self.most = n_tokens, kinds, held
        self.levels = [_Level(n) for n in range(1, n_tokens + 1)]
        self.last: list[pa.Array] | None = None

    def batch(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        carried = self.last is not None
        cols = [pa.concat_arrays([l, c]) if carried else c for l, c in zip(self.last if carried else b.columns, b.columns, strict=True)]
        m = len(cols[0])
        common, length = common_prefixes(cols[: self.k])
        new = np.zeros(m, bool)
        new[0] = not carried
        for c in cols:
            new[1:] |= _differs(c)  # the same position again isn't another suffix
        record = cols[self.k].dictionary_encode()
        of = np.asarray(record.indices.fill_null(len(record.dictionary)))
        for level in self.levels:
            at = np.flatnonzero(new & (length >= level.n))
            if len(at):
                yield from self._count(level, at, common, of, cols)
        self.last = [c.slice(m - 1, 1) for c in cols]

    def _count(self, level: _Level, at: np.ndarray, common: np.ndarray, of: np.ndarray, cols: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        begins = common[at] < level.n
        first = 0
        if level.term is None:
            begins[0] = True
        starts = np.flatnonzero(begins)
        if not len(starts) or starts[0] > 0:  # the open interval goes on
            first = int(starts[0]) if len(starts) else len(at)
            yield from self._hold(level, at[:first], of, cols)
        if not len(starts):
            return
        yield from self._close(level)
        own = at[first:]
        interval = np.cumsum(begins[first:]) - 1
        occ = np.bincount(interval)
        # suffixes beyond the first of their record in the interval are taken off
        pair = np.unique(interval.astype(np.int64) * (int(of.max()) + 1) + of[own])
        recs = np.bincount(pair // (int(of.max()) + 1), minlength=len(occ))
        whole = len(occ) - 1
        heads = own[np.searchsorted(interval, np.arange(len(occ)))]
        if whole:
            # an interval that begins the partition may have begun before it
            begin = 1 if level.edge else 0
            if begin:
                level.term, level.occ = self._term(cols, heads[0], level.n), 0
                yield from self._hold(level, own[interval == 0], of, cols)
                yield from self._close(level)
            if whole > begin:
                yield self._out(level.n, cols, heads[begin:whole], occ[begin:whole], recs[begin:whole])
            level.edge = False
        level.term, level.occ, level.recs, level.held = self._term(cols, heads[-1], level.n), 0, [], 0
        yield from self._hold(level, own[interval == whole], of, cols)

    def _hold(self, level: _Level, at: np.ndarray, of: np.ndarray, cols: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        """Take suffixes into the open interval."""
        if not len(at):
            return
        level.occ += len(at)
        once = at[np.unique(of[at], return_index=True)[1]]
        level.recs.append(cols[self.k].take(pa.array(once)))
        level.held += len(once)
        if level.held > self.most:
            recs = pc.unique(pa.concat_arrays(level.recs))
            level.recs, level.held = [recs], len(recs)
            if level.held > self.most // 2:
                yield self._part(level)
                level.occ, level.recs, level.held, level.edge = 0, [], 0, True

    def _close(self, level: _Level) -> Iterator[pa.RecordBatch]:
        """The open interval ends here."""
        if level.term is not None:
            if level.edge:
                if level.occ:
                    yield self._part(level)
            else:
                recs = pc.unique(pa.concat_arrays(level.recs))
                yield self._rows([level.term], [level.n], [level.occ], [len(recs)], None)
            level.edge = False
        level.term, level.occ, level.recs, level.held = None, 0, [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The intervals at the partition's end, which may go on in the next one."""
        for level in self.levels:
            if level.term is not None and level.occ:
                yield self._part(level)

    def _term(self, cols: list[pa.Array], row: int, n: int) -> list[str]:
        return [c[int(row)].as_py() for c in cols[:n]]

    def _part(self, level: _Level) -> pa.RecordBatch:
        return self._rows([level.term], [level.n], [level.occ], [None], pc.unique(pa.concat_arrays(level.recs)))

    def _out(self, n: int, cols: list[pa.Array], heads: np.ndarray, occ: np.ndarray, recs: np.ndarray) -> pa.RecordBatch:
        m, take = len(heads), pa.array(heads)
        flat = pa.concat_arrays([c.take(take).cast(pa.string()) for c in cols[:n]]).take(pa.array(np.arange(n * m).reshape(n, m).T.ravel()))
        terms = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), flat)
        return self._rows(terms, np.full(m, n), occ, recs, None)

    def _rows(self, term, n, occ, recs, parts: pa.Array | None) -> pa.RecordBatch:
        """``parts``: the records of the one part that is reported, if any."""
        m = len(n)
        kind = self.kinds.field("parts").type
        listed = pa.nulls(m, kind) if parts is None else pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(n, pa.int32()), pa.array(term, pa.list_(pa.string())) if isinstance(term, list) else term, pa.array(occ, pa.int64()), pa.array(recs, pa.int64()), listed],
            names=["n", "term", "occ", "recs", "parts"],
        )


def interval_counts(suffixes: DataFrame, tokens: Sequence[str], record: str, position: Sequence[str], held: int = HELD) -> DataFrame:
    """(n, term, n_occurrences, n_records) of suffixes given as token columns, a record and a position in it.

    A suffix ends at its first null token; one without tokens counts nowhere.
    A null record is a record.  The suffixes are sorted once for all n.
    """
    names = [*(f"t{i}" for i in range(len(tokens))), "rec", *(f"p{i}" for i in range(len(position)))]
    rows = suffixes.select(
        *(F.col(c).cast("string").alias(n) for c, n in zip(tokens, names, strict=False)),
        *(F.col(c).alias(n) for c, n in zip([record, *position], names[len(tokens) :], strict=True)),
    )
    array = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    k = len(tokens)
    schema = StructType(
        [StructField("n", IntegerType()), StructField("term", ArrayType(StringType())), StructField("occ", LongType()),
         StructField("recs", LongType()), StructField("parts", ArrayType(rows.schema["rec"].dataType))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if not b.num_rows:
                continue
            if state is None:
                state = _Intervals(k, pa.schema([("parts", pa.list_(b.schema.field(k).type))]), held)
            yield from state.batch(b)
        if state is not None:
            yield from state.finish()

    found = written(array.mapInArrow(run, schema), "intervals")
    whole = found.where("parts IS NULL").select("n", "term", F.col("occ").alias("n_occurrences"), F.col("recs").alias("n_records"))
    # the parts of one interval: their records may be the same
    split = found.where("parts IS NOT NULL").select("n", "term", "occ", F.posexplode("parts").alias("i", "rec"))
    by_record = split.groupBy("n", "term", "rec").agg(F.sum(F.when(F.col("i") == 0, F.col("occ")).otherwise(0)).alias("occ"))
    put = by_record.groupBy("n", "term").agg(F.sum("occ").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    return whole.unionByName(put)


def ngram_counts(
    df: DataFrame, tokens: str, record: str, sequence: Sequence[str], max_n: int, held: int = HELD
) -> DataFrame:
    """(n, term, n_occurrences, n_records) of all n-grams up to ``max_n`` of an array column.

    ``sequence`` identifies a token sequence within its record; a sequence that
    occurs twice counts once.  Null and empty tokens end an n-gram: none
    reaches over them.  Null or empty arrays hold nothing.  ``max_n`` bounds
    the length of a suffix in the array, so that a sequence of any length takes
    ``max_n`` times its tokens and not their square.
    """
    # every position with the tokens that follow it, at most max_n
    starts = F.transform(F.sequence(F.lit(1), F.size("__a")), lambda i: F.slice("__a", i, max_n))
    base = df.select(
        F.col(record).alias("__r"), *(F.col(c).alias(f"__s{i}") for i, c in enumerate(sequence)), F.col(tokens).alias("__a"),
    ).where(F.size("__a") > 0)
    suffixes = base.select("__r", *(f"__s{i}" for i in range(len(sequence))), F.posexplode(starts).alias("__p", "__x")).where(F.col("__x")[0] != "")
    cols = []
    for j in range(max_n):
        c = F.try_element_at("__x", F.lit(j + 1))
        suffixes = suffixes.withColumn(f"__t{j}", F.when(c != "", c) if j == 0 else F.when(F.col(f"__t{j - 1}").isNotNull() & (c != ""), c))
        cols.append(f"__t{j}")
    return interval_counts(suffixes, cols, "__r", [*(f"__s{i}" for i in range(len(sequence))), "__p"], held)
