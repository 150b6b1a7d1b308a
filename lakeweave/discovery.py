"""Search, correlation, enrichment and evaluation of one input dataset over a lake, as one object."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import correlate, duplicates, enrich, evaluate, joinsearch
from lakeweave.plans.scratch import written
from lakeweave.sources.readers import read_dataset


@dataclass
class Discovery:
    """A dataset with its query columns and target, and the lake's relations.

    ``cells``, ``rows`` and ``headers`` as an index has them.  ``order`` is a
    total order of the dataset's rows.  ValueError if a column is missing.
    """

    data: DataFrame
    query: Sequence[str]
    target: str
    order: Sequence[str]
    cells: DataFrame
    rows: DataFrame
    headers: DataFrame
    found: joinsearch.JoinSearch | None = field(default=None)

    def __post_init__(self):
        missing = [c for c in [*self.query, self.target, *self.order] if c not in self.data.columns]
        if missing or not self.query:
            raise ValueError(f"no query column or no column {', '.join(missing)} in {', '.join(self.data.columns)}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, sep: str, query: Sequence[str], target: str, order: Sequence[str], lake) -> Discovery:
        """From a delimited file; ``lake`` has ``cells``, ``rows`` and ``headers``."""
        data = read_dataset(spark, path, sep, [*query, target, *order])
        return cls(data, query, target, order, lake.cells, lake.rows, lake.headers)

    def lowered(self) -> DataFrame:
        """The dataset as lower-case text."""
        return self.data.select(*(F.lower(F.col(f"`{c}`").cast("string")).alias(c) for c in self.data.columns))

    def joinable(self, k: int = 20, k_c: int = 500, min_join_ratio: int = 0, **options) -> DataFrame:
        """(rank, score, score_ref, tableid, cols, headers): the tables that join best; kept for what follows."""
        prepared = joinsearch.prepare(self.data, self.query, self.order)
        found = joinsearch.join_search(self.cells, prepared, k, k_c, min_join_ratio, rows=self.rows, **options)
        self.found = joinsearch.JoinSearch(found.tables, written(found.pairs, "pairs"), found.stats)
        return enrich.header_of(self.found.tables, self.headers)

    def _joined(self) -> joinsearch.JoinSearch:
        if self.found is None:
            raise ValueError("search for joinable tables first")
        return self.found

    def keep(self, ranks: int) -> None:
        """Go on with the first tables of the search only."""
        found = self._joined()
        tables = enrich.keep_ranks(found.tables, ranks)
        self.found = joinsearch.JoinSearch(tables, found.pairs.join(tables.select("tableid"), "tableid", "left_semi"), found.stats)

    def without_duplicates(self) -> DataFrame:
        """(tableid_1, tableid_2, n_pairs) of the found tables that hold the same rows; of each pair the larger id is left out from now on."""
        found = self._joined()
        ids = found.tables.select("tableid")
        relations = written(duplicates.duplicate_relations(self.cells.join(ids, "tableid", "left_semi"), self.rows.join(ids, "tableid", "left_semi")), "relations")
        tables = duplicates.remove_duplicates(found.tables, relations)
        self.found = joinsearch.JoinSearch(tables, found.pairs.join(tables.select("tableid"), "tableid", "left_semi"), found.stats)
        return relations

    def correlated(self, k_c: int = 10) -> DataFrame:
        """(rank, corr, table_col_id, is_numeric, header): the columns of the found tables that tell most of the target."""
        targets = correlate.target_ranks(joinsearch.numbered(self.data, self.order), self.target)
        top = correlate.enrich_multicolumn(self.cells, self._joined().pairs, targets, k_c)
        ids = F.split("table_col_id", "_")
        at = top.withColumn("tableid", ids[0].cast("int")).withColumn("colid", ids[1].cast("int"))
        return at.join(self.headers.select("tableid", "colid", "header"), ["tableid", "colid"], "left").select("rank", "corr", "table_col_id", "is_numeric", "header")

    def enriched(self, tableid: int, cols: Sequence[int], features: Sequence[int]) -> DataFrame:
        """The dataset with columns of a table attached by its query columns; numbers as numbers."""
        out = enrich.add_features(self.data, self.query, self.cells, self.headers, tableid, cols, features)
        for c in out.columns[len(self.data.columns) :]:
            number = F.col(f"`{c}`").cast("double")
            if out.where(F.col(f"`{c}`").isNotNull() & number.isNull()).isEmpty():
                out = out.withColumn(c, number)
        return out

    def evaluated(self, enriched: DataFrame, base: Sequence[str], seed: int = 42) -> tuple[float, float, float]:
        """(error with the dataset's own features, with the attached ones as well, reduction in per cent)."""
        named = enriched.toDF(*(c.replace(":", "_").replace(".", "_") for c in enriched.columns))
        added = named.columns[len(self.data.columns) :]
        return evaluate.compare(named, base, added, self.target, seed)
