"""Packing items into containers with several simultaneous limits.

Vector bin packing by the dot-product heuristic: a container is filled with
the item whose demand vector (tokens, segments, loss-bearing tokens) has the
largest dot product with what the container has left, each dimension weighted
by how scarce it is, until nothing fits.  Items are packed where they are
read, from a pool that is refilled as it empties, so there is no exchange and
only the last containers of a partition are filled from a small pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lakeweave.llm.bpe import SharedEncoder

#: Items from which a container's next item is chosen.
POOL = 4096


@dataclass(frozen=True)
class Limits:
    """Capacity of one container, all at once; each is at least 1.

    An item of more than ``tokens`` tokens is split, into pieces within all
    limits.  Any other stays whole: if its loss-bearing tokens alone are more
    than ``loss``, it has a container without any other loss-bearing item.
    """

    tokens: int = 2048
    segments: int = 16
    loss: int = 1536


def pieces(bears: np.ndarray, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, tokens, loss-bearing tokens) of the pieces of an item, given which of its tokens bear loss: one, unless the item alone exceeds the tokens of a container."""
    n = len(bears)
    if n <= limits.tokens:
        return [(0, n, int(bears.sum()))]
    borne = np.concatenate([[0], np.cumsum(bears)])
    out, at = [], 0
    while at < n:
        end = min(n, at + limits.tokens, int(np.searchsorted(borne, borne[at] + limits.loss, "right")) - 1)
        out.append((at, end - at, int(borne[end] - borne[at])))
        at = end
    return out


def loss_bearing(texts: list[str | None], lines: list[list[bool | None] | None] | None, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the tokens ``flat`` of several texts (which begin at ``at``) bear loss.

    ``lines`` tells it for each line of each text; lines that it doesn't tell
    of bear none.  Without it all lines but a text's first do.  A token that
    reaches over a line end is of the line that it begins in.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.flatnonzero(np.frombuffer(b"".join(raw), np.uint8) == 10)
    size = lengths[flat]
    starts = np.cumsum(size) - size
    first = np.cumsum([0, *map(len, raw)])[:-1]
    # one place for every line of every text, in order: a text has one more than line ends
    line = np.searchsorted(ends, starts) + np.repeat(np.arange(len(texts)), np.diff(at))
    begin = np.searchsorted(ends, first) + np.arange(len(texts))
    if lines is None:
        bears = np.ones(len(ends) + len(texts), bool)
        bears[begin] = False
    else:
        bears = np.zeros(len(ends) + len(texts), bool)
        for k, told, end in zip(begin.tolist(), lines, [*begin[1:].tolist(), len(bears)], strict=True):
            if told:
                own = told[: end - k]
                bears[k : k + len(own)] = [x is True for x in own]
    return bears[line]


class Packer:
    """Fills containers from a pool of items."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand = np.zeros((0, 3))
        self.items = np.zeros(0, np.int64)
        self.next = 0

    def add(self, demand: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take items up; yields (items, their containers) as containers are closed."""
        self.demand = np.concatenate([self.demand, demand])
        self.items = np.concatenate([self.items, items])
        if len(self.items) > 2 * self.pool:
            yield self._fill(self.pool)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return self._fill(0)

    def _fill(self, leave: int) -> tuple[np.ndarray, np.ndarray]:
        got, where = [], []
        while len(self.items) > leave:
            # the oldest items first, so that none waits for ever
            part = self.demand[: 2 * self.pool]
            scale = part.mean(axis=0) / self.cap
            weight = scale / max(scale.sum(), 1e-12) / self.cap**2
            open_ = np.ones(len(part), bool)
            n_open, stop = len(part), max(0, len(part) - (len(self.items) - leave))
            while n_open > stop:
                left = self.cap.copy()
                empty = True
                while True:
                    fits = open_ & (part <= left).all(axis=1)
                    score = np.where(fits, part @ (weight * left), -1.0)
                    i = int(score.argmax())
                    if score[i] < 0:
                        break
                    open_[i], n_open, empty = False, n_open - 1, False
                    left -= part[i]
                    got.append(self.items[i])
                    where.append(self.next)
                    if left[1] < 1:
                        break
                assert not empty, "an item larger than a container"
                self.next += 1
            keep = np.ones(len(self.items), bool)
            keep[: len(part)] = open_
            self.demand, self.items = self.demand[keep], self.items[keep]
        return np.array(got, np.int64), np.array(where, np.int64)


def pack_texts(
    df: DataFrame, id_col: str, text_col: str, encoder: SharedEncoder, limits: Limits = Limits(), bears: str | None = None
) -> DataFrame:
    """(id, piece, start, n_tokens, n_loss, container_id): every text's place.

    A text takes one segment.  ``bears`` is a column of booleans that tells of
    each line of the text whether its tokens bear loss (null: it doesn't);
    without it all lines bear loss but the first, which serves as the prompt.
    Texts are whole unless one alone exceeds the tokens of a container; its
    pieces then carry 0, 1, ... and their first token.  A text with more
    loss-bearing tokens than a container takes is the only one of its container
    that bears loss.  Null and empty texts are items without tokens and get a
    place as well.  Rows that occur twice are items twice.  Container ids are
    unique over the whole result.  Of an empty input nothing comes out.
    """
    kind = df.schema[id_col].dataType
    told = [F.col(bears).cast("array<boolean>").alias("bears")] if bears else []
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *told)
    schema = StructType(
        [StructField("id", kind), StructField("piece", IntegerType()), StructField("start", LongType()),
         StructField("n_tokens", LongType()), StructField("n_loss", LongType()), StructField("container_id", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = encoder.get(), TaskContext.get().partitionId() << 36
        packer = Packer(limits)
        waiting, n = {}, 0

        def out(items: np.ndarray, where: np.ndarray) -> pa.RecordBatch:
            got = [waiting.pop(i) for i in items.tolist()]
            cols = list(zip(*got, strict=True)) or [()] * 5
            arrays = [pa.array(c, f) for c, f in zip(cols, arrow_types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(where + base, pa.int64())], names=schema.names)

        arrow_types = None
        for b in batches:
            arrow_types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                flat, at = bpe.encode(texts)
                loss = loss_bearing(texts, part.column(2).to_pylist() if bears else None, flat, at, bpe.lengths)
                demand = []
                for j, i in enumerate(ids):
                    for piece, (start, m, borne) in enumerate(pieces(loss[at[j] : at[j + 1]], limits)):
                        waiting[n + len(demand)] = (i, piece, start, m, borne)
                        demand.append((m, 1, min(borne, limits.loss)))
                items = np.arange(n, n + len(demand))
                n += len(demand)
                for x in packer.add(np.array(demand, float).reshape(-1, 3), items):
                    yield out(*x)
        if waiting:
            yield out(*packer.close())

    return rows.mapInArrow(run, schema)
