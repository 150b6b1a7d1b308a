"""Byte-level BPE encoding of a text column, vectorised over padded matrices.

Texts are cut where white space follows something else; no token of the
vocabulary reaches over such a place.  Each distinct chunk is split by the
tokenizer's pattern and its pieces are merged once per worker: pieces of
similar length form a padded matrix in which every row merges its leftmost pair
of minimum rank each round, pairs are looked up in an open-addressing hash
table, and rows are compacted by one column a round.  Rows of more than 32
bytes take several of the rounds that merge one and the same pair at once
where that gives the same, which long runs of one letter would need
thousands of rounds for.  Chunks seen before are
gathered from a flat array of ids.

Null and empty texts get the empty list.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: The pattern that goes with the rank files (fixed by the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's \s has it.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_NONE = np.int32(2**31 - 1)
#: Rows wider than this merge all occurrences of their minimum pair in a round.
_WIDE = 32
#: Characters of cached chunks at which a worker starts over, and of text taken up at a time.
_CACHE_CHARS, _SLICE_CHARS = 24_000_000, 2_000_000


class PairTable:
    """Pair of ids -> id of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, ~np.uint64(0), np.uint64)
        self.vals = np.full(1 << self.bits, _NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == ~np.uint64(0)
            cand = todo[free]
            self.keys[at[cand]] = keys[cand]  # of those that want one slot, the last one written has it
            won = cand[self.keys[at[cand]] == keys[cand]]
            self.vals[at[won]] = merged[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where the pair doesn't merge or a side is padding (negative)."""
        shape = left.shape
        l, r = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(len(l), _NONE, np.int32)
        todo = np.flatnonzero((l >= 0) & (r >= 0))
        keys = (l[todo].astype(np.uint64) << np.uint64(20)) | r[todo].astype(np.uint64)
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.vals[at[hit]]
            on = ~hit & (there != ~np.uint64(0))
            todo, keys, at = todo[on], keys[on], (at[on] + np.uint64(1)) & self.mask
        return out.reshape(shape)


class ByteBPE:
    """Encoder of one rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [
            (ranks[t[:i]], ranks[t[i:]], n)
            for t, n in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # bytes of each token
        for t, n in ranks.items():
            self.lengths[n] = len(t)
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*triples, strict=True)))
        self.split = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.arena, self.cached = np.zeros(0, np.int32), 0

    # -- merging ---------------------------------------------------------
    def merge_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces of similar length are merged together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lens = np.array([len(p) for p in pieces], np.int64)
        todo = np.flatnonzero(lens > 0)
        buckets = np.ceil(np.log2(lens[todo]) * 2).astype(int)
        for b in np.unique(buckets):
            rows = todo[buckets == b]
            width = int(lens[rows].max())
            per = max(1, 2_000_000 // width)
            for k in range(0, len(rows), per):
                some = rows[k : k + per]
                flat = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
                n = lens[some]
                m = np.full((len(some), width), -1, np.int32)
                m[np.arange(width)[None, :] < n[:, None]] = self.byte_ids[flat]
                for i, ids in zip(some, self._merge(m), strict=True):
                    out[i] = ids
        return out

    def _merge(self, m: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [m[0, :0]] * len(m)
        row = np.arange(len(m))
        rank = self.pairs.find(m[:, :-1], m[:, 1:])
        while len(row):
            if rank.shape[1] == 0:
                low = np.full(len(row), _NONE)
            else:
                first = rank.argmin(axis=1)
                low = rank[np.arange(len(row)), first]
            stop = low == _NONE
            for i in np.flatnonzero(stop):
                done[row[i]] = m[i][m[i] >= 0].copy()
            if stop.all():
                break
            if stop.any():
                go = ~stop
                row, m, rank, first, low = row[go], m[go], rank[go], first[go], low[go]
            if m.shape[1] > _WIDE:
                m, rank = self._round_all(m, rank, first, low)
            else:
                m, rank = self._round_first(m, rank, first, low)
        return done

    def _round_first(self, m, rank, first, low):
        """Every row merges its leftmost minimum pair and closes up by one column."""
        at, cols = np.arange(len(m)), np.arange(m.shape[1] - 1)
        m[at, first] = low
        m = np.take_along_axis(m, cols[None, :] + (cols[None, :] > first[:, None]), axis=1)
        if m.shape[1] == 1:
            return m, np.zeros((len(m), 0), np.int32)
        cols = cols[:-1]
        rank = np.take_along_axis(rank, cols[None, :] + (cols[None, :] > first[:, None]), axis=1)
        right = np.flatnonzero(first < m.shape[1] - 1)
        rank[right, first[right]] = self.pairs.find(m[right, first[right]], m[right, first[right] + 1])
        left = np.flatnonzero(first > 0)
        rank[left, first[left] - 1] = self.pairs.find(m[left, first[left] - 1], m[left, first[left]])
        return m, rank

    def _round_all(self, m, rank, first, low):
        """The rounds of all occurrences of a row's minimum pair at once.

        Left to right, each occurrence not overlapping the one before.  Where
        that would make a pair of still lower rank, which would have its turn
        before the next occurrence, the row merges the leftmost one only.
        """
        hit = rank == low[:, None]
        run = np.zeros(hit.shape, np.int32)  # place within a run of neighbouring hits; odd ones overlap
        for_col = np.zeros(len(m), np.int32)
        if (hit[:, 1:] & hit[:, :-1]).any():
            for j in range(hit.shape[1]):
                for_col = np.where(hit[:, j], for_col + 1, 0)
                run[:, j] = for_col
            hit &= run % 2 == 1
        new, new_rank = self._apply(m, hit, low)
        wrong = (new_rank < low[:, None]).any(axis=1)
        if wrong.any():
            hit[wrong] = False
            hit[np.flatnonzero(wrong), first[wrong]] = True
            new, new_rank = self._apply(m, hit, low)
        return new, new_rank

    def _apply(self, m, hit, low):
        new = m.copy()
        r, c = np.nonzero(hit)
        new[r, c] = low[r]
        new[r, c + 1] = -1
        keep = new >= 0
        n = keep.sum(axis=1)
        out = np.full((len(m), int(n.max())), -1, np.int32)
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = new[keep]
        return out, self.pairs.find(out[:, :-1], out[:, 1:])

    # -- texts -----------------------------------------------------------
    def _learn(self, new: list[str]) -> None:
        pieces: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for chunk in new:
            parts.append([pieces.setdefault(p.encode("utf-8", "replace"), len(pieces)) for p in self.split(chunk)])
        ids = self.merge_pieces(list(pieces))
        flat = [ids[i] for part in parts for i in part]
        size = np.array([len(x) for x in ids] or [0], np.int64)
        sizes = np.array([sum(size[i] for i in part) for part in parts], np.int64)
        ends = len(self.arena) + np.cumsum(sizes)
        self.arena = np.concatenate([self.arena, *flat])
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offset at which each begins (one more at the end)."""
        flat, counts, k = [], [np.zeros(1, np.int64)], 0
        while k < len(texts):
            chars, end = 0, k
            while end < len(texts) and (end == k or chars < _SLICE_CHARS):
                chars += len(texts[end] or "")
                end += 1
            a, n = self._slice(texts[k:end])
            flat.append(a)
            counts.append(n)
            k = end
        return np.concatenate(flat or [np.zeros(0, np.int32)]), np.cumsum(np.concatenate(counts))

    def _slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.cached > _CACHE_CHARS:
            self._reset()
        index, new, chunks = self.index, [], []
        per = np.zeros(len(texts), np.int64)
        find = _CHUNK.findall
        for i, t in enumerate(texts):
            if t:
                c = find(t)
                per[i] = len(c)
                chunks += c
        for c in set(chunks).difference(index):
            index[c] = len(index)
            new.append(c)
        if new:
            self.cached += sum(map(len, new))
            self._learn(new)
        at = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
        by_chunk = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(per)])
        return self.arena[take], by_chunk[bounds[1:]] - by_chunk[bounds[:-1]]


_encoders: dict[tuple[str, str], ByteBPE] = {}


class SharedEncoder:
    """What a task needs to have the encoder of its worker: the rank file, read once on the driver.

    The file has the size of the vocabulary, which doesn't depend on the data.
    """

    def __init__(self, spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, pattern: str = PATTERN):
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            raw = f.read()
        self.file, self.key, self.pattern = spark.sparkContext.broadcast(raw), (name, folder), pattern

    def get(self) -> ByteBPE:
        if self.key not in _encoders:
            _encoders[self.key] = ByteBPE(self.file.value, self.pattern)
        return _encoders[self.key]


def encode_texts(df: DataFrame, id_col: str, text_col: str, encoder: SharedEncoder) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    A row that occurs twice comes out twice; null and empty texts give an empty
    list; other columns are ignored.  There is no exchange.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder.get()
        for b in batches:
            step = 1000
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                flat, offsets = bpe.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    out = StructType([StructField("id", kind), StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, out)
