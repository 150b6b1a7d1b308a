"""All pairs of similar sets, by multi-index binary sketches.

Every set gets a code of one-bit minhashes: bit i is one bit of the smallest
value that hash function i takes on the set, so two sets of Jaccard similarity
j agree in a bit with probability (1 + j) / 2.  Sets that are equal are one
class and are compared once.  The codes of class representatives are cut into
segments; two codes within the wanted Hamming radius agree in at least one
segment except with a probability that the number of segments is calibrated
for.  Pairs that share a segment and lie within the radius are verified on the
original sets, so the result has no false pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.suffixes import _differs
from lakeweave.plans.scratch import written

#: Bits of a code, and those of them that ride along to test the Hamming radius.
BITS, RADIUS_BITS = 1024, 128
#: A set of more rows is split into parts of about half as many, however large it is; no task holds more of one set.
HOT_ROWS = 1_000_000
_SETS = "id string, salt int, hot boolean, n long, tokens array<string>, digest string, code binary"
_SEED = 20240229


@dataclass(frozen=True)
class Plan:
    """Segments (bit positions) and radius for a number of sets, a threshold and a recall."""

    segments: tuple[tuple[int, ...], ...]
    radius: int


def calibrate(n_sets: int, threshold: float, recall: float) -> Plan:
    """The fewest segments by which pairs at the threshold are found with the wanted probability.

    A segment is as long as keeps unrelated codes apart among ``n_sets``.  The
    number of segments is found by simulating the differing bits of pairs whose
    similarity is exactly the threshold; pairs above it are found more often.
    """
    rng = np.random.default_rng(_SEED)
    width = min(48, max(12, math.ceil(math.log2(max(n_sets, 2)))))
    p = (1 - threshold) / 2
    differ = rng.random((4000, BITS)) < p
    found, segments = np.zeros(len(differ), bool), []
    order = rng.permutation(BITS)
    while found.mean() < recall and len(segments) < 4096:
        if len(order) < width:
            order = np.concatenate([order, rng.permutation(BITS)])
            seg = []
            while len(seg) < width:  # distinct positions where the old order ends within a segment
                x, order = order[0], order[1:]
                if x not in seg:
                    seg.append(x)
        else:
            seg, order = order[:width], order[width:]
        segments.append(tuple(int(x) for x in seg))
        found |= ~differ[:, list(seg)].any(axis=1)
    near = np.sort(differ[:, :RADIUS_BITS].sum(axis=1))
    radius = int(near[-1])  # beyond all of the simulated pairs
    return Plan(tuple(segments), radius)


_MULTIPLIERS = np.random.default_rng(_SEED).integers(0, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over each run of token hashes; (runs, BITS) of uint32."""
    out = np.full((len(starts), BITS), np.uint32(0xFFFFFFFF), np.uint32)
    bounds = np.concatenate([starts, [len(hashes)]])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 4096, "right")) - 1)
        for a in range(int(bounds[i]), int(bounds[j]), 65536):
            h = hashes[a : min(int(bounds[j]), a + 65536)]
            at = np.maximum(starts[i:j] - a, 0)
            for k in range(0, BITS, 128):
                x = ((h[:, None] * _MULTIPLIERS[None, k : k + 128]) >> np.uint64(32)).astype(np.uint32)
                low = np.minimum.reduceat(x, at, axis=0) if j > i + 1 else x.min(axis=0, keepdims=True)
                out[i:j, k : k + 128] = np.minimum(out[i:j, k : k + 128], low)
        i = j
    return out


def bits(mins: np.ndarray) -> np.ndarray:
    """One bit of every minimum, packed: (sets, BITS / 8) of uint8."""
    mixed = (mins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(mixed.astype(np.uint8), axis=1)


def _sketch(least: int):
    """Sorted (id, salt, hot, token, hash) rows -> one row per (id, salt) as in _SETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(cols: list[pa.Array]) -> pa.RecordBatch | None:
            new_set = np.concatenate([[True], _differs(cols[0]) | _differs(cols[1])])
            new_token = new_set.copy()
            new_token[1:] |= _differs(cols[3])
            once = pa.array(np.flatnonzero(new_token))
            starts = np.flatnonzero(new_set[new_token])
            ident, salt, hot, token, hashed = (c.take(once) for c in cols)
            n = np.diff(np.concatenate([starts, [len(ident)]]))
            hot_here = hot.take(pa.array(starts)).to_numpy(zero_copy_only=False)
            keep = (n >= least) | hot_here
            if not keep.any():
                return None
            rows = np.repeat(keep, n)
            ident, salt, hot, token, hashed = (c.filter(pa.array(rows)) for c in (ident, salt, hot, token, hashed))
            n, hot_here = n[keep], hot_here[keep]
            ends = np.cumsum(n)
            starts = ends - n
            mins = minima(hashed.to_numpy().view(np.uint64), starts)
            packed = bits(mins)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), token)
            digest = [
                hashlib.md5("\x01".join(t).encode("utf-8", "replace")).hexdigest() for t in tokens.to_pylist()
            ]
            code = [mins[i].tobytes() if h else packed[i].tobytes() for i, h in enumerate(hot_here)]
            at = pa.array(starts)
            return pa.RecordBatch.from_arrays(
                [ident.take(at), salt.take(at), hot.take(at), pa.array(n, pa.int64()), tokens, pa.array(digest), pa.array(code, pa.binary())],
                names=["id", "salt", "hot", "n", "tokens", "digest", "code"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            # a set may go on in the next batch: hold its rows back
            change = np.flatnonzero(_differs(b.column(0)) | _differs(b.column(1)))
            same = held and held[-1].column(0)[-1] == b.column(0)[0] and held[-1].column(1)[-1] == b.column(1)[0]
            if held and (not same or len(change)):
                cut = 0 if not same else int(change[0]) + 1
                parts = [*held, b.slice(0, cut)]
                r = out([pa.concat_arrays([p.column(i) for p in parts]) for i in range(b.num_columns)])
                if r is not None:
                    yield r
                held = []
                b = b.slice(cut)
                change = change[change + 1 > cut] - cut if cut else change
            if len(change):
                cut = int(change[-1]) + 1
                r = out(b.slice(0, cut).columns)
                if r is not None:
                    yield r
                b = b.slice(cut)
            held.append(b)
        if held:
            r = out([pa.concat_arrays([p.column(i) for p in held]) for i in range(held[0].num_columns)])
            if r is not None:
                yield r

    return run


def _merge_hot(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one hot set: 4 KB for every HOT_ROWS / 2 of its rows."""
    parts = parts.sort_values("salt")
    mins = np.stack([np.frombuffer(c, np.uint32) for c in parts["code"]]).min(axis=0)
    digest = hashlib.md5("".join(parts["digest"]).encode()).hexdigest()
    return pd.DataFrame({"id": [parts["id"].iloc[0]], "n": [parts["n"].sum()], "digest": ["h" + digest], "code": [bits(mins[None])[0].tobytes()]})


@dataclass
class Sketches:
    """``sets``: the original sets by (id, salt); ``codes``: (id, n, digest, code, hot) of every set."""

    sets: DataFrame
    codes: DataFrame


def sketch(df: DataFrame, ident: str, token: str, least: int, hot_rows: int = HOT_ROWS) -> Sketches:
    """Codes of all sets with at least ``least`` distinct tokens.

    Null ids are no set; null and empty tokens and repeated rows don't count.
    """
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(token).cast("string").alias("token")).where("id IS NOT NULL AND token <> ''")
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    large = written(sizes.where(F.col("rows") > hot_rows).select("id", F.ceil(F.col("rows") / max(1, hot_rows // 2)).cast("int").alias("parts")), "large-sets")
    hot = not large.isEmpty()
    # left to Spark's own size check: there are at most (all rows) / HOT_ROWS of them
    told = rows.join(large, "id", "left") if hot else rows.withColumn("parts", F.lit(None).cast("int"))
    salted = told.select(
        "id", "token", F.col("parts").isNotNull().alias("hot"), F.coalesce(F.pmod(F.xxhash64("token"), F.col("parts")).cast("int"), F.lit(0)).alias("salt")
    )
    ordered = (
        salted.repartition("id", "salt").sortWithinPartitions("id", "salt", "token")
        .select("id", "salt", "hot", "token", F.xxhash64("token").alias("hash"))
    )
    sets = written(ordered.mapInArrow(_sketch(least), _SETS), "sets")
    codes = sets.where("NOT hot").select("id", "n", "digest", "code", "hot")
    if hot:
        merged = (
            sets.where("hot").select("id", "salt", "n", "digest", "code").groupBy("id")
            .applyInPandas(_merge_hot, "id string, n long, digest string, code binary")
        )
        codes = codes.unionByName(merged.where(F.col("n") >= least).withColumn("hot", F.lit(True)))
    return Sketches(sets, codes)


@dataclass
class SimilarClasses:
    """``members``: (id, rep), every set with its class of equal sets; ``pairs``: (a, b) of similar classes.

    This is as long as the input and the similar pairs of different sets; the
    pairs of all sets grow with the square of a class as well.
    """

    members: DataFrame
    pairs: DataFrame


def similar_classes(
    df: DataFrame, ident: str, token: str, threshold: float, least: int = 1, recall: float = 0.999, hot_rows: int = HOT_ROWS
) -> SimilarClasses:
    """Classes of equal sets, and the pairs of classes whose Jaccard similarity is at least ``threshold``.

    Every pair that comes out is verified exactly; a pair exactly at the
    threshold is missed with probability ``1 - recall`` at most, one above it
    less often; equal sets are always found.  ``least``: sets with fewer
    distinct tokens take no part.  Of tables without rows nothing comes out.
    """
    sk = sketch(df, ident, token, least, hot_rows)
    classes = sk.codes.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    member = written(
        sk.codes.join(classes.select("digest", "n", "rep"), ["digest", "n"]).select("id", "rep", "n", "hot", F.when(F.col("id") == F.col("rep"), F.col("code")).alias("code")),
        "members",
    )
    reps = member.where("code IS NOT NULL")
    plan = calibrate(reps.count(), threshold, recall)
    near = _candidates(reps, plan, threshold)
    return SimilarClasses(member.select("id", "rep"), _verified(written(near, "near"), sk.sets, threshold))


def similar_pairs(
    df: DataFrame, ident: str, token: str, threshold: float, least: int = 1, recall: float = 0.999, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: all pairs of similar sets, those of equal sets included; as :func:`similar_classes` otherwise."""
    found = similar_classes(df, ident, token, threshold, least, recall, hot_rows)
    plain = found.members
    across = (
        found.pairs.join(plain.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a")
        .join(plain.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    ).select("x", "y")
    others = plain.where("id <> rep")
    within = others.select(F.col("rep").alias("x"), F.col("id").alias("y")).unionByName(
        others.select(F.col("id").alias("x"), "rep")
        .join(others.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
    )
    return across.unionByName(within).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))


def _candidates(reps: DataFrame, plan: Plan, threshold: float) -> DataFrame:
    """(a, b, n_a, n_b, hot) of representatives that share a segment and lie within the radius."""
    segments, m = plan.segments, len(plan.segments)
    positions = np.array(segments)
    words = RADIUS_BITS // 64

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (np.uint64(1) << np.arange(positions.shape[1], dtype=np.uint64))[None, None, :]
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                flat = np.unpackbits(raw, axis=1).astype(np.uint64)
                value = (flat[:, positions] * weight).sum(axis=2)  # (sets, segments)
                head = raw[:, : words * 8].copy().view(np.int64)
                at = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), part.column(2).take(at),
                     pa.array(np.tile(np.arange(m, dtype=np.int32), part.num_rows)), pa.array(value.ravel().view(np.int64)),
                     *(pa.array(np.repeat(head[:, w], m)) for w in range(words))],
                    names=["id", "n", "hot", "seg", "val", *(f"w{w}" for w in range(words))],
                )

    schema = "id string, n int, hot boolean, seg int, val long, " + ", ".join(f"w{w} long" for w in range(words))
    rows = reps.select("id", F.col("n").cast("int").alias("n"), "hot", "code").mapInArrow(keys, schema)
    a = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns))
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    apart = sum(F.bit_count(F.col(f"a_w{w}").bitwiseXOR(F.col(f"b_w{w}"))) for w in range(words))
    on = (
        (F.col("a_seg") == F.col("b_seg")) & (F.col("a_val") == F.col("b_val")) & (F.col("a_id") < F.col("b_id"))
        & (F.least("a_n", "b_n") / F.greatest("a_n", "b_n") >= threshold) & (apart <= plan.radius)
    )
    return a.join(b, on).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"),
        (F.col("a_hot") | F.col("b_hot")).alias("hot"),
    ).distinct()


def _verified(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the candidates whose original sets are similar enough."""
    enough = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")) >= threshold
    plain = sets.where("NOT hot").select("id", "tokens")
    small = (
        near.where("NOT hot").join(plain.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(plain.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    )
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    large = (
        near.where("hot").join(tokens.withColumnRenamed("id", "a"), "a").join(tokens.withColumnRenamed("id", "b"), ["b", "token"])
        .groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    )
    return small.where(enough).select("a", "b").unionByName(large.where(enough).select("a", "b"))
