"""Row signatures: character hashes, MD5, similarity hashes and Bloom filters, all as JVM expressions.

A signature of 64 bits is a LONG, a longer one an array of LONGs, least
significant word first.  The signature of a row is the bitwise OR of the
signatures of its cells, so a row that holds given values has all their bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments per character for each signature size, and the alphabet.
SEGMENTS = {64: 1, 128: 3, 256: 6, 512: 13}
ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"


def xash_letters(token: str, ones: int = 5) -> Column:
    """What the character hash needs of the column named ``token``, for all sizes: (n, l), its length and its rarest characters.

    ``l`` has the place in the alphabet, the number and the summed positions of
    each.  Null, empty and blank tokens and the word None have null.
    """
    return F.expr(_xash_letters(token, ones))


def _xash_letters(token: str, ones: int) -> str:
    t = f"coalesce({token}, '')"
    return f"""
        CASE WHEN {t} NOT IN ('', 'None', ' ', '''''') THEN
        transform(array(filter(split({t}, ''), c -> c <> '')), ch -> struct(size(ch) AS n, transform(
            filter(slice(sort_array(transform(array_distinct(ch), c -> struct(size(ch) - length(replace({t}, c, '')) AS k, c AS c))), 1, {ones}),
                s -> instr('{ALPHABET}', s.c) > 0),
            s -> struct(instr('{ALPHABET}', s.c) - 1 AS at, s.k AS k,
                aggregate(transform(ch, (x, i) -> IF(x = s.c, i, 0)), 0, (a, b) -> a + b) AS at_sum)) AS l))[0]
        END"""


def xash_placed(letters: str, size: int = 128, rotation: bool = True) -> Column:
    """Bits set by the character hash, of the column named ``letters`` that :func:`xash_letters` made: sorted array of int."""
    return F.expr(_xash_placed(letters, size, rotation))


def _xash_placed(x: str, size: int, rotation: bool) -> str:
    m = SEGMENTS[size]
    body = len(ALPHABET) * m
    tail = size - body
    shift = f"floor({body} * ({x}.n % {tail}) / {tail})" if rotation else "0"
    return f"""
        CASE WHEN {x} IS NULL THEN CAST(array() AS array<int>) ELSE sort_array(array_distinct(concat(
            transform({x}.l, s -> CAST((s.at * {m} + greatest(0, CAST(ceil(s.at_sum * {m} / ({x}.n * s.k)) AS int) - 1) + CAST({shift} AS int)) % {body} AS int)),
            array(CAST({body} + {x}.n % {tail} AS int)))))
        END"""


def xash_positions(token: str, size: int = 128, rotation: bool = True, ones: int = 5) -> Column:
    """Bits set by the character hash of the column named ``token``: sorted array of int.

    Its rarest characters set one bit each, placed by character and mean
    position; one more bit tells the length.  Null, empty and blank tokens and
    the word None have none.
    """
    return F.expr(f"transform(array({_xash_letters(token, ones)}), letters__ -> {_xash_placed('letters__', size, rotation)})[0]")


def words_of(positions: Column, size: int) -> Column:
    """Bit positions as an array of LONG words, least significant first."""
    def word(k: int) -> Column:
        return F.aggregate(
            F.filter(positions, lambda p: (p >= 64 * k) & (p < 64 * (k + 1))), F.lit(0).cast("long"),
            lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - 64 * k)),
        )

    return F.array(*(word(k) for k in range(size // 64)))


def bit_string(words: Column, size: int) -> Column:
    """An array of words as text of 0 and 1, most significant bit first."""
    return F.concat(*(F.lpad(F.bin(words[k]), 64, "0") for k in reversed(range(size // 64))))


def position_string(positions: Column, size: int) -> Column:
    """Sorted bit positions as text of 0 and 1, most significant bit first: the zeros between them, joined by ones."""
    zeros = F.lit("0" * size)

    def text(down: Column) -> Column:
        gaps = F.zip_with(F.concat(F.array(F.lit(size)), down), F.concat(down, F.array(F.lit(-1))), lambda a, b: F.substring(zeros, F.lit(1), a - b - 1))
        return F.array_join(gaps, "1")

    return F.transform(F.array(F.reverse(positions)), text)[0]


def words_of_bits(bits: Column, size: int) -> Column:
    """Text of 0 and 1 as an array of words; the inverse of :func:`bit_string`."""
    def word(k: int) -> Column:
        start = size - 64 * (k + 1)
        high = F.conv(F.substring(bits, start + 1, 32), 2, 10).cast("long")
        low = F.conv(F.substring(bits, start + 33, 32), 2, 10).cast("long")
        return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)

    return F.array(*(word(k) for k in range(size // 64)))


def contained(needle: Column, hay: Column, size: int) -> Column:
    """Whether all bits of ``needle`` are set in ``hay``."""
    test = F.lit(True)
    for k in range(size // 64):
        test = test & (needle[k].bitwiseAND(F.bitwise_not(hay[k])) == 0)
    return test


def or_words(words: Column, size: int) -> Column:
    """Aggregate: bitwise OR of signatures."""
    return F.array(*(F.bit_or(words[k]) for k in range(size // 64)))


def md5_words(token: Column) -> Column:
    """The 128 bits of MD5 as two words."""
    h = F.md5(token)

    def half(at: int) -> Column:
        high = F.conv(F.substring(h, at, 8), 16, 10).cast("long")
        low = F.conv(F.substring(h, at + 8, 8), 16, 10).cast("long")
        return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)

    return F.array(half(17), half(1))


def simhash_positions(token: str) -> Column:
    """Bits of the 128-bit similarity hash: those set in most of the MD5s of the token's 3-character shingles.

    Lower case, other than word characters removed; shorter tokens are one shingle.
    """
    t = f"regexp_replace(lower({token}), '[^A-Za-z0-9_]+', '')"
    return F.expr(f"""
        aggregate(array({t}), CAST(array() AS array<int>), (z, t) ->
          aggregate(array(transform(sequence(1, greatest(length(t) - 2, 1)), i -> md5(substring(t, i, 3)))), z, (y, hs) ->
            filter(sequence(0, 127), b -> 2 * size(filter(hs, h ->
                shiftright(CAST(conv(substring(h, 32 - CAST(floor(b / 4) AS int), 1), 16, 10) AS int), CAST(b % 4 AS int)) & 1 = 1)) > size(hs))))""")


def bloom_positions(token: str, size: int, hashes: int) -> Column:
    """Bits that a token sets in a Bloom filter: the first 32 bits of the MD5 of a seed and the token, modulo ``size``."""
    return F.expr(
        f"array_sort(array_distinct(transform(sequence(0, {hashes - 1}), seed__ -> "
        f"CAST(CAST(conv(substring(md5(concat(CAST(seed__ AS string), ':', {token})), 1, 8), 16, 10) AS bigint) % {size} AS int))))"
    )


def bloom_size(items: int, p: float) -> int:
    """Bits for ``items`` items at the false-positive rate ``p``."""
    return int(-(items * math.log(p)) / (math.log(2) ** 2))


def bloom_hashes(size: int, items: int) -> int:
    """Hash functions for a filter of ``size`` bits and ``items`` items."""
    return int((size / items) * math.log(2))


@dataclass(frozen=True)
class Signature:
    """A row signature: its size in bits, and the bits that the token in a named column sets."""

    size: int
    positions: Callable[[str], Column]

    def words(self, token: str) -> Column:
        return words_of(self.positions(token), self.size)


def xash(size: int = 128, rotation: bool = True, ones: int = 5) -> Signature:
    return Signature(size, lambda t: xash_positions(t, size, rotation, ones))


def bloom(size: int = 128, hashes: int = 5, items: int = 6) -> Signature:
    """Bloom filters; ``hashes`` = -1: as many as ``items`` items call for."""
    k = bloom_hashes(size, items) if hashes == -1 else hashes
    return Signature(size, lambda t: F.when(F.coalesce(F.col(t), F.lit("")) != "", bloom_positions(t, size, k)).otherwise(F.array().cast("array<int>")))


def md5_signature() -> Signature:
    return Signature(128, lambda t: F.expr(
        f"filter(sequence(0, 127), bit__ -> shiftright(CAST(conv(substring(md5({t}), 32 - CAST(floor(bit__ / 4) AS int), 1), 16, 10) AS int), CAST(bit__ % 4 AS int)) & 1 = 1)"
    ))


def simhash() -> Signature:
    return Signature(128, simhash_positions)


def row_key(columns: Sequence[str], signature: Signature) -> Column:
    """Signature of a row of several token columns."""
    out = None
    for c in columns:
        w = signature.words(c)
        out = w if out is None else F.zip_with(out, w, lambda a, b: a.bitwiseOR(b))
    return out
