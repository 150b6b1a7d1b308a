"""One form for texts that look the same.

1. Compatibility normalisation, of what looks the same only: full-width and
   other presentation forms, all blanks but tab and line end to U+0020,
   accents composed.  Raised digits, fractions and degree signs look different
   and stay.
2. Characters that don't show are deleted.
3. Every word (run of letters) gets letters of one script.  Its letters open a
   lattice: each may be itself or any of its look-alikes in the script, of
   which there may be several, and two letters may stand for one that looks
   like both together.  Viterbi search finds the best path through the lattice
   of each script: the one with the fewest letters left out of place, then with
   the highest sum of that script's character bigram scores and of what the
   look-alikes on it cost (less where they look the same than where they are
   merely similar).  Paths never change script within a word.  A constraint
   decides between Latin and the others: a word is Cyrillic or Greek only if
   one of its letters resembles no Latin letter, so if every letter has a Latin
   one that looks the same only Latin paths count.  Letters of other scripts
   take part in words that are mixed.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek that look like a Latin letter (left: as stored, right: Latin).
CYRILLIC_AS_LATIN = dict(zip("аеорсухѕіјһԁԛԝӕАВЕЅІЈКМНОРСТУХӔ", "aeopcyxsijhdqwæABESIJKMHOPCTYXÆ", strict=True))
GREEK_AS_LATIN = dict(zip("οϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ocABEZHIKMNOPTYXC", strict=True))
# A plain stroke, which is capital I as well as small l.
STROKES = ("ӏl", "ӏI", "Ӏl", "ӀI", "Іl", "Ιl")
# Letters of other scripts that look like a Latin letter, where they stand in a word with letters of the three.
OTHERS_AS_LATIN = dict(zip("օսհոցզյՕՏԼՍᎪᏴᏟᎠᎬᎶᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃⲟⲥⲣ", "ouhngqjOSLUABCDEGHJKLMPRSTVWZocp", strict=True))
# Groups of letters that are similar without looking the same; they only serve words that aren't Latin.
SIMILAR = ("aα", "bьвβ", "eε", "hнη", "iι", "kкκ", "mмμ", "nпηπ", "pρ", "rг", "sσ", "tтτ", "uиυμ", "vνѵυ", "wшω", "xχ", "yγ", "zζ", "NИ", "RЯ", "GԌ", "KК", "YΥ")
# Two letters that together look like one.
PAIRS = {"bl": "ы", "bI": "Ы", "lo": "ю", "lO": "Ю", "IO": "Ю"}
#: What a path pays for a letter that looks the same as the one stored, and for one that is similar.
SAME_COST, SIMILAR_COST = 0.5, 3.0

#: Text of which nothing can need a change: printable ASCII, tabs and line ends.
PLAIN = r"\A[\x20-\x7E\t\n\r]*\z"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SEEMS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>", "<compat>"}
#: Show nothing although their category says otherwise.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_START = "^"


@lru_cache(maxsize=65536)
def fold_char(ch: str) -> str:
    """A character's common form by itself; '' if it doesn't show."""
    if ch in "\t\n\r" or " " <= ch <= "~":
        return ch
    kind, code = unicodedata.category(ch), ord(ch)
    if kind in ("Cf", "Cc") or code in _UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    if ch in CYRILLIC_AS_LATIN or ch in GREEK_AS_LATIN:
        return ch
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in _SEEMS:
        # spacing accents decompose to a blank and a mark and don't look like that
        if parts[0] == "<compat>" and parts[1] == "0020":
            return ch
        return "".join(fold_char(chr(int(p, 16))) for p in parts[1:])
    return ch


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """Script of a letter: its first name word for Latin, Cyrillic and Greek, '' for all others."""
    first = unicodedata.name(ch, "").split(" ")[0]
    return first if first in SCRIPTS else ""


def _alternatives() -> dict[str, dict[str, dict[str, float]]]:
    """letter -> script -> its look-alikes there with their costs; many to many."""
    same: dict[str, set[str]] = {}
    for pair in [*CYRILLIC_AS_LATIN.items(), *GREEK_AS_LATIN.items(), *OTHERS_AS_LATIN.items(), *map(tuple, STROKES)]:
        for a, b in (pair, pair[::-1]):
            same.setdefault(a, set()).add(b)
    similar: dict[str, set[str]] = {}
    for group in SIMILAR:
        for a in group:
            similar.setdefault(a, set()).update(set(group) - {a})
    out: dict[str, dict[str, dict[str, float]]] = {}
    for ch in {*same, *similar}:
        own = out.setdefault(ch, {s: {} for s in SCRIPTS})
        latin = {ch} | {x for x in same.get(ch, ()) if script_of(x) == "LATIN"}
        # by way of the Latin letters that it looks like, letters of two other scripts look alike as well
        near = {y: SIMILAR_COST for x in latin for y in similar.get(x, ())}
        near |= {y: SAME_COST for x in latin for y in {x, *same.get(x, ())}}
        for y, cost in near.items():
            if y != ch and script_of(y):
                own[script_of(y)][y] = cost
    return out


_ALIKE = _alternatives()
#: Letters with a Latin letter that looks the same.
_LATIN = {ch for ch, found in _ALIKE.items() if script_of(ch) == "LATIN" or SAME_COST in found["LATIN"].values()}


@lru_cache(maxsize=65536)
def options(ch: str, script: str) -> tuple[tuple[str, float], ...]:
    """The letters of ``script`` that a letter may stand for, each with its cost; none if there aren't any."""
    own = script_of(ch)
    if own == script or not own and ch not in OTHERS_AS_LATIN:
        return ((ch, 0.0),)
    limit = SAME_COST if script == "LATIN" else SIMILAR_COST
    found = _ALIKE.get(ch, {}).get(script, {})
    if not found:  # an accented letter may have a look-alike base
        d = unicodedata.normalize("NFD", ch)
        base = _ALIKE.get(d[0], {}).get(script, {}) if len(d) > 1 else {}
        found = {unicodedata.normalize("NFC", b + d[1:]): cost for b, cost in base.items()}
    return tuple(sorted((x, cost) for x, cost in found.items() if cost <= limit))


def lattice(word: str, script: str) -> list[list[tuple[int, str, float, bool]]]:
    """For each place of a word what may stand from there on in ``script``: (letters taken, what for, cost, fits).

    A letter without any look-alike there may only stay as it is, and doesn't fit.
    """
    out = []
    for i, ch in enumerate(word):
        arcs = [(1, x, cost, True) for x, cost in options(ch, script)] or [(1, ch, 0.0, False)]
        one = PAIRS.get(word[i : i + 2])
        if one and script_of(one) == script:
            arcs.append((2, one, SIMILAR_COST, True))
        out.append(arcs)
    return out


def is_latin(word: str) -> bool:
    """Whether every letter of a word is Latin or has a Latin letter that looks the same."""
    return all(script_of(c) == "LATIN" or c in _LATIN or not script_of(c) or script_of(unicodedata.normalize("NFD", c)[0]) == "LATIN" or unicodedata.normalize("NFD", c)[0] in _LATIN for c in word)


class ScriptModel:
    """Character bigram scores of each script."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pair = Counter()
        self.from_ = Counter()
        self.letters = {s: set() for s in SCRIPTS}
        self.known: dict[str, str] = {}
        for (a, b), n in counts.items():
            self.pair[a, b] += n
            self.from_[a] += n
            self.letters[script_of(b) or "LATIN"].add(b)

    def score(self, script: str, a: str, b: str) -> float:
        return math.log((self.pair[a, b] + 0.5) / (self.from_[a] + 0.5 * (len(self.letters[script]) + 1)))

    def viterbi(self, word: str, script: str) -> tuple[int, float, str]:
        """(letters out of place, score, best path) of a word in one script."""
        # at each place and for each last letter the best path to there: (less the letters out of place, score), and where it came from
        best: list[dict[str, tuple[int, float]]] = [{} for _ in range(len(word) + 1)]
        back: list[dict[str, tuple[int, str]]] = [{} for _ in range(len(word) + 1)]
        best[0][_START + script] = (0, 0.0)
        for i, arcs in enumerate(lattice(word, script)):
            for last, (out, score) in best[i].items():
                for n, x, cost, fits in arcs:
                    found = (out - (not fits), score + self.score(script, last, x) - cost)
                    if x not in best[i + n] or found > best[i + n][x]:
                        best[i + n][x], back[i + n][x] = found, (i, last)
        at, last = len(word), max(best[-1], key=lambda x: (best[-1][x], x))
        out, score = best[at][last]
        path = []
        while at:
            path.append(last)
            at, last = back[at][last]
        return -out, score, "".join(reversed(path))

    def word(self, word: str) -> str:
        scripts = {script_of(c) for c in word} - {""}
        if not scripts or scripts == {"LATIN"} and not any(c in OTHERS_AS_LATIN for c in word):
            return word
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            if is_latin(word):
                self.known[word] = self.viterbi(word, "LATIN")[2]
            else:
                found = [self.viterbi(word, s) for s in sorted(scripts - {"LATIN"})] or [self.viterbi(word, "LATIN")]
                self.known[word] = min(found, key=lambda f: (f[0], -f[1]))[2]
        return self.known[word]

    def text(self, text: str | None) -> str | None:
        """The common form of a text; None stays None."""
        if text is None:
            return None
        folded = unicodedata.normalize("NFC", "".join(map(fold_char, text)))
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m.group()), folded))


def fit(texts: DataFrame, column: str) -> ScriptModel:
    """Bigram scores from all words of one script in a column.

    Plain ASCII texts are counted too.  What comes back has at most the square
    of the number of letters of the three scripts, whatever the input holds.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            codes = _bigrams(b["t"])
            keys, n = np.unique(codes, return_counts=True)
            keys, at = np.unique(np.concatenate([total[0], keys]), return_inverse=True)
            total = keys, np.bincount(at, np.concatenate([total[1], n])).astype(np.int64)
        yield pd.DataFrame({"k": total[0], "n": total[1]})

    rows = (
        texts.select(F.col(column).cast("string").alias("t")).where("t IS NOT NULL")
        .mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    )
    counts: dict[tuple[str, str], int] = {}
    for k, n in rows:
        a, b = chr(k >> 32), chr(k & 0xFFFFFFFF)
        start = not a.isalpha()
        if b.isalpha() and script_of(b) and (start or script_of(a) == script_of(b)):
            key = (_START + script_of(b) if start else a, b)
            counts[key] = counts.get(key, 0) + n
    return ScriptModel(counts)


def _bigrams(texts: pd.Series) -> np.ndarray:
    """Codes of all pairs (previous character, letter); before a word stands a blank."""
    flat = np.frombuffer((" " + " ".join(texts.tolist())).encode("utf-32-le", "replace"), np.uint32)
    # Latin, Greek and Cyrillic stand in these blocks, so what is counted is bounded by their letters
    letter = ((flat > 127) & (flat < 0x530)) | ((flat >= 0x1C80) & (flat < 0x2000)) | ((flat | 32) - 97 < 26)
    prev = np.where(letter[:-1], flat[:-1], 32).astype(np.int64)
    keep = letter[1:]
    return (prev[keep] << 32) | flat[1:][keep].astype(np.int64)


def common_form(column: Column, model: ScriptModel) -> Column:
    """The common form of a text column.  Null stays null, '' stays ''; whole texts of any length are taken."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        known: dict[str | None, str | None] = {}
        return texts.map(lambda t: known[t] if t in known else known.setdefault(t, model.text(t)))

    return F.when(column.isNull() | column.rlike(PLAIN), column).otherwise(form(column))


def out_of_form(df: DataFrame, column: str, model: ScriptModel) -> DataFrame:
    """Rows of ``df`` whose text isn't in its common form, with that form as ``common``."""
    return (
        df.where(~F.col(column).rlike(PLAIN))
        .withColumn("common", common_form(F.col(column), model))
        .where(F.col("common") != F.col(column))
    )
