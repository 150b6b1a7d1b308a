"""Variant spellings of the same person's or work's name.

1. Names are normalised: case, accents, blanks, moved parts ("Surname, Given",
   "Affair, The"), annotations, numerals.  Placeholders name nothing.
2. A symmetric-delete neighbourhood index on the tokens of all names, frequent
   and short ones included, finds tokens at a small edit distance: two tokens
   are neighbours only if deleting a few letters of each can leave the same
   rest.  How many tokens share a rest is bounded by the alphabet.
3. Names meet where two things agree: a token, as written or as corrected by
   the index, and what another token may stand for (itself, its corrections,
   short and full forms, an initial, its beginning) or evidence (a film).
   Works meet in all their tokens with up to three of them corrected.  Of two
   neighbouring tokens the rarer one is corrected to the other, never the other
   way round, so a usual token has few corrections however often it is misspelled.
4. Names that meet are aligned: tokens are assigned to each other at the lowest
   total cost, edits, short forms, initials and abbreviations being allowed.
5. Links of full names make groups.  An edit that may as well be another name,
   two edits in one token, and given names that no lexicon links count only
   where the names share evidence.  A name with a short form or an initial
   joins the one group that it can stand for; where there are several, those
   that share evidence with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lakeweave.llm.components import connected_components
from lakeweave.plans.scratch import written

#: A token is established (a given name, a common word; not a typing error of another one) from this share of the names,
#: and at least so many; there are at most (tokens of a name) / ESTABLISHED of them.
ESTABLISHED, LEAST_ESTABLISHED = 0.002, 8
#: A token may be a short form that the data show from this share of the names.
SHORT_FORM, LEAST_SHORT_FORM = 0.0003, 3
#: Tokens from this length on are hardly ever one edit away from another name by chance.
LONG = 8
#: A token that is one edit off is a typing error only if fewer names than this would be expected to hold it and the rest by chance.
CHANCE = 0.01
#: Spellings that name nothing, and abbreviations that are also written without a full stop: defaults of parameters.
PLACEHOLDERS = frozenset({"", "n a", "na", "unknown", "none", "null", "nan", "tbd", "tba", "anonymous", "not available", "unnamed", "no name", "various", "untitled", "undefined", "missing", "no title", "no director", "not known", "not specified", "test"})
ABBREVIATIONS = frozenset({"mr", "mrs", "dr", "st", "mt", "rd", "capt", "dept", "bros", "no", "prof", "ave"})
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th", "ð": "d", "’": "'", "–": "-", "—": "-"})
_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
_WORDS = {n: w for w, n in _NUMBERS.items()}
_ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
_CREDIT = re.compile(r"^\s*(?:dir(?:ector)?\s*[.:]+|directed by|director|a film by|film by)\s*:?\s*", re.I)
_NOTE = re.compile(r"[\(\[][^\)\]]*[\)\]]")
_ARTICLE = re.compile(r"^(.*?),\s*(the|a|an)\b(.*)$")
_PART = re.compile(r"\b(?:part|pt\.?|vol\.?|volume|chapter)\s+(\w+)\s*$")
_TOKENS = re.compile(r"[^\W_]+\.?")


def folded(text: str) -> str:
    """Lower case without accents."""
    low = unicodedata.normalize("NFKD", text).casefold().translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def person_tokens(name: str | None, placeholders: frozenset[str] = PLACEHOLDERS) -> list[str] | None:
    """Tokens of a person's name, given name first where the order is known; None for a placeholder."""
    if name is None:
        return None
    text = _CREDIT.sub("", folded(name)).strip()
    last, comma, first = text.partition(",")
    if comma and first.strip():
        text = f"{first} {last}"
    tokens = [t.rstrip(".") for t in _TOKENS.findall(text.replace("'", ""))]
    return None if " ".join(tokens) in placeholders else tokens


def title_tokens(title: str | None, placeholders: frozenset[str] = PLACEHOLDERS, abbreviations: frozenset[str] = ABBREVIATIONS) -> list[str] | None:
    """Tokens of a work's title: no article in front, numbers as digits; None for a placeholder."""
    if title is None:
        return None
    text = _NOTE.sub(" ", folded(title)).replace("&", " and ").replace("'", "").strip(" .:-")
    moved = _ARTICLE.match(text)
    if moved:
        text = moved[1] + moved[3]
    text = text.strip(" .:-")
    part = _PART.search(text)
    if part and (part[1].isdigit() or part[1] in _NUMBERS or part[1] in _ROMAN or part[1] == "i"):
        n = part[1]
        text = text[: part.start()] + " " + (_NUMBERS.get(n) or _ROMAN.get(n) or ("1" if n == "i" else n))
    tokens = _TOKENS.findall(text)
    if " ".join(t.rstrip(".") for t in tokens) in placeholders:
        return None
    if len(tokens) > 1 and tokens[0] in ("the", "a", "an"):
        tokens = tokens[1:]
    if len(tokens) > 1 and tokens[-1] in _ROMAN:
        tokens[-1] = _ROMAN[tokens[-1]]
    end = len(tokens) - (len(tokens) > 2 and tokens[-1].rstrip(".").isdigit())
    if end > 1 and tokens[end - 1].rstrip(".") in ("the", "a", "an"):
        del tokens[end - 1]
    # a number inside the title is a word, one at its end a part
    tokens[:-1] = [_WORDS.get(t.rstrip("."), t) for t in tokens[:-1]]
    out = []
    for i, t in enumerate(tokens):
        bare = t.rstrip(".")
        # "no" is a number's only before one: No Rain in Vienna
        known = bare in abbreviations and (bare != "no" or tokens[i + 1 : i + 2] and tokens[i + 1].rstrip(".").isdigit())
        out.append(bare + "." if t.endswith(".") and not bare.isdigit() or known else bare)
    if out and out[-1].endswith(".") and out[-1][:-1] not in abbreviations:
        out[-1] = out[-1][:-1]
    return out


def allowed_edits(length: int) -> int:
    """The most edits that a token of this length may have, and so the letters to delete of it."""
    return 0 if length < 4 else 1 if length < 5 else 2


def most_edits(a: str, b: str) -> int:
    """Edits at which two tokens may stand for each other."""
    return 2 if min(len(a), len(b)) > 4 else 1 if max(len(a), len(b)) > 3 else 0


def deletes(token: str, depth: int) -> set[str]:
    """The token and all that is left of it after up to ``depth`` deletions."""
    found = {token}
    for k in range(1, min(depth, len(token) - 1) + 1):
        found |= {"".join(c for i, c in enumerate(token) if i not in out) for out in map(set, combinations(range(len(token)), k))}
    return found


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two tokens; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def abbreviates(short: str, long: str) -> bool:
    """'capt.' for captain, 'rd.' for road: the first letter and others in order, with a full stop."""
    if not short.endswith(".") or len(short) < 3 or len(long) < len(short):
        return False
    s = short[:-1]
    if s == "no":
        return long == "number"
    if s[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in s)


@dataclass(frozen=True)
class Lexicon:
    """Established tokens, and the full forms of short forms of given names."""

    established: frozenset[str] = frozenset()
    full: Mapping[str, frozenset[str]] = field(default_factory=dict)

    def forms(self, token: str) -> frozenset[str]:
        return self.full.get(token, frozenset())


SAME, EDIT, SHORT, INITIAL = 0, 1, 2, 3
_COST = {SAME: 0.0, EDIT: 1.0, SHORT: 0.6, INITIAL: 0.8}


def token_match(a: str, b: str, lexicon: Lexicon, person: bool) -> tuple[float, int] | None:
    """(cost, kind) at which two tokens stand for each other; None if they don't."""
    if a == b:
        return 0.0, SAME
    if a.isdigit() or b.isdigit():
        return None
    if person:
        if len(a) == 1 or len(b) == 1:
            one, other = (a, b) if len(a) == 1 else (b, a)
            if len(other) > 1 and (other[0] == one or any(f[0] == one for f in lexicon.forms(other))):
                return _COST[INITIAL], INITIAL
            return None
        if b in lexicon.forms(a) or a in lexicon.forms(b) or lexicon.forms(a) & lexicon.forms(b):
            return _COST[SHORT], SHORT
        short, long = sorted((a, b), key=len)
        if 3 <= len(short) <= 5 and len(long) - len(short) > 1 and long.startswith(short):  # Fred, Chris
            return _COST[SHORT], SHORT
    else:
        if abbreviates(a, b) or abbreviates(b, a):
            return _COST[SHORT], EDIT
        a, b = a.rstrip("."), b.rstrip(".")
    if a in lexicon.established and b in lexicon.established:
        return None
    most = most_edits(a, b)
    n = edits(a, b, most)
    return (float(n), EDIT if n else SAME) if n <= most else None


def hungarian(cost: list[list[float]]) -> list[int]:
    """For each row of a square matrix its column in the assignment of the lowest total cost; cubic in the size."""
    n = len(cost)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while row_of[j0]:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def assign(left: list[str], right: list[str], lexicon: Lexicon, person: bool) -> tuple[float, list[tuple[str, str, int]], list[str], list[str]]:
    """The assignment that leaves the fewest whole tokens over, then the fewest initials, at the lowest cost: (cost, pairs with kinds, unmatched left, unmatched right).

    Equal whole tokens are assigned first, which is always optimal; the rest by
    an optimal assignment, whatever their number.
    """
    pairs, rest_l, rest_r = [], [], list(right)
    for t in left:
        if t in rest_r and (len(t) > 1 or not person):
            rest_r.remove(t)
            pairs.append((t, t, SAME))
        else:
            rest_l.append(t)
    found = {(i, j): m for i, t in enumerate(rest_l) for j, u in enumerate(rest_r) if (m := token_match(t, u, lexicon, person))}
    if not found:
        return 0.0, pairs, rest_l, rest_r
    n = max(len(rest_l), len(rest_r))
    big = 10.0 * n  # more than all costs together
    worth = {(i, j): sum(2 * n + 1 if len(x) > 1 else 1 for x in (rest_l[i], rest_r[j])) for i, j in found}
    matrix = [[found[i, j][0] - big * worth[i, j] if (i, j) in found else 0.0 for j in range(n)] for i in range(n)]
    used = {i: j for i, j in enumerate(hungarian(matrix)) if (i, j) in found}
    pairs += [(rest_l[i], rest_r[j], found[i, j][1]) for i, j in used.items()]
    gone = set(used.values())
    return sum(found[p][0] for p in used.items()), pairs, [t for i, t in enumerate(rest_l) if i not in used], [t for j, t in enumerate(rest_r) if j not in gone]


@dataclass(frozen=True)
class Usage:
    """In how many of ``names`` names tokens occur; without counts no edit is doubted."""

    names: int = 0
    counts: Mapping[str, int] = field(default_factory=dict)

    def count(self, token: str) -> int:
        return self.counts.get(token.rstrip("."), 1)

    def doubtful(self, pairs: list[tuple[str, str, int]]) -> bool:
        """Whether an edit among the pairs may as well be another name.

        Letters swapped or doubled are slips, and long tokens differ by errors
        only.  Elsewhere it is asked how many names that hold the rarer of the
        two tokens and the rest of the name were to be expected by chance.
        """
        for x, y, k in pairs:
            if k != EDIT or not self.names:
                continue
            a, b = x.rstrip("."), y.rstrip(".")
            if min(len(a), len(b)) >= LONG or abbreviates(x, y) or abbreviates(y, x) or slip(a, b):
                continue
            other = [max(self.count(p), self.count(q)) for p, q, j in pairs if (p, q) != (x, y) and j in (SAME, EDIT) and len(p) > 1]
            chance = min(self.count(a), self.count(b)) * min(other, default=self.names) / self.names
            if chance > CHANCE:
                return True
        return False


def slip(a: str, b: str) -> bool:
    """Whether two tokens differ by letters swapped or a letter doubled."""
    if len(a) == len(b):
        return sorted(a) == sorted(b)
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[i] == long[i + 1] and long[:i] + long[i + 1 :] == short for i in range(len(short)))


def person_link(a: list[str], b: list[str], lexicon: Lexicon, usage: Usage = Usage()) -> str | None:
    """'full', 'far' (two edits in one token, an edit that may be another name, or another given name that may be a short form), 'short' or 'initial' (how a full token is stood for), None if the names differ."""
    _, pairs, left, right = assign(a, b, lexicon, True)
    whole_l, whole_r = [t for t in left if len(t) > 1], [t for t in right if len(t) > 1]
    if whole_l or whole_r:
        one, other = "".join(a), "".join(b)
        if len(one) > 7 and len(a) != 1 and edits(one, other, 1) <= 1:
            return "full"
        # a short form that no lexicon has: Maggie for Margaret, Liv for Olivia
        alike = len(whole_l) == len(whole_r) == 1 and (
            whole_l[0][0] == whole_r[0][0] or len(whole_l[0]) > 2 and whole_l[0] in whole_r[0] or len(whole_r[0]) > 2 and whole_r[0] in whole_l[0]
        )
        initials = [t for t in left if len(t) == 1] and [t for t in right if len(t) == 1]
        surname = any(k in (SAME, EDIT) and len(x) > 4 and edits(x, y, 1) <= 1 for x, y, k in pairs)
        return "far" if alike and surname and not initials else None
    if left and right:  # different initials
        return None
    solid = [x for x, y, k in pairs if k in (SAME, EDIT) and len(x) > 2]
    if not solid:
        return None
    if sum(edits(x, y, 2) for x, y, k in pairs if k == EDIT) > 3:
        return None
    # initials of one name stand for tokens of the other, not each for one of the other's
    if len({len(x) == 1 for x, _, k in pairs if k == INITIAL}) > 1:
        return None
    kinds = {k for _, _, k in pairs}
    far = any(k == EDIT and edits(x, y, 2) > 1 for x, y, k in pairs)
    if usage.doubtful(pairs):
        return "far"
    return "initial" if INITIAL in kinds else "short" if SHORT in kinds else "far" if far else "full"


def title_link(a: list[str], b: list[str], lexicon: Lexicon, usage: Usage = Usage()) -> str | None:
    """'full' if the titles are the same but for spelling, 'far' with two edits in one token or an edit that may be another word; numbers must agree."""
    _, pairs, left, right = assign(a, b, lexicon, False)
    if left or right:
        one, other = "".join(a), "".join(b)
        same_numbers = [c for c in one if c.isdigit()] == [c for c in other if c.isdigit()]
        return "full" if same_numbers and len(one) > 9 and edits(one, other, 1) <= 1 else None
    typed = [edits(x, y, 2) for x, y, k in pairs if k == EDIT and not (x.endswith(".") or y.endswith("."))]
    return None if sum(typed) > 3 else "far" if max(typed, default=0) > 1 or usage.doubtful(pairs) else "full"


#: Marks of a key: bits of which two names that meet have none in common.  A name with a whole word where the other must
#: have an initial has WHOLE; of two opened tokens of a title each has a bit.  PLAIN keys are only for each other.
WHOLE, PLAIN = 1, -1


def person_keys(tokens: list[str], near: Mapping[str, set[str]], lexicon: Lexicon) -> set[tuple[str, int]]:
    """(key, mark) at which a person's name meets others: a token, and what another one may stand for.

    ``near``: the tokens that each token may be misspelled from.
    """
    found = set()
    whole = sum(len(o) > 1 for o in tokens)
    for i, t in enumerate(tokens):
        if len(t) == 1:
            continue
        heads = {("", 0)} if whole == 1 else set()
        for o in tokens[:i] + tokens[i + 1 :]:
            if len(o) == 1:
                heads.add((f"1 {o}", 0))
                continue
            heads |= {(f"1 {f[0]}", WHOLE) for f in (o, *lexicon.forms(o))}
            heads |= {(f"f {f}", 0) for f in (o, *lexicon.forms(o), *near.get(o, ()))}
            if len(o) > 2:  # Fred for Frederick
                heads.add((f"p {o[:3]}", 0 if len(o) < 6 else WHOLE))
        found |= {(f"{u} {k}", mark) for u in {t, *near.get(t, ())} if len(u) > 2 for k, mark in heads}
    return found


def title_keys(tokens: list[str], near: Mapping[str, set[str]], lexicon: Lexicon) -> set[tuple[str, int]]:
    """(key, mark) at which a work's title meets others; ``near`` as for :func:`person_keys`.

    A key is the whole title with up to three tokens corrected; titles that are
    linked don't differ in more.  An abbreviation may stand for a word, so of
    any one or two tokens, and of all abbreviations, the first letter is a key
    with all other tokens.  Titles with more abbreviations than that meet in
    the first letters of all tokens and one other token.
    """
    bare = [t.rstrip(".") for t in tokens]
    short = [i for i, t in enumerate(tokens) if t.endswith(".")]
    lists: list[tuple[int, list[str]]] = [(0, [])]
    for t in bare:
        lists = [(n + (u != t), [*w, u]) for n, w in lists for u in {t, *near.get(t, ())} if n + (u != t) <= 3]
    found = {("t " + " ".join(sorted(w)), PLAIN) for _, w in lists}
    free = [i for i, t in enumerate(bare) if i not in short and len(t) > 2]
    mark = 0 if short else WHOLE
    for _, w in lists:
        for more in ((), *((i,) for i in free), *combinations(free, 2)):
            opened = [*short, *more]
            if len(opened) not in (1, 2):
                continue
            key = f"o {len(opened)} " + " ".join(sorted([u[0] + "*" if i in opened else u for i, u in enumerate(w)]))
            # an opened token must be an abbreviation in one of the two titles
            for order in permutations(opened):
                letters = [w[i][0] for i in order]
                if letters == sorted(letters):
                    found.add((key, sum(1 << n for n, i in enumerate(order) if i in more)))
    if len(short) > 2 or not short:
        first = "".join(sorted(o[0] for o in bare))
        found |= {(f"a {u} {first}", mark) for i, t in enumerate(bare) if i not in short for u in {t, *near.get(t, ())}}
        found.add((f"a {first}", mark))
    return found


# -- over tables ---------------------------------------------------------


def spellings(df: DataFrame, column: str, person: bool, placeholders: frozenset[str] = PLACEHOLDERS, abbreviations: frozenset[str] = ABBREVIATIONS) -> DataFrame:
    """(raw, key, tokens): every distinct spelling with its normalised name; placeholders and empty names have none."""

    def split(name: str) -> list[str] | None:
        return person_tokens(name, placeholders) if person else title_tokens(name, placeholders, abbreviations)

    @F.pandas_udf(ArrayType(StringType()))
    def tokens(names: pd.Series) -> pd.Series:
        return names.map(split)

    raw = df.select(F.col(column).cast("string").alias("raw")).where("raw IS NOT NULL").distinct()
    found = raw.withColumn("tokens", tokens("raw")).where("size(tokens) > 0")
    # the order of a person's tokens isn't known where no comma shows it
    key = F.concat_ws(" ", F.array_sort("tokens") if person else F.col("tokens"))
    return found.select("raw", key.alias("key"), "tokens")


def _counted(tokens: DataFrame, least: float) -> dict[str, int]:
    """Tokens and the names that hold them, of those with enough."""
    return {r.token: r.n for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}


def learned_forms(tokens: DataFrame, counted: Iterable[str], established: Iterable[str]) -> dict[str, set[str]]:
    """Short forms that the data show: tokens that stand with mostly the same surnames as one given name.

    All counts are over counted and established tokens, so what comes back is bounded.
    """
    often = list(established)
    if not often:
        return {}
    given = tokens.where(F.col("token").isin(list(counted)) & (F.length("token") > 1))
    sur = tokens.where(~F.col("token").isin(often) & (F.length("token") > 3))
    stands = written(given.join(sur.select("key", F.col("token").alias("sur")), "key").where("token <> sur").select("token", "sur").distinct(), "stands")
    with_n = stands.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = stands.select("sur").distinct().count()
    both = (
        stands.withColumnRenamed("token", "s").join(stands.where(F.col("token").isin(often)).withColumnRenamed("token", "g"), "sur").where("s <> g")
        .groupBy("s", "g").agg(F.count(F.lit(1)).alias("c"))
        .join(with_n.select(F.col("token").alias("s"), F.col("n").alias("ns")), "s")
        .join(with_n.select(F.col("token").alias("g"), F.col("n").alias("ng")), "g")
    )
    rate = F.col("c") / F.col("ns")
    often_enough = (F.col("c") >= 3) & (rate >= 0.3) | (F.col("c") >= 8) & (rate >= 0.15)
    good = both.where(often_enough & (F.col("ng") > F.col("ns")) & (F.col("c") * total >= 5 * F.col("ns") * F.col("ng")))
    out: dict[str, set[str]] = {}
    for r in good.collect():
        out.setdefault(r.s, set()).add(r.g)
    return out


def neighbours(tokens: DataFrame) -> DataFrame:
    """(t, u) of distinct tokens at an allowed edit distance, both ways, and every token with itself."""

    @F.pandas_udf(ArrayType(StringType()))
    def rest(t: pd.Series) -> pd.Series:
        return t.map(lambda x: sorted(deletes(x, allowed_edits(len(x)))))

    @F.pandas_udf("boolean")
    def near(t: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([edits(a, b, m) <= m for a, b in zip(t, u, strict=True) for m in (most_edits(a, b),)], dtype=bool)

    # many rests come from few bytes: as many tasks as a shuffle has, and one pass for both sides of the join
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = written(tokens.select("t").repartition(parts, "t").select("t", F.explode(rest("t")).alias("d")), "deletes")
    pairs = index.join(index.withColumnRenamed("t", "u"), "d").where("t < u").select("t", "u").distinct().where(near("t", "u"))
    both = F.explode(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u")))).alias("p")
    return pairs.select(both).select("p.t", "p.u").unionByName(tokens.select("t", F.col("t").alias("u")))


@dataclass
class Linked:
    """``names``: (raw, key); ``groups``: (key, entity), a key of several entities having several rows."""

    names: DataFrame
    groups: DataFrame

    def members(self) -> DataFrame:
        """(raw, entity): every spelling with what it names, as long as the input; the pairs grow with the square of a group."""
        return self.names.join(self.groups, "key").select("raw", "entity")

    def pairs(self) -> DataFrame:
        """(name_1, name_2), name_1 < name_2: all spellings of the same entity."""
        of = self.members()
        a, b = of.select("entity", F.col("raw").alias("name_1")), of.select("entity", F.col("raw").alias("name_2"))
        return a.join(b, "entity").where("name_1 < name_2").select("name_1", "name_2").distinct()


def link_names(
    df: DataFrame, column: str, person: bool, short_forms: Mapping[str, Iterable[str]] | None = None, evidence: str | None = None,
    placeholders: frozenset[str] = PLACEHOLDERS, abbreviations: frozenset[str] = ABBREVIATIONS,
) -> Linked:
    """Group the spellings in a column.

    ``short_forms``: short form of a given name -> full forms (a lexicon, not
    data); more are learned.  ``evidence``: a column with what records of the
    same entity share; used for names that could stand for several, for names
    two edits apart and for edits that may as well be another name (which
    without evidence are different names).
    Null, empty and placeholder names name nothing.  Of no rows nothing comes out.
    """
    names = written(spellings(df, column, person, placeholders, abbreviations), "spellings")
    # one token list for a key: where a comma showed the order it is as good as any
    keyed = written(names.groupBy("key").agg(F.min("tokens").alias("tokens")), "keyed")
    tokens = written(keyed.select("key", F.explode(F.array_distinct("tokens")).alias("token")), "tokens")
    n = keyed.count()
    counted = _counted(tokens, max(LEAST_SHORT_FORM, min(SHORT_FORM, ESTABLISHED) * n))
    established = {t: k for t, k in counted.items() if k >= max(LEAST_ESTABLISHED, ESTABLISHED * n)}
    forms: dict[str, set[str]] = {}
    if person:
        forms = learned_forms(tokens, counted, established)
        for s, fulls in (short_forms or {}).items():
            forms.setdefault(folded(s), set()).update(map(folded, fulls))
    lexicon = Lexicon(frozenset(established), {k: frozenset(v) for k, v in forms.items()})
    seen = None
    if evidence:
        seen = written(
            df.select(F.col(column).cast("string").alias("raw"), F.col(evidence).cast("string").alias("e")).where("e IS NOT NULL")
            .join(names.select("raw", "key"), "raw").select("key", "e").distinct(), "evidence",
        )
    links = written(_links(keyed, tokens, lexicon, n, seen, person), "links")
    full = links.where("kind = 'full'").select("a", "b").unionByName(keyed.select(F.col("key").alias("a"), F.col("key").alias("b")))
    if seen is not None:
        far = links.where("kind = 'far'").select("a", "b")
        full = full.unionByName(
            far.join(seen.withColumnRenamed("key", "a"), "a").join(seen.withColumnRenamed("key", "b"), ["b", "e"]).select("a", "b").distinct()
        )
    groups = written(connected_components(full, "a", "b").withColumnsRenamed({"node": "key", "component": "entity"}), "groups")
    if person:
        for kind in ("short", "initial"):
            groups = written(_attached(groups, links.where(F.col("kind") == kind), seen), "groups")
    return Linked(names.select("raw", "key"), groups)


def _links(keyed: DataFrame, tokens: DataFrame, lexicon: Lexicon, n: int, seen: DataFrame | None, person: bool) -> DataFrame:
    """(a, b, kind): all links between normalised names; a stands for b where the kind is 'short' or 'initial'."""
    bare = tokens.select("key", "token", F.rtrim("token", F.lit(".")).alias("t"))
    words = bare.where(~F.col("t").rlike("^[0-9]+$")).select("t").distinct()
    near = written(neighbours(words), "neighbours")
    counts = bare.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    up = near.where("t <> u").join(counts, "t").join(counts.withColumnsRenamed({"t": "u", "n": "m"}), "u").where("m > n OR (m = n AND u > t)").select("t", "u")
    held = written(
        bare.join(counts, "t").join(up, "t", "left").groupBy("key", "t", "n").agg(F.collect_set("u").alias("near"))
        .groupBy("key").agg(F.collect_list(F.struct("t", "n", "near")).alias("held")).join(keyed, "key"), "held",
    )
    of_name = person_keys if person else title_keys

    @F.pandas_udf("array<struct<k: string, mark: int>>")
    def keys(lists: pd.Series, held: pd.Series) -> pd.Series:
        def of(t: list[str], entries: list[dict]) -> list[dict]:
            forms = {e["t"]: {u for u in e["near"] if not (e["t"] in lexicon.established and u in lexicon.established)} for e in entries}
            return [{"k": k, "mark": m} for k, m in sorted(of_name(t, forms, lexicon))]

        return pd.Series([of(list(t), h) for t, h in zip(lists, held, strict=True)], dtype=object)

    placed = held.withColumn("s", F.explode(keys("tokens", "held"))).select(F.col("key").alias("a"), "s.k", "s.mark")
    # words written together or apart: names meet in all their letters but one
    joined = held.select(F.col("key").alias("a"), F.array_join("tokens", "").alias("j")).where(F.length("j") > (6 if person else 8))
    less = F.transform(F.sequence(F.lit(1), F.length("j")), lambda i: F.concat(F.substring("j", F.lit(1), i - 1), F.substr(F.col("j"), i + 1)))
    placed = placed.unionByName(joined.select("a", F.explode(F.array_distinct(F.array_append(less, F.col("j")))).alias("k"), F.lit(PLAIN).alias("mark")))
    if person and seen is not None:
        # given names that no lexicon links: a surname, as written or corrected, and evidence
        whole = held.where(F.size(F.filter("tokens", lambda t: F.length(t) > 1)) > 1).select("key", F.explode("held").alias("h")).where(F.length("h.t") > 4)
        surnames = whole.select("key", F.explode(F.array_union(F.array("h.t"), "h.near")).alias("u"))
        placed = placed.unionByName(surnames.join(seen, "key").select(F.col("key").alias("a"), F.concat_ws(" ", "u", F.lit("e"), "e").alias("k"), F.lit(PLAIN).alias("mark")))
    placed = written(placed.select("a", F.xxhash64("k").alias("k"), "mark"), "keys")  # what meets by chance is told apart by the alignment
    # a name joins those of the marks that it may meet, so that names that may not meet aren't paired at all
    partners = F.when(F.col("mark") == PLAIN, F.array(F.lit(PLAIN))).otherwise(F.filter(F.array(*(F.lit(m) for m in range(4))), lambda m: m.bitwiseAND(F.col("mark")) == 0))
    other = placed.select(F.col("a").alias("b"), "k", F.explode(partners).alias("mark"))
    met = placed.join(other, ["k", "mark"]).where("a < b")
    text = held.select("key", F.concat_ws(" ", "tokens").alias("x"))
    candidates = (
        met.select("a", "b").distinct()
        .join(text.select(F.col("key").alias("a"), F.col("x").alias("ta")), "a")
        .join(text.select(F.col("key").alias("b"), F.col("x").alias("tb")), "b")
    )
    link = person_link if person else title_link

    @F.pandas_udf("string")
    def kind(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([link(a.split(" "), b.split(" "), lexicon) for a, b in zip(x, y, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def doubted(kind: pd.Series, x: pd.Series, y: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        def of(kind: str, a: str, b: str, ca: list[dict], cb: list[dict]) -> str | None:
            return kind if kind == "far" else link(a.split(" "), b.split(" "), lexicon, Usage(n, {e["t"]: e["n"] for e in (*ca, *cb)}))

        return pd.Series([of(*r) for r in zip(kind, x, y, cx, cy, strict=True)], dtype=object)

    @F.pandas_udf("int")
    def rank(x: pd.Series) -> pd.Series:
        # 0: an initial stands for the given name, 1: a short form does, 2: full
        def of(t: list[str]) -> int:
            whole = [w for w in t if len(w) > 1]
            return 0 if len(whole) < 2 and len(t) > 1 else 1 if any(lexicon.forms(w) for w in whole) else 2

        return x.map(lambda s: of(s.split(" "))).astype("int32")

    # of those that link, whether an edit may be another name
    linked = written(candidates.withColumn("kind", kind("ta", "tb")).where("kind IS NOT NULL"), "linked")
    used = held.select("key", F.transform("held", lambda h: F.struct(h["t"].alias("t"), h["n"].alias("n"))).alias("c"))
    found = (
        linked.join(used.select(F.col("key").alias("a"), F.col("c").alias("ca")), "a").join(used.select(F.col("key").alias("b"), F.col("c").alias("cb")), "b")
        .withColumn("kind", doubted("kind", "ta", "tb", "ca", "cb")).drop("ca", "cb")
    )
    if not person:
        return found.select("a", "b", "kind")
    ranked = found.withColumn("ra", rank("ta")).withColumn("rb", rank("tb"))
    longer = (F.col("ra") == F.col("rb")) & (F.length("ta") > F.length("tb"))
    turn = (F.col("ra") > F.col("rb")) | longer
    # two names that both hold a short form, or both an initial, are as good as each other
    level = (F.col("ra") == F.col("rb")) & (F.col("kind") != "far")
    return ranked.select(
        F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(level & (F.col("ra") < 2), "full").otherwise(F.col("kind")).alias("kind"),
    )


def _attached(groups: DataFrame, links: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Groups after names with short forms or initials have joined those they stand for."""
    of = groups.select("key", "entity")
    reach = written(
        links.join(of.select(F.col("key").alias("a"), F.col("entity").alias("ea")), "a")
        .join(of.select(F.col("key").alias("b"), F.col("entity").alias("eb")), "b")
        .where("ea <> eb").select("ea", "eb").distinct(), "reach",
    )
    n = reach.groupBy("ea").agg(F.count(F.lit(1)).alias("n"))
    single = reach.join(n.where("n = 1"), "ea").select("ea", "eb")
    several = reach.join(n.where("n > 1"), "ea").select("ea", "eb")
    again = of.limit(0).select("key", "entity")
    if seen is not None:
        held = of.join(seen, "key").select("entity", "e").distinct()
        shown = (
            several.join(held.withColumnsRenamed({"entity": "ea"}), "ea")
            .join(held.withColumnsRenamed({"entity": "eb"}), ["eb", "e"]).select("ea", "eb").distinct()
        )
        shown = written(shown, "shown")
        k = shown.groupBy("ea").agg(F.count(F.lit(1)).alias("k"))
        single = single.unionByName(shown.join(k.where("k = 1"), "ea").select("ea", "eb"))
        # a name that was used for several belongs to each of them, and doesn't join them to each other
        many = shown.join(k.where("k > 1"), "ea").select("ea", "eb")
        again = of.join(many, of["entity"] == many["ea"]).select("key", F.col("eb").alias("entity"))
    edges = single.unionByName(of.select(F.col("entity").alias("ea"), F.col("entity").alias("eb")))
    root = written(connected_components(edges, "ea", "eb"), "roots")
    joined = of.unionByName(again).join(root, F.col("entity") == F.col("node")).select("key", F.col("component").alias("entity"))
    return joined.distinct()
