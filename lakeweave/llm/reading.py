"""Reading level of every document by a Rasch-style latent difficulty model.

A document has a level, a word a difficulty and a base rate, on one scale per
language: the log rate at which a document of level x uses a word of base b and
difficulty d is b + d * x less a term of the document alone.  As in Rasch's
model a document's level depends on its words only through one sum, that of
their difficulties.  Levels and difficulties are estimated in turn: all
documents take their levels from the words' parameters (one distributed pass
over the counts), then the words take theirs from how often documents of each
level use them (counts by word and level bin, summed over the cluster).
Documents that raters have labelled fix the scale: an ordered logistic curve
per boundary between levels turns the latent level into the raters' scale.

Words are taken from a page's articles only.  Headings and running titles are
lines mostly in capitals; adverts are told by a model that is fitted to the
corpus itself and knows no words beforehand: short lines in capitals that
recur on many pages head adverts, so the lines that follow them show how
adverts are worded, and lines far from any such headline how articles are.
Words broken at line ends are joined, and misread words are traced to the word
of the vocabulary with the same letter shapes.  Words that are too rare for the
vocabulary count as well: those of one length share a difficulty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.plans.scratch import dropped, written

#: A word is in the vocabulary of a language if this share of its documents (and at least LEAST_DOCS) hold it; so the
#: vocabulary has at most (words of a document) / SHARE entries, whatever the size of the corpus.
SHARE, LEAST_DOCS = 0.002, 4
#: A language has a scale if this share of the documents (and at least LEAST_DOCS) are said to be in it: so at most 1 / share.
LANG_SHARE = 0.002
#: Labelled documents used at most to fix the scale.
MAX_LABELLED = 200_000
#: Rounds of the alternation at most; it ends before if the difficulties change by less than this share of their spread.
ROUNDS, SETTLED = 12, 0.03
#: The model of lines has a word or pair of its own if it is found so often, by the number of pages (and at least LEAST_FORMS
#: times), right below headlines; so it has a bound whatever the size of the corpus.  The others count together.
FORM_SHARE, LEAST_FORMS = 0.0005, 3
#: Pages of which the lines are read together, and letters of pages that are taken apart into lines together.
TOGETHER, TOGETHER_LETTERS = 1_000, 1_000_000
#: A line in capitals heads adverts if this share of the pages (and at least LEAST_HEADLINES) hold it below their first line.
HEADLINE_SHARE, LEAST_HEADLINES = 0.005, 8
#: A line in capitals with more words is text.
HEADING_WORDS = 5
#: Log odds from which the words of a line alone show that it is an advert.
SURE = 2.0
#: Lines below a headline or telling line that are read one by one; after that many, all lines that remain are read at once.
STEPS = 6
#: Lines below a headline that are taken for an advert while the model is fitted, and those that aren't taken for an article.
BELOW_HEADLINE, NEAR_HEADLINE = 2, 5
GRID = np.linspace(-5, 5, 101)
_EDGE = GRID[1] - GRID[0]

_BREAKS = ("-", "\xad", "\xac", "=")
_TOKEN = re.compile(r"[^\W_]+").findall
_LOWER = re.compile(r"[^\W\d_A-Z\xc0-\xde]{2}").search
_CAPITALS = re.compile(r"[A-Z\xc0-\xde]{3}").search
# Signs and digits that are misread letters.
_DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "\u017f": "s"})
_SIGNS = str.maketrans({"\u2020": "t"})
# Letters that are misread for each other share a shape; pairs of letters that look like one go first.
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("fi", "h"), ("ri", "n"), ("nn", "m"))
_SHAPES = str.maketrans({"e": "c", "b": "h", "n": "u", "i": "l", "f": "s", "t": "l", "j": "l", "q": "g", "\xfc": "u", "\xf6": "o", "\xe4": "a", "\xe9": "c", "\xe8": "c", "\xea": "c", "\xe0": "a", "\xe2": "a", "\xe7": "c", "\xdf": "h"})


def shape(word: str) -> str:
    """What is left of a word if misreadings are allowed for."""
    for two, one in _PAIRS:
        word = word.replace(two, one)
    return word.translate(_SHAPES)


class _Forms(dict):
    """Token as read -> (word, what it is for the model of lines: a number with its unit, or a shape)."""

    def __missing__(self, token: str) -> tuple[str, str]:
        word = token.translate(_DIGITS)
        found = word, "0" + token.lstrip("0123456789") if token[0].isdigit() else shape(word)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


_FORMS = _Forms()


def is_heading(line: str) -> bool:
    """Whether a line is mostly in capitals and short."""
    if _LOWER(line):
        if not _CAPITALS(line) or 2 * sum(map(str.isupper, line)) <= sum(map(str.isalpha, line)):
            return False
    return len([w for w in _TOKEN(line) if len(w) > 1 and w.isalpha()]) <= HEADING_WORDS


def headline(line: str) -> str:
    """What headlines are compared by: shapes of their words."""
    return " ".join(shape(w.translate(_DIGITS)) if w[0].isdigit() else _FORMS[w][1] for w in _TOKEN(line.lower().translate(_SIGNS)))


def line_features(forms: list[str]) -> list[str]:
    """Words and pairs of neighbouring words of a line, by their forms for the model."""
    return [*forms, *map(" ".join, zip(["^", *forms], [*forms, "$"], strict=True))]


@dataclass
class LineModel:
    """Tells adverts from articles, line by line.

    ``weights``: log odds of words and pairs for an advert, ``other``: of all
    those not listed; ``prior``: log odds that a line is one, after a headline,
    after a line of an advert, and elsewhere.
    """

    headlines: frozenset[str] = frozenset()
    weights: dict[str, float] | None = None
    other: float = 0.0
    prior: tuple[float, float, float] = (3.0, 0.0, -7.0)


class _Kinds:
    """What characters are, by their code; found out as they occur."""

    WORD, LOWER, CAPITAL, KNOWN = 1, 2, 4, 8

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if not found.all():
            for c in np.unique(codes[found == 0]).tolist():
                x = chr(c)
                self.table[c] = self.KNOWN | self.WORD * bool(_TOKEN(x)) | self.LOWER * bool(_LOWER(x + x)) | self.CAPITAL * bool(_CAPITALS(x * 3))
            found = self.table[codes]
        return found


_KINDS = _Kinds()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _token_lines(text: str) -> list[str]:
    """The tokens of each line, blank-separated."""
    codes = _codes(text)
    word = (_KINDS.of(codes) & _Kinds.WORD) > 0
    kept = np.flatnonzero(word | (codes == 10))
    word = word[kept]
    apart = (np.diff(kept) > 1) & word[1:] & word[:-1]  # two tokens of a line
    at = np.arange(len(kept))
    at[1:] += np.cumsum(apart)
    out = np.full(at[-1] + 1 if len(at) else 0, 32, np.uint32)
    out[at] = codes[kept]
    return out.tobytes().decode("utf-32-le", "surrogatepass").split("\n")


def _maybe_headings(text: str) -> np.ndarray:
    """Of each line whether it may be a heading: it has no two letters in lower case or it has three capitals, side by side."""
    codes = _codes(text + "\n")
    kinds = _KINDS.of(codes)
    ends = np.flatnonzero(codes == 10)
    begins = np.append(0, ends[:-1] + 1)
    lower, capital = (kinds & _Kinds.LOWER) > 0, (kinds & _Kinds.CAPITAL) > 0
    lower[:-1] &= lower[1:]
    capital[:-1] &= capital[1:]
    capital[:-1] &= capital[1:]
    return ~np.logical_or.reduceat(lower, begins) | np.logical_or.reduceat(capital, begins)


def _lines_of_pages(texts: list[str]) -> list[str | None]:
    """:func:`page_lines` of several texts at once."""
    text = "\n".join(texts)
    low = text.lower()
    for sign, letter in _SIGNS.items():
        low = low.replace(chr(sign), letter)
    lines = []
    for raw, tokens, maybe in zip(text.split("\n"), _token_lines(low), _maybe_headings(text).tolist(), strict=True):
        if maybe and tokens and is_heading(raw):
            lines.append("#" + headline(raw))
        else:
            lines.append("-" + tokens if tokens and raw.rstrip()[-1:] in _BREAKS else tokens)
    out, begin = [], 0
    for t in texts:
        end = begin + t.count("\n") + 1
        out.append("\n".join(filter(None, lines[begin:end])) or None)
        begin = end
    return out


def _pieces(text: str) -> Iterator[str]:
    """A long text, cut between lines."""
    begin = 0
    while len(text) - begin > TOGETHER_LETTERS and (cut := text.find("\n", begin + TOGETHER_LETTERS)) >= 0:
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


def pages_lines(texts: list[str | None]) -> list[str | None]:
    """:func:`page_lines` of every text."""
    out: list[str | None] = [None] * len(texts)
    some, size = [], 0
    for i, t in enumerate(texts):
        if t and len(t) > TOGETHER_LETTERS:
            out[i] = "\n".join(page for piece in _pieces(t) for page in _lines_of_pages([piece]) if page) or None
        elif t:
            some.append(i)
            size += len(t)
        if some and (size > TOGETHER_LETTERS or i == len(texts) - 1):
            for k, page in zip(some, _lines_of_pages([texts[k] for k in some]), strict=True):
                out[k] = page
            some, size = [], 0
    return out


def page_lines(text: str | None) -> str | None:
    """A page's lines that aren't blank as tokens in lower case, blank-separated.

    Headings are "#" and what headlines are compared by; "-" begins a line that
    ends in a broken word.
    """
    return pages_lines([text])[0]


def _split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of every blank-separated word of the texts, what the codes stand for, offsets of the texts)."""
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), split.offsets.to_numpy() - split.offsets[0].as_py()


class _PageLines:
    """The lines of several pages of :func:`page_lines`, one after the other, as arrays."""

    def __init__(self, pages: pa.Array):
        split = pc.split_pattern(pages, "\n")
        self.offsets = split.offsets.to_numpy()
        lines = split.flatten()
        self.lines, self.first = lines, np.zeros(len(lines), bool)
        self.first[self.offsets[:-1]] = True
        self.head = pc.starts_with(lines, "#").to_numpy(zero_copy_only=False)
        self.text = np.flatnonzero(~self.head)
        self.heads = np.flatnonzero(self.head)
        self.headlines = [h[1:] for h in lines.take(pa.array(self.heads)).to_pylist()]

    def leading(self, headlines: frozenset[str]) -> np.ndarray:
        """Whether each line is one of ``headlines``."""
        out = np.zeros(len(self.head), bool)
        out[self.heads] = [h in headlines for h in self.headlines]
        return out

    def since(self, headlines: frozenset[str]) -> np.ndarray:
        """Of each line of text, in the order of ``text``: lines since the last of ``headlines``, more than NEAR_HEADLINE without one."""
        at, count = np.arange(len(self.head)), np.cumsum(~self.head)
        lead = self.leading(headlines)
        last = np.maximum.accumulate(np.where(lead | self.first, at, 0))
        # a page begins far from any headline, also if its first line is text, which counts itself
        begun = np.where(lead[last], count[last], count[last] - ~self.head[last] - NEAR_HEADLINE)
        return (count - begun)[self.text]

    def tokens(self, lines: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """:func:`_split_words` of the given lines of text."""
        return _split_words(pc.utf8_ltrim(self.lines.take(pa.array(lines)), "-"))


def _tables(pages: pa.Array) -> Iterator[_PageLines]:
    """The pages, some at a time; nulls are left out."""
    pages = pages.drop_null()
    for k in range(0, len(pages), TOGETHER):
        yield _PageLines(pages[k : k + TOGETHER])


class _Numbers(dict):
    """Token -> number of its form, 0 for a form that ``words`` doesn't have."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        found = self.words.get(_FORMS[token][1], 0)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found

    def __reduce__(self):
        return _Numbers, (self.words,)


class _Features:
    """Numbers of words and pairs: 1 on for ``kinds`` in order, 0 for all others."""

    def __init__(self, kinds: list[str]):
        parts = [k.split(" ") for k in kinds]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(["^", "$", *(w for p in parts for w in p)]), 1)}
        self.base = len(self.words) + 1
        self.single = np.zeros(self.base, np.int64)
        pairs = []
        for i, p in enumerate(parts, 1):
            if len(p) == 1:
                self.single[self.words[p[0]]] = i
            else:
                pairs.append((self.words[p[0]] * self.base + self.words[p[1]], i))
        self.keys, self.pair = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.numbers = _Numbers(self.words)

    def ids(self, table: _PageLines, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of every token of the given lines of text, offsets of the lines)."""
        codes, names, offsets = table.tokens(lines)
        return np.array([*map(self.numbers.__getitem__, names)] or [0], np.int64)[codes], offsets

    def _pairs(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of every pair of neighbours, line by line, also of those of two lines; and which are of one line."""
        at = np.arange(len(offsets) - 1)
        begin, end = offsets[:-1] + 2 * at, offsets[1:] + 2 * at + 1
        framed, inner = np.empty(len(ids) + 2 * len(at), np.int64), np.ones(len(ids) + 2 * len(at), bool)
        framed[begin], framed[end] = self.words["^"], self.words["$"]
        inner[begin] = inner[end] = False
        framed[inner] = ids
        left, right = framed[:-1], framed[1:]
        within = np.ones(len(left), bool)
        within[end[:-1]] = False
        number = np.zeros(len(left), np.int64)
        if len(self.keys):
            known = np.flatnonzero((left > 0) & (right > 0) & within)
            key = left[known] * self.base + right[known]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            number[known] = np.where(self.keys[place] == key, self.pair[place], 0)
        return number, within

    def counts(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How often each number is among the words and pairs of the lines."""
        if len(offsets) < 2:
            return np.zeros(1, np.int64)
        number, within = self._pairs(ids, offsets)
        size = max(self.single.max(), number.max(), 0) + 1
        n = np.bincount(number, minlength=size) + np.bincount(self.single[ids], minlength=size)
        n[0] -= np.count_nonzero(~within)
        return n

    def sums(self, ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of the words and pairs of each line."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        if not n:
            return np.zeros(0)
        number, within = self._pairs(ids, offsets)
        line = np.concatenate([np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), sizes + 1)])
        return np.bincount(line, weights[np.concatenate([self.single[ids], number[within]])], n)


def _some_lines(ids: np.ndarray, offsets: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and offsets of some of the lines."""
    sizes = np.diff(offsets)[lines]
    begin = np.append(0, np.cumsum(sizes))
    return ids[np.arange(begin[-1]) + np.repeat(offsets[lines] - begin[:-1], sizes)], begin


class _Reader:
    """A model at work on many lines at once."""

    def __init__(self, model: LineModel):
        self.model = model
        kinds = [k for k in model.weights or {} if k != "\n"]
        self.features = _Features(kinds)
        self.weights = np.array([model.other, *(model.weights[k] for k in kinds)])
        # elsewhere only a line with a telling word can be an advert
        self.telling = np.array([False, *(model.weights[k] > 2 and " " not in k for k in kinds)])[self.features.single]

    def read(self, table: _PageLines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it is an advert, what is before it, log odds by its words) of each line of text.

        Before it: 0 a headline, 1 a line of an advert, 2 anything else.  Pairs repeat what words say, so both count by half.
        The odds are nan for lines that can't be adverts whatever they are: without a telling word and not below a headline or an advert.
        """
        m, n = self.model, len(table.text)
        before, odds = np.full(n, 2), np.full(n, np.nan)
        if not m.weights:
            return np.zeros(n, bool), before, np.zeros(n)
        ids, offsets = self.features.ids(table, table.text)
        telling = np.zeros(n, bool)
        telling[np.searchsorted(offsets, np.flatnonzero(self.telling[ids]), "right") - 1] = True
        lead = table.leading(m.headlines)
        inside = ~table.first[table.text]
        before[inside & lead[table.text - 1]] = 0
        follows = inside & ~table.head[table.text - 1]  # the line before is text
        lines = np.flatnonzero((before == 0) | telling)
        for step in range(STEPS + 1):
            odds[lines] = self.features.sums(*_some_lines(ids, offsets, lines), self.weights) / 2
            if not len(lines) or step == STEPS:
                break
            advert = np.where(before == 0, m.prior[0] + odds > 0, telling & (m.prior[2] + odds > 0))
            after = m.prior[1] + odds > 0
            maybe = np.zeros(n, bool)  # the line before may be an advert
            maybe[1:] = (advert | after)[:-1]
            lines = np.flatnonzero(np.isnan(odds) & follows & (maybe if step < STEPS - 1 else True))
        advert = np.where(before == 0, m.prior[0] + odds > 0, telling & (m.prior[2] + odds > 0))
        after = m.prior[1] + odds > 0
        for i in np.flatnonzero(follows & (advert | after)).tolist():
            if advert[i - 1]:
                before[i], advert[i] = 1, after[i]
        before[1:][follows[1:] & advert[:-1]] = 1
        return advert, before, odds


def _article_texts(pages: pa.Array, reader: _Reader) -> list[str]:
    """The words of each page's articles, blank-separated; see :func:`article_words`."""
    table = _PageLines(pages)
    kept = np.zeros(len(table.head), bool)
    kept[table.text] = ~reader.read(table)[0]
    # signs and digits that are misread letters
    lines = pages.to_pylist()
    out = []
    for page, begin, end in zip(lines, table.offsets[:-1].tolist(), table.offsets[1:].tolist(), strict=True):
        own = page.replace("0", "o").replace("1", "l").replace("5", "s").replace("ſ", "s").split("\n")
        keep = kept[begin:end]
        if not keep.all():
            own = [x for x, k in zip(own, keep.tolist(), strict=True) if k]
        words, skip = [], False  # skip: the first word of this line went to the line before
        for i, x in enumerate(own):
            if not skip and x[0] != "-":
                words.append(x)
                continue
            broken = x[0] == "-"
            parts = (x[1:] if broken else x).split(" ")[1 if skip else 0 :]
            skip = broken and bool(parts)
            if skip:
                tails = [y.lstrip("-").split(" ", 1)[0] for y in own[i + 1 : i + 3]]
                parts[-1] = "|".join([parts[-1], *tails, "", ""][:3])
            words += parts
        out.append(" ".join(words))
    return out


def article_words(text: str | None, model: LineModel) -> list[str]:
    """Lower-case words of a page's articles; "head|tail|tail" for a word broken at a line end and the two next lines."""
    page = page_lines(text)
    return _article_texts(pa.array([page], pa.string()), _Reader(model))[0].split() if page else []


def lines_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, page): :func:`page_lines` of every document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page = pa.array(pages_lines(b.column(2).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], page], names=["doc_id", "lang", "page"]).filter(page.is_valid())

    return (
        docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(run, "doc_id long, lang string, page string")
    )


def _summed(pages: DataFrame, of) -> DataFrame:
    """(k, n): what ``of`` counts in tables of pages, summed over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])
            total.clear()
            return rows

        for b in batches:
            for table in _tables(b.column(0)):
                total.update(of(table))
                if len(total) > 200_000:
                    yield out()
        yield out()

    return pages.mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))


def fit_lines(docs: DataFrame, pages: int | None = None) -> LineModel:
    """The model of advert lines, fitted to all pages; ``pages``: for trials, to about so many, drawn by a hash of their text."""
    if pages is not None:
        share, whole = min(1.0, pages / max(docs.where("text IS NOT NULL").count(), 1)), 1 << 60
        docs = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(whole)) < F.lit(int(share * whole)))
    return fit_page_lines(lines_table(docs))


def fit_page_lines(lines: DataFrame) -> LineModel:
    """The model of advert lines, fitted to all pages of :func:`lines_table`.

    What comes back has a bound: headlines by their share of the pages, words
    and pairs by those of the lines right below headlines.  Some of these are
    of articles, which leaves their words far less usual there than elsewhere.  Headlines of which
    the lines below read like articles (sections of a paper) are dropped and
    the model is fitted again.  Without headlines no line is an advert.
    """
    # copies of one page don't make its headings recur
    pages = written(lines.select("page").distinct(), "line-pages")

    def heads(table: _PageLines) -> Counter:
        whose = np.searchsorted(table.offsets, table.heads, "right")
        below = ~table.first[table.heads]
        found = {(p, h) for p, h, b in zip(whose.tolist(), table.headlines, below.tolist(), strict=True) if b and len(h) > 2}
        return Counter({"": len(table.offsets) - 1}) + Counter(h for _, h in found)

    counted = written(_summed(pages, heads), "headlines")
    total = (counted.where("k = ''").agg(F.sum("n")).first()[0]) or 0
    least = max(LEAST_HEADLINES, HEADLINE_SHARE * total)
    names = frozenset(r.k for r in counted.where(F.col("n") >= least).where("k <> ''").collect())
    model, fitted = LineModel(names), None
    for _ in range(2):
        if not model.headlines:
            break
        if fitted != model.headlines:  # the weights depend on nothing else
            fitted = model.headlines
            weights = _line_weights(pages, fitted, max(LEAST_FORMS, FORM_SHARE * total))
        model = _line_round(pages, LineModel(fitted, weights, weights["\n"], model.prior))
    dropped(pages)
    dropped(counted)
    return model


def _line_weights(pages: DataFrame, headlines: frozenset[str], least: float) -> dict[str, float]:
    """Weights of words and pairs, from the lines that are adverts by their place.

    Words and pairs that are found fewer than ``least`` times right below headlines count together.
    """

    def below(table: _PageLines) -> Counter:
        """Words and pairs of lines right below headlines; "\\n": all of them."""
        n: Counter = Counter()
        lines = table.text[table.since(headlines) <= BELOW_HEADLINE]
        for line in table.lines.take(pa.array(lines)).to_pylist():
            n.update(line_features([_FORMS[t][1] for t in line.lstrip("-").split(" ")]))
        n["\n"] = n.total()
        return n

    plus = {r.k: r.n for r in _summed(pages, below).where((F.col("n") >= least) | (F.col("k") == "\n")).collect()}
    every = plus.pop("\n", 0)
    seen = sorted(plus)
    kinds = [*seen, "\n"]
    plus["\n"] = every - sum(plus.values())
    features = _Features(seen)

    def far(table: _PageLines) -> Counter:
        """Words and pairs of lines far from any headline."""
        lines = table.text[table.since(headlines) > NEAR_HEADLINE]
        n = features.counts(*features.ids(table, lines))
        return Counter({kinds[i - 1]: int(n[i]) for i in np.flatnonzero(n)})  # 0 is the last one

    minus = {r.k: r.n for r in _summed(pages, far).collect()}
    all_plus, all_minus = every + len(kinds), sum(minus.values()) + len(kinds)
    return {k: math.log((plus[k] + 1) / all_plus * all_minus / (minus.get(k, 0) + 1)) for k in kinds}


def _line_round(pages: DataFrame, model: LineModel) -> LineModel:
    """Headlines and priors by what the model says of all lines."""
    reader = _Reader(model)

    def read(table: _PageLines) -> Counter:
        """What the model says of lines, by what comes before them."""
        advert, before, odds = reader.read(table)
        n = Counter({f"{k // 2}{k % 2}": v for k, v in enumerate(np.bincount(2 * before + advert).tolist()) if v})
        above = dict(zip(table.heads.tolist(), table.headlines, strict=True))
        for i in np.flatnonzero(before == 0).tolist():  # whether the words alone tell it
            n[f"h{odds[i] > SURE:d}{above[table.text[i] - 1]}"] += 1
        return n

    said = {r.k: r.n for r in _summed(pages, read).collect()}  # at most two for each headline
    leads = frozenset(h for h in model.headlines if said.get("h1" + h, 0) > said.get("h0" + h, 0))
    prior = tuple(math.log((said.get(f"{b}1", 0) + 0.5) / (said.get(f"{b}0", 0) + 0.5)) for b in (0, 1, 2))
    return LineModel(leads, model.weights, model.other, prior)


def article_table(lines: DataFrame, model: LineModel) -> DataFrame:
    """(doc_id, lang, words): the article words, blank-separated, of every page of :func:`lines_table` with an article."""
    shared = lines.sparkSession.sparkContext.broadcast(model)  # bounded by HEADLINE_SHARE and FORM_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                text = pa.array([t or None for t in _article_texts(part.column(2), reader)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], text], names=["doc_id", "lang", "words"]).filter(text.is_valid())

    return lines.mapInArrow(run, "doc_id long, lang string, words string")


#: Rare words are told apart by their length up to this.
LONGEST = 20


def length_class(word: str) -> str:
    """What stands for a rare word in the vocabulary; no word looks like that."""
    return f"|{min(len(word), LONGEST)}"


@dataclass
class Vocabulary:
    """Words of all languages; ``lang`` is the index of a word's language.

    Every language also has an entry for the rare words of each length.
    """

    langs: list[str]
    words: list[str]
    lang: np.ndarray
    df: np.ndarray

    def lookup(self) -> tuple[dict[str, list[int]], dict[str, str]]:
        """word -> its entries; shape -> its most frequent word."""
        index: dict[str, list[int]] = {}
        shapes: dict[str, str] = {}
        for i in np.argsort(-self.df, kind="stable"):
            w = self.words[i]
            index.setdefault(w, []).append(int(i))
            if len(w) > 2 and w[0] != "|":
                shapes.setdefault(shape(w), w)
        return index, shapes


def fit_vocabulary(articles: DataFrame) -> Vocabulary:
    """Frequent words by stated language; documents without a language don't count here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, w, v) for k, n in by_lang.items() for w, v in n.items()]
            by_lang.clear()
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate(kinds)], names=["lang", "word", "n"])

        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                codes, names, offsets = _split_words(part.column(1))
                coded, size = part.column(0).dictionary_encode(), len(names)
                lang = coded.indices.to_numpy()
                held = np.unique(np.repeat(np.arange(part.num_rows), np.diff(offsets)) * size + codes)  # once for each document
                pairs, n = np.unique(lang[held // size].astype(np.int64) * size + held % size, return_counts=True)
                langs, docs = coded.dictionary.to_pylist(), np.bincount(lang).tolist()
                for x, v in zip(langs, docs, strict=True):
                    by_lang.setdefault(x, Counter())[""] += v
                for p, v in zip(pairs.tolist(), n.tolist(), strict=True):
                    w = names[p % size]
                    if "|" not in w:
                        by_lang[langs[p // size]][w] += v
                if sum(map(len, by_lang.values())) > 500_000:
                    yield out()
        yield out()

    table = (
        articles.where("lang IS NOT NULL").select("lang", "words")
        .mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_DOCS)
    )
    table = written(table, "vocabulary")
    heads = table.where("word = ''")
    enough = LANG_SHARE * (heads.agg(F.sum("n")).first()[0] or 0)
    totals = {r.lang: r.n for r in heads.where(F.col("n") >= enough).collect()}
    least = F.create_map(*(F.lit(x) for k, v in totals.items() for x in (k, max(LEAST_DOCS, SHARE * v)))) if totals else None
    rows = (
        table.where(F.col("lang").isin(*totals)).where(F.col("n") >= least[F.col("lang")]).where("word <> ''").orderBy("lang", "word").collect() if totals else []
    )
    langs = sorted(totals)
    # a word that is far more usual in another language is foreign matter here
    rate = {}
    for r in rows:
        rate.setdefault(r.word, {})[r.lang] = r.n / totals[r.lang]
    rows = [r for r in rows if r.n / totals[r.lang] >= 0.2 * max(rate[r.word].values())]
    if not rows:
        return Vocabulary(langs, [], np.zeros(0, np.int64), np.zeros(0))
    rare = [length_class("x" * k) for k in range(1, LONGEST + 1)]
    return Vocabulary(
        langs, [r.word for r in rows] + rare * len(langs), np.array([langs.index(r.lang) for r in rows] + [k for k in range(len(langs)) for _ in rare], np.int64),
        np.array([r.n / totals[r.lang] for r in rows] + [SHARE] * len(rare) * len(langs)),
    )


_COUNTS = "doc_id long, lang int, n int, at array<int>, times array<int>"


class _Entries(dict):
    """word -> row of ``table``, which has the word's entry in each language; ``known`` tells in which it is a word of the vocabulary.

    Where it isn't, its entry is that of the rare words of its length.
    """

    def __init__(self, voc: Vocabulary):
        super().__init__()
        self.index, self.shapes = voc.lookup()
        table = np.full((len(self.index), len(voc.langs)), -1, np.int64)
        self.rows = {w: k for k, w in enumerate(self.index)}
        for w, entries in self.index.items():
            for e in entries:
                table[self.rows[w], voc.lang[e]] = e
        self.known = (table >= 0) & np.array([w[0] != "|" for w in self.rows], bool)[:, None]
        rare = np.array([self.rows[length_class(w) if w[0] != "|" else w] for w in self.rows], np.int64)
        self.table = np.where(table >= 0, table, table[rare])

    def _row(self, word: str) -> int | None:
        row = self.rows.get(word)
        return row if row is not None or len(word) < 3 else self.rows.get(self.shapes.get(shape(word), ""))

    def __missing__(self, word: str) -> int:
        if "|" in word:
            head, a, b = word.split("|")
            found = [self._row(head + a), self._row(head + b), self._row(a)]
            whole = head + a
        else:
            found, whole = [self._row(word)], word
        row = next((r for r in found if r is not None), None)
        if row is None:
            row = self.rows[length_class(whole)]
        if len(self) > 500_000:
            self.clear()
        self[word] = row
        return row


def count_words(articles: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, lang, n, at, times): vocabulary entries of each document, in the language that its words are of; no word is left out."""
    shared = articles.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Entries(shared.value)
        langs, size = entries.table.shape[1], len(shared.value.words)
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                codes, names, offsets = _split_words(part.column(1))
                rows = np.array([*map(entries.__getitem__, names)], np.int64)[codes]
                n, docs = np.diff(offsets), np.repeat(np.arange(part.num_rows), np.diff(offsets))
                known = np.stack([np.bincount(docs, entries.known[rows, j], part.num_rows) for j in range(langs)])
                lang = known.argmax(axis=0)
                found, times = np.unique(docs * size + entries.table[rows, lang[docs]], return_counts=True)
                off = pa.array(np.searchsorted(found, np.arange(part.num_rows + 1) * size), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.int32()), pa.array(n, pa.int32()),
                     pa.ListArray.from_arrays(off, pa.array(found % size, pa.int32())), pa.ListArray.from_arrays(off, pa.array(times, pa.int32()))],
                    names=["doc_id", "lang", "n", "at", "times"],
                )

    return articles.select("doc_id", "words").mapInArrow(run, _COUNTS)


@dataclass
class Difficulty:
    """Base rate and difficulty of every vocabulary entry."""

    lang: np.ndarray
    base: np.ndarray
    hard: np.ndarray

    def expected(self) -> np.ndarray:
        """Mean difficulty of the words of a document, by language and level of GRID."""
        out = np.zeros((int(self.lang.max()) + 1, len(GRID)))
        for k in range(len(out)):
            own = self.lang == k
            if own.any():
                x = self.base[own, None] + self.hard[own, None] * GRID[None, :]
                p = np.exp(x - x.max(axis=0))
                out[k] = (p * self.hard[own, None]).sum(axis=0) / p.sum(axis=0)
        return out

    def levels(self, lang: np.ndarray, n: np.ndarray, total: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """Most likely level of documents with ``n`` words of summed difficulty ``total``, under a standard normal prior."""
        lo, hi = np.full(len(n), GRID[0]), np.full(len(n), GRID[-1])
        for _ in range(18):
            mid = (lo + hi) / 2
            x = (mid - GRID[0]) / _EDGE
            i = np.clip(x.astype(int), 0, len(GRID) - 2)
            m = expected[lang, i] + (expected[lang, i + 1] - expected[lang, i]) * (x - i)
            up = total - n * m - mid > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        return (lo + hi) / 2


def _document_pass(counts: DataFrame, model: Difficulty, size: int) -> DataFrame:
    """(k, n): summed counts; k = entry * bins + bin of the documents' levels."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    bins = len(GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        expected, total = m.expected(), np.zeros(size * bins, np.int64)
        for b in batches:
            if b.num_rows:
                at, times, level = _levels_of(b, m, expected)
                where = np.clip(np.rint((level - GRID[0]) / _EDGE).astype(np.int64), 0, bins - 1)
                total += np.bincount(at * bins + np.repeat(where, _sizes(b)), times, len(total)).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    return counts.select("lang", "n", "at", "times").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _sizes(b: pa.RecordBatch) -> np.ndarray:
    return np.diff(b.column("at").offsets.to_numpy())


def _levels_of(b: pa.RecordBatch, m: Difficulty, expected: np.ndarray):
    at = b.column("at").flatten().to_numpy().astype(np.int64)
    times = b.column("times").flatten().to_numpy().astype(np.int64)
    sizes = _sizes(b)
    total = np.bincount(np.repeat(np.arange(b.num_rows), sizes), m.hard[at] * times, b.num_rows)
    level = m.levels(b.column("lang").to_numpy().astype(np.int64), b.column("n").to_numpy().astype(float), total, expected)
    return at, times, level


def _word_step(y: np.ndarray, model: Difficulty) -> Difficulty:
    """Parameters of all words from their counts by level bin, with the levels brought to mean 0 and deviation 1 per language."""
    base, hard = model.base.copy(), model.hard.copy()
    for k in np.unique(model.lang):
        own = np.flatnonzero(model.lang == k)
        c = y[own].astype(float)
        by_bin = c.sum(axis=0)
        if by_bin.sum() == 0:
            continue
        mean = (by_bin * GRID).sum() / by_bin.sum()
        dev = max(1e-3, np.sqrt((by_bin * (GRID - mean) ** 2).sum() / by_bin.sum()))
        x = (GRID - mean) / dev
        b = np.log((c.sum(axis=1) + 0.5) / by_bin.sum())
        d = np.zeros(len(own))
        for _ in range(60):
            eta = b[:, None] + d[:, None] * x[None, :]
            mu = np.exp(eta - np.log(np.exp(eta).sum(axis=0))) * by_bin
            gb, gd = (c - mu).sum(axis=1), ((c - mu) * x).sum(axis=1) - d
            hbb, hbd, hdd = mu.sum(axis=1) + 1e-6, (mu * x).sum(axis=1), (mu * x * x).sum(axis=1) + 1
            det = hbb * hdd - hbd**2 + 1e-9
            step_b, step_d = (hdd * gb - hbd * gd) / det, (hbb * gd - hbd * gb) / det
            b, d = b + np.clip(step_b, -1, 1) * 0.9, d + np.clip(step_d, -1, 1) * 0.9
            if np.abs(step_d).max() < 1e-4:
                break
        base[own], hard[own] = b, d
    return Difficulty(model.lang, base, hard)


def fit_difficulty(counts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Difficulty:
    """Alternate between documents and words, starting from the words' lengths."""
    size, bins = len(vocabulary.words), len(GRID)
    length = np.array([len(w) if w[0] != "|" else int(w[1:]) for w in vocabulary.words], float)
    hard = np.zeros(size)
    for k in np.unique(vocabulary.lang):
        own = vocabulary.lang == k
        hard[own] = 0.5 * (length[own] - length[own].mean()) / max(length[own].std(), 1e-3)
    model = Difficulty(vocabulary.lang, np.log(vocabulary.df + 1e-9), hard)
    for _ in range(rounds):
        y = np.zeros(size * bins)
        for k, n in _document_pass(counts, model, size).toPandas().itertuples(index=False):
            y[k] = n
        before, model = model, _word_step(y.reshape(size, bins), model)
        if np.sqrt(np.mean((model.hard - before.hard) ** 2)) < SETTLED * model.hard.std():
            break
    return model


def document_levels(counts: DataFrame, model: Difficulty) -> DataFrame:
    """(doc_id, lang, n, latent): the latent level of every document with an article."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        expected = m.expected()
        for b in batches:
            level = _levels_of(b, m, expected)[2] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("n"), pa.array(level)], names=["doc_id", "lang", "n", "latent"])

    return counts.mapInArrow(run, "doc_id long, lang int, n int, latent double")


def fit_scale(latent: np.ndarray, lang: np.ndarray, level: np.ndarray, langs: int, top: int = 5) -> np.ndarray:
    """(langs, top - 1) latent levels at which a document is as likely above as below each boundary between levels.

    Logistic curves; the languages share what few labels of one don't tell.
    """
    out = np.zeros((max(langs, 1), max(top - 1, 1)))
    for j in range(top - 1):
        y = (level > j + 1.5).astype(float)
        X = np.concatenate([np.ones((len(y), 1)), latent[:, None], *(((lang == k)[:, None] * np.stack([np.ones(len(y)), latent], 1)) for k in range(langs))], axis=1)
        w = np.zeros(X.shape[1])
        w[1] = 1.0
        ridge = np.array([1e-3, 1e-3] + [0.3, 0.3] * langs)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
            g = X.T @ (y - p) - ridge * w
            h = (X.T * (p * (1 - p) + 1e-9)) @ X + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        for k in range(langs):
            a, s = w[0] + w[2 + 2 * k], w[1] + w[3 + 2 * k]
            out[k, j] = -a / s if s > 1e-6 else np.inf
    return np.maximum.accumulate(out, axis=1)


def reading_levels(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lang, n_words, latent, level): the level, 1 to 5, of every document with an article.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, rater and level.
    Pages without an article have no row, pages with a single word of one have; a wrong or missing language doesn't
    matter; repeated and null labels don't count; raters who disagree are averaged.
    Without any labels the level is null.
    """
    spark: SparkSession = docs.sparkSession
    lines = written(lines_table(docs), "lines")
    articles = written(article_table(lines, fit_page_lines(lines)), "articles")
    dropped(lines)
    vocabulary = fit_vocabulary(articles)
    if not vocabulary.words:
        return spark.createDataFrame([], "doc_id long, lang string, n_words int, latent double, level int")
    counts = written(count_words(articles, vocabulary), "word-counts")
    dropped(articles)
    model = fit_difficulty(counts, vocabulary, rounds)
    levels = document_levels(counts, model)
    rated = (
        labels.where("level IS NOT NULL").select("doc_id", "rater", "level").distinct()
        .groupBy("doc_id").agg(F.avg("level").alias("rated")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    )
    known = levels.join(rated, "doc_id").select("lang", "latent", "rated").toPandas()
    named = F.element_at(F.array(*(F.lit(x) for x in vocabulary.langs)), F.col("lang") + 1)
    if len(known) < 10:
        level = F.lit(None).cast("int")
    else:
        cuts = fit_scale(known["latent"].to_numpy(), known["lang"].to_numpy(), known["rated"].to_numpy(), len(vocabulary.langs))
        by_lang = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in cuts))
        level = 1 + F.size(F.filter(F.element_at(by_lang, F.col("lang") + 1), lambda c: F.col("latent") >= c))
    return levels.select("doc_id", named.alias("lang"), F.col("n").alias("n_words"), "latent", level.cast("int").alias("level"))
