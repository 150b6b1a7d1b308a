"""The operators of the subpackage on small cases and against brute force."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import bpe, components, format_copies, lookalikes, names, packing, queries, reading, set_join, suffixes

CELL = "tokenized string, tableid int, colid int, rowid int, term string, rec string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(against_sql, name):
    against_sql(name)


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n not in queries.ORACLES])
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


# -- 1: look-alikes ------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    words = [("none",), ("total",), ("yes",), ("парк",), ("жилфонд",), ("ξερφο",), (None,), ("",)]
    return lookalikes.fit(spark.createDataFrame(words, "t string"), "t")


@pytest.mark.parametrize("text, form", [
    ("nоnе", "none"), ("ｎｏｎｅ", "none"), ("café", "café"), ("to​tal﻿", "total"), ("a b", "a b"), ("a　b", "a b"),
    ("m²", "m²"), ("½ l", "½ l"), ("°c", "°c"), ("\t0", "\t0"), ("  a  b ", "  a  b "), ("ТΥΡΕ", "TYPE"), ("ϲafé", "café"),
    ("жилфoнд", "жилфонд"), ("ξερφο b", "ξερφο b"), ("", ""), ("NaN", "NaN"), ("Ａ＿Ｂ", "A_B"), ("нет", "нет"), ("é" * 3000 + "о", "é" * 3000 + "o"),
])
def test_common_form(model, text, form):
    assert model.text(text) == form
    assert model.text(form) == form


def test_common_form_of_null(model):
    assert model.text(None) is None


def test_out_of_form(spark, model):
    df = spark.createDataFrame([("nоnе", 1), ("none", 2), (None, 3), ("", 4), ("nоnе", 5)], "x string, common int").withColumnRenamed("common", "extra")
    assert sorted((r.extra, r.common) for r in lookalikes.out_of_form(df, "x", model).collect()) == [(1, "none"), (5, "none")]
    end = spark.createDataFrame([("a\u2028", 1), ("a\n", 2)], "x string, extra int")
    assert [r.extra for r in lookalikes.out_of_form(end, "x", model).collect()] == [1]
    assert lookalikes.out_of_form(df.limit(0), "x", model).count() == 0


def test_every_alternative_looks_alike_both_ways():
    for table in (lookalikes.CYRILLIC_AS_LATIN, lookalikes.GREEK_AS_LATIN):
        for other, latin in table.items():
            assert lookalikes.script_of(latin) == "LATIN" and lookalikes.script_of(other) in ("CYRILLIC", "GREEK")
            assert unicodedata.category(other) == unicodedata.category(latin)
            assert latin in dict(lookalikes.options(other, "LATIN")) and other in dict(lookalikes.options(latin, lookalikes.script_of(other)))


def taught(words):
    """A model of some words."""
    counts = {}
    for w in words:
        for a, b in zip(["^" + lookalikes.script_of(w[0]), *w], w, strict=False):
            counts[a, b] = counts.get((a, b), 0) + 1
    return lookalikes.ScriptModel(counts)


@pytest.mark.parametrize("word, words, form", [
    # a stroke is I or l, as the letters around it have it
    ("heӏӏo", ["hello", "bell"] * 9, "hello"), ("PӏNE", ["PINE", "MINT"] * 9, "PINE"), ("fΙag", ["flag", "flat"] * 9, "flag"), ("fΙag", ["fIag", "fIat"] * 9, "fIag"),
    ("ӏt", ["It", "Is"] * 9, "It"), ("ӏt", ["lt", "ls"] * 9, "lt"),
    # a Latin letter in a Cyrillic word may be several; two may be one
    ("пpaвдa", ["правда"] * 9, "правда"), ("cboбoда", ["свобода", "своё"] * 9, "свобода"), ("cboбoда", ["сьобода", "сьоё"] * 9, "сьобода"), ("дымblл", ["мыл", "дым"] * 9, "дымыл"),
    ("λoγoς", ["λογος"] * 9, "λογος"), ("mнp".replace("н", "и"), ["мир"] * 9, "мир"),
    # other scripts only where a word is mixed
    ("nօne", ["none"] * 9, "none"), ("օսհ", ["none"], "օսհ"),
])
def test_the_scores_decide(word, words, form):
    model = taught(words)
    assert model.word(word) == form
    assert model.word(form) == form


def test_a_table_would_not_do():
    """The same stored letter comes out as different ones under one model, and the same word as different ones under two."""
    m = taught(["hello", "bell", "PINE", "MINT"] * 9)
    assert m.word("heӏӏo") == "hello" and m.word("PӏNE") == "PINE"
    assert {taught(w).word("fΙag") for w in (["flag"] * 9, ["fIag"] * 9)} == {"flag", "fIag"}
    assert max(len(lookalikes.options(c, s)) for c in "bnulI" for s in lookalikes.SCRIPTS) > 2


def test_very_long_words(model):
    import time

    began = time.time()
    assert model.text("xо" * 200_000 + "\u200b") == "xo" * 200_000
    assert time.time() - began < 20


def test_paths_are_the_best_of_all():
    import math

    m = taught(["своб", "вода", "съел", "мир", "ииг", "нпп"] * 3)
    for word in ("cbnur", "mubo", "blob", "жkh"):
        def paths(i, last):
            if i == len(word):
                yield 0, 0.0, ""
                return
            for n, x, cost, fits in lookalikes.lattice(word, "CYRILLIC")[i]:
                for out, score, rest in paths(i + n, x):
                    yield out + (not fits), score + m.score("CYRILLIC", last, x) - cost, x + rest

        want = min(paths(0, "^CYRILLIC"), key=lambda p: (p[0], -p[1]))
        got = m.viterbi(word, "CYRILLIC")
        assert got[0] == want[0] and math.isclose(got[1], want[1])


# -- 2: frequencies ------------------------------------------------------


def brute_ngrams(records, n):
    occ, rec = {}, {}
    for r, s, tokens in {(r, s, tuple(t)) for r, s, t in records if t}:
        for i in range(len(tokens) - n + 1):
            g = tokens[i : i + n]
            if all(g):
                occ[g] = occ.get(g, 0) + 1
                rec.setdefault(g, set()).add(r)
    return {g: (k, len(rec[g])) for g, k in occ.items()}


@pytest.mark.parametrize("parts, held", [(1, 500_000), (7, 500_000), (7, 3)])
def test_ngrams_against_brute_force(spark, parts, held):
    rng = random.Random(parts)
    records = [(rng.choice("abc") if rng.random() < 0.9 else None, i, [rng.choice(["x", "y", "z", ""]) for _ in range(rng.randrange(6))]) for i in range(120)]
    records += records[:10] + [("a", 999, None)]
    df = spark.createDataFrame(records, "rec string, p0 int, t0 array<string>")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.n, tuple(r.term)): (r.n_occurrences, r.n_records) for r in suffixes.ngram_counts(df, "t0", "rec", ["p0"], 5, held).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(n, g): v for n in (1, 2, 3, 4, 5) for g, v in brute_ngrams(records, n).items()}


def test_one_term_over_many_partitions(spark):
    rows = [("hot", i // 10, i % 10) for i in range(5000)] * 2 + [("cold", 1, 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "t string, r int, p int").repartition(9)
        counted = suffixes.interval_counts(df, ["t"], "r", ["p"])
        got = {r.term[0]: (r.n_occurrences, r.n_records) for r in counted.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {"hot": (5000, 500), "cold": (1, 1)}


def test_intervals_of_nothing(spark):
    assert suffixes.interval_counts(spark.createDataFrame([], "t string, r int, p int"), ["t"], "r", ["p"]).count() == 0


def test_common_prefixes_of_neighbours():
    import pyarrow as pa

    rows = sorted([("a", None, None), ("a", "b", None), ("a", "b", "c"), ("a", "b", "c"), ("a", "b", "d"), ("b", "b", "c")], key=lambda r: [x or "" for x in r])
    common, length = suffixes.common_prefixes([pa.array(c, pa.string()) for c in zip(*rows, strict=True)])
    assert common.tolist() == [0, 1, 2, 3, 2, 0] and length.tolist() == [1, 2, 3, 3, 3, 3]


# -- 3: names ------------------------------------------------------------


def linked(spark, spelled, person=True, **options):
    df = spark.createDataFrame([(x,) for x in spelled], "key string")
    return {frozenset((r.name_1, r.name_2)) for r in names.link_names(df, "key", person, **options).pairs().collect()}


def all_pairs(*groups):
    return {frozenset(p) for g in groups for p in itertools.combinations(g, 2)}


def test_people(spark):
    a = ["Robert Kurkunpirlen", "Roberrt Kurkunpirlen", "Kurkunpirlen, Robert", "Bob Kurkunpirlen", "R. Kurkunpirlen", "dir: Robert Kurkupirlen", "ROBERT KURKUNPIRLEN"]
    b = ["Henry E. Kurkunpirlen", "Henry Kurkunpirlen"]
    rest = ["N/A", "unknown", "", None, "Søren Barerfopur"]
    assert linked(spark, [*a, *b, *rest, *a], short_forms={"Bob": ["Robert"]}) == all_pairs(a, b)


def test_short_forms_without_a_lexicon(spark):
    assert linked(spark, ["Frederick Tultulkonla", "Fred Tultulkonla", "Robert Tultulkonla"]) == all_pairs(["Frederick Tultulkonla", "Fred Tultulkonla"])
    rows = [("Margaret Jelvurfalkas", "f1"), ("Maggie Jelvurfalkas", "f1"), ("Maria Jelvurfalkas", "f2"), ("Edward Jelvurfalkas", "f1")]
    pairs = names.link_names(spark.createDataFrame(rows, "x string, e string"), "x", True, evidence="e").pairs().collect()
    assert [(r.name_1, r.name_2) for r in pairs] == [("Maggie Jelvurfalkas", "Margaret Jelvurfalkas")]


def test_an_initial_for_two_people_links_neither_without_evidence(spark):
    assert linked(spark, ["Alexandra Konvunen", "Anthony Konvunen", "A. Konvunen"]) == set()


def test_evidence_decides(spark):
    df = spark.createDataFrame([("Alexandra Konvunen", "f1"), ("Anthony Konvunen", "f2"), ("A. Konvunen", "f2")], "raw string, e string")
    pairs = names.link_names(df, "raw", True, evidence="e").pairs().collect()
    assert [(r.name_1, r.name_2) for r in pairs] == [("A. Konvunen", "Anthony Konvunen")]


def test_titles(spark):
    a = ["The Nedurpirer Affair", "Nedurpirer Affair, The", "the  nedurpirer afair", "The Nedurpirer Affair [film]", "THE NEDURPIRER AFFAIR."]
    b = ["The Nedurpirer Affair 2", "The Nedurpirer Affair: Part Two", "Nedurpirer Affair, The 2", "The Nedurpirer Affair pt. 2", "The Nedurpirer Affair - Part II"]
    c = ["Captain Jedupundin and the Salt Queen", "Capt. Jedupundin & the Salt Queen"]
    d = ["7 Bridges of Mesfirfudil", "Seven Bridges of Mesfirfudil"]
    assert linked(spark, [*a, *b, *c, *d, "untitled", "Beyond Helkewodal"], person=False) == all_pairs(a, b, c, d)


def test_rare_token_on_one_side_only(spark):
    pairs = [["Spike Lee", "S. Lee"], ["Ang Wu", "Anng Wu"], ["Robert Fox", "Bob Fox"]]
    assert linked(spark, [x for p in pairs for x in p], short_forms={"Bob": ["Robert"]}) == all_pairs(*pairs)
    # John and Smith in enough names to be frequent
    filler = [f"John {a}{b}{a}{b}{a}{b}ov" for a in "bdfgk" for b in "lmnrs"] + [f"{a}{b}{b}{a}{a}{b}us Smith" for a in "bdfgk" for b in "lmnrs"]
    assert frozenset(("John Smith", "Jhon Smith")) in linked(spark, [*filler, "John Smith", "Jhon Smith"])


def test_two_edits_in_a_short_surname(spark):
    df = spark.createDataFrame([("Bo Marten", "f1"), ("Bo Mratex", "f1"), ("Bo Mertin", "f2")], "x string, e string")
    pairs = names.link_names(df, "x", True, evidence="e").pairs().collect()
    assert [(r.name_1, r.name_2) for r in pairs] == [("Bo Marten", "Bo Mratex")]
    words = ["marten", "mratex", "ang", "anng", "smith", "smth", "smyht", "abcd", "abdc", "abxy"]
    near = names.neighbours(spark.createDataFrame([(w,) for w in words], "t string")).collect()
    want = {(a, b) for a in words for b in words if names.edits(a, b, names.most_edits(a, b)) <= names.most_edits(a, b)}
    assert {(r.t, r.u) for r in near} == want


def test_titles_of_short_and_of_split_words(spark):
    pairs = [["Big Sky", "Bigg Sky"], ["No Where Man", "Nowhere Man"], ["Capt. Sky", "Captain Sky"]]
    assert linked(spark, [x for p in pairs for x in p], person=False) == all_pairs(*pairs)


def corpus(n, *spelled):
    """Names with others around them, none of which is near to any."""
    filler = [f"{a}{b}{a}ko {c}{b}{c}{a}mum" for a in "bdfgzv" for b in "aeiou" for c in "bdfgzv"]
    return [*filler[: n - len(spelled)], *spelled]


def test_different_names_one_edit_apart_need_evidence(spark):
    spelled = ["Gina Smith", "Tina Smith", "John Larson", "John Lawson", "John Parson"]
    assert linked(spark, corpus(50, *spelled)) == set()
    assert linked(spark, corpus(150, *spelled)) == set()
    rows = [(x, f"f{i}") for i, x in enumerate(corpus(100))] + [(x, "film") for x in ("John Smith", "John Smyth", "Gina Wood", "Tina Wood")] + [("Nina Wood", "other")]
    pairs = names.link_names(spark.createDataFrame(rows, "x string, e string"), "x", True, evidence="e").pairs().collect()
    assert {(r.name_1, r.name_2) for r in pairs} == {("John Smith", "John Smyth"), ("Gina Wood", "Tina Wood")}


def test_slips_and_long_tokens_need_none(spark):
    pairs = [["John Smith", "Jhon Smith"], ["Ang Lee", "Ang Leee"], ["Robert Kurkunpirlen", "Robert Kurkunpxrlen"], ["Spike Jonze", "Spike Jonez"]]
    assert linked(spark, corpus(60, *(x for p in pairs for x in p))) == all_pairs(*pairs)
    assert names.slip("gina", "gian") and names.slip("lee", "leee") and not names.slip("gina", "tina") and not names.slip("maria", "marina")


def test_frequent_names_meet_as_rare_ones_do(spark):
    filler = [f"John {a}{b}{a}{b}{a}{b}ov" for a in "bdfgk" for b in "lmnrs"] + [f"{a}{b}{b}{a}{a}{b}us Smith" for a in "bdfgk" for b in "lmnrs"]
    got = linked(spark, [*filler, "John Smith", "Jhon Smith", "John Smiht", "J. Smith", "John A. Smith"])
    assert frozenset(("Jhon Smith", "John Smiht")) in got and frozenset(("John A. Smith", "John Smith")) in got


def test_usual_tokens_have_few_keys():
    """However many misspellings of a token there are, a name with the token itself isn't keyed by them."""
    near = {"smyht": {"smith"}, "smithh": {"smith"}, "smoth": {"smith"}}
    assert all("smith" in k or k.startswith("john ") for k, _ in names.person_keys(["john", "smith"], near, names.Lexicon()))
    assert names.person_keys(["john", "smyht"], near, names.Lexicon()) & names.person_keys(["john", "smoth"], near, names.Lexicon())


def test_assignment_is_optimal():
    rng = random.Random(8)
    for n in (1, 2, 5, 6):
        for _ in range(30):
            cost = [[rng.choice([0.0, rng.random(), -rng.randrange(50)]) for _ in range(n)] for _ in range(n)]
            got = names.hungarian(cost)
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sorted(got) == list(range(n)) and abs(sum(cost[i][j] for i, j in enumerate(got)) - best) < 1e-9


def test_names_of_many_differing_tokens():
    whole = ["anselmo", "bertholdo", "cordelius", "desmondo", "eusebius", "fridolin", "gottfried", "hildebert", "ignatius", "jeronimo", "kasimir", "leopoldo"]
    initials = [w[0] for w in whole]
    assert names.person_link([*initials, "kurkunpirlen"], [*reversed(whole), "kurkunpirlen"], names.Lexicon()) == "initial"
    assert names.person_link([*initials[:-1], "x", "kurkunpirlen"], [*whole, "kurkunpirlen"], names.Lexicon()) is None


def test_placeholders_are_a_parameter(spark):
    spelled = ["Alan Smithee", "Alan  Smithee", "N/A", "n/a"]
    assert linked(spark, spelled) == {frozenset(("Alan Smithee", "Alan  Smithee"))}
    assert linked(spark, spelled, placeholders=frozenset({"alan smithee"})) == {frozenset(("N/A", "n/a"))}


def test_several_abbreviations_in_a_title(spark):
    pair = ["Capt. Mt. Jedupundin", "Captain Mount Jedupundin"]
    three = ["Capt. Mt. Bros. Halvard", "Captain Mount Brothers Halvard"]
    crossed = ["Capt. Orlimund Street", "Captain Orlimund St."]
    no = ["No Rain in Hulda", "Number 7 Hulda Road", "No. 7 Hulda Rd."]
    assert linked(spark, [*pair, *three, *crossed, *no, "Captain Murat Jedupandas"], person=False) == all_pairs(pair, three, crossed, no[1:])


def test_members_are_as_long_as_the_input(spark):
    df = spark.createDataFrame([(f"{'X' * (i % 2)}avier{'.' * (i % 3)} Kurkunpirlen",) for i in range(6)], "x string")
    found = names.link_names(df, "x", True)
    assert found.members().count() == df.distinct().count()


def test_no_names(spark):
    assert linked(spark, []) == set()
    assert linked(spark, [None, "", "N/A"]) == set()


def test_edits_and_deletes_agree():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(150)]
    for a, b in itertools.combinations(words, 2):
        if names.edits(a, b, 1) <= 1:
            assert names.deletes(a, 1) & names.deletes(b, 1)


@pytest.mark.parametrize("a, b, n", [("abc", "abc", 0), ("abcd", "abdc", 1), ("abcd", "abd", 1), ("abcd", "axcd", 1), ("abcd", "badc", 2), ("abcd", "wxyz", 3)])
def test_edits(a, b, n):
    assert names.edits(a, b, 2) == n


# -- 4: components -------------------------------------------------------


@pytest.mark.parametrize("bound", [1_000_000, 300, 40])
def test_components(spark, bound):
    rng = random.Random(2)
    e = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(2000, i) for i in range(2000, 2100)]
    parent = {x: x for p in e for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*e, *e[:20], (None, 5), (7, None), (None, None)], "v int, u int").repartition(6)
    got = {r.node: r.component for r in components.connected_components(df, "v", "u", bound=bound).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z")], "x string, y string")
    assert {tuple(r) for r in components.connected_components(df, "x", "y").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")}
    assert components.connected_components(df.limit(0), "x", "y").count() == 0


# -- 5: similar sets -----------------------------------------------------


def brute_pairs(sets, t, least):
    ok = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a] & ok[b]) / len(ok[a] | ok[b]) >= t}


@pytest.mark.parametrize("hot_rows", [1_000_000, 60])
def test_similar_sets(spark, hot_rows):
    rng = random.Random(4)
    base = [set(rng.sample(range(4000), rng.choice([10, 14, 40, 90]))) for _ in range(40)]
    sets = {}
    for i, s in enumerate(base):
        for j in range(3):
            keep = {x for x in s if rng.random() > 0.12 * j}
            sets[f"s{i}_{j}"] = {str(x) for x in keep} | {f"n{rng.random()}" for _ in range(j)}
    sets["copy"] = set(sets["s0_0"])
    rows = [(k, v) for k, vs in sets.items() for v in vs] * 2 + [(None, "1"), ("s1_0", None), ("s1_0", "")]
    df = spark.createDataFrame(rows, "token string, id string")
    found = set_join.similar_pairs(df, "token", "id", 0.7, 10, hot_rows=hot_rows).collect()
    got = {(r.id_1, r.id_2) for r in found}
    want = brute_pairs(sets, 0.7, 10)
    assert len(found) == len(got) and got <= want
    assert len(got) >= 0.97 * len(want)


def test_classes_and_a_large_set(spark):
    base = [str(x) for x in range(900)]
    sets = {"large": base, "same": base, "near": base[:800] + ["n1"], "small": base[:30], "again": base[:30], "far": ["z1", "z2"] * 20}
    rows = [(v, k) for k, vs in sets.items() for v in vs]
    found = set_join.similar_classes(spark.createDataFrame(rows, "t string, i string"), "i", "t", 0.7, hot_rows=100)
    assert {(r.id, r.rep) for r in found.members.collect()} == {("large", "large"), ("same", "large"), ("near", "near"), ("small", "again"), ("again", "again"), ("far", "far")}
    assert [sorted(r) for r in found.pairs.collect()] == [["large", "near"]]


def test_similar_sets_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert set_join.similar_pairs(df, "a", "b", 0.7).count() == 0


def test_calibration_recalls_pairs_at_the_threshold():
    plan = set_join.calibrate(5000, 0.7, 0.99)
    rng = np.random.default_rng(1)
    differ = rng.random((3000, set_join.BITS)) < 0.15
    hit = np.zeros(3000, bool)
    for s in plan.segments:
        hit |= ~differ[:, list(s)].any(axis=1)
    assert (hit & (differ[:, : set_join.RADIUS_BITS].sum(axis=1) <= plan.radius)).mean() > 0.98


# -- 7: copies -----------------------------------------------------------


def test_copies(spark):
    rows = [(1, 0, 0, "Red  Fox"), (1, 0, 1, "m²"), (2, 5, 0, "M²"), (2, 5, 1, "red-fox!"), (2, 5, 1, "red-fox!"), (3, 1, 0, "redfox"), (3, 1, 1, "m²"),
            (4, 0, 0, "GROSSE"), (4, 1, 0, "große"), (5, 0, 0, None), (5, 0, 1, "--"), (5, 1, 0, ""), (6, 0, 0, "a"), (6, 0, 1, "a"), (6, 1, 0, "a"), (None, 0, 0, "a"),
            (7, 0, 0, "x" * 40000), (7, 1, 2, "X" * 40000), (8, 0, 0, "end\n"), (8, 1, 0, "end")]
    cells = spark.createDataFrame(rows, "key int, n int, f int, t string")
    got = format_copies.copies(format_copies.canonical_records(cells, ["key", "n"], "f", "t")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 2), (4, 0, 2), (7, 0, 2), (8, 0, 2)}


def test_many_copies_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        recs = spark.range(3000).select(F.col("id").alias("r0"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"))
        got = {r.n_copies for r in format_copies.copies(recs).where("r0 = 0").collect()}
        total = format_copies.copies(recs).agg(F.sum("n_copies")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {1000}
    singles = recs.groupBy("key").count().where("count = 1").count()
    assert total == 3000 - singles


def test_copies_of_nothing(spark):
    cells = spark.createDataFrame([], "a int, b int, f int, t string")
    assert format_copies.copies(format_copies.canonical_records(cells, ["a", "b"], "f", "t")).count() == 0


# -- 8: encoding ---------------------------------------------------------

TEXTS = ["", " ", "Hello  world!\n\n it's we'll\t\r\n x", "naïve café №５ ½ 漢字かな", "a" * 3000, "ab" * 2000 + "!" * 500, "<|endoftext|> ok", "\U0001f600" * 40, "é​ \x85 x\x1c y", "  lead and trail   "]


def test_encoding_is_the_public_one():
    from tokenizers import Tokenizer

    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = bpe.ByteBPE(f.read())
    ref = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abe ct\n.'É1漢") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    flat, at = enc.encode(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == ref.encode(t, add_special_tokens=False).ids


def test_wide_rows_follow_the_leftmost_rule():
    """Rounds that merge all occurrences of a pair at once give what merging the leftmost one each round gives."""
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        raw = f.read()
    enc = bpe.ByteBPE(raw)
    ranks = {bpe.base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
    rng = random.Random(6)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(33, 300))) for alphabet in ("a", "ab", "aab=", "etaoin", "-=", "é", "01", "ha") for _ in range(25)]
    for word, ids in zip(words, enc.merge_pieces([w.encode() for w in words]), strict=True):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert ids.tolist() == [ranks[p] for p in parts]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, None), (3, ""), (1, "hi there")], "text long, ids string")
    got = [(r.id, r.ids) for r in bpe.encode_texts(df, "text", "ids", bpe.SharedEncoder(spark)).collect()]
    assert sorted(got) == [(1, [5303, 612]), (1, [5303, 612]), (2, []), (3, [])]
    assert bpe.encode_texts(df.limit(0), "text", "ids", bpe.SharedEncoder(spark)).count() == 0


# -- 9: packing ----------------------------------------------------------


def test_pieces():
    limits = packing.Limits(100, 4, 90)
    rng = np.random.default_rng(3)
    assert packing.pieces(np.ones(98, bool), limits) == [(0, 98, 98)]
    assert packing.pieces(np.zeros(0, bool), limits) == [(0, 0, 0)]
    for bears in (np.ones(1000, bool), rng.random(250) < 0.3, rng.random(1001) < 0.95, np.zeros(101, bool)):
        found = packing.pieces(bears, limits)
        assert sum(n for _, n, _ in found) == len(bears) and sum(q for *_, q in found) == bears.sum()
        assert all(0 < n <= 100 and q <= 90 and q == bears[s : s + n].sum() for s, n, q in found)
        assert [s for s, *_ in found] == list(np.cumsum([0] + [n for _, n, _ in found])[:-1])


def test_loss_bearing_tokens_are_those_of_their_lines():
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = bpe.ByteBPE(f.read())
    texts = ["ab cd\n  ef\n\n gh", None, "", "é x\r\nlast", "one line"]
    flat, at = enc.encode(texts)
    lines = [[True, False, None, True], None, [True], [False, True], [True, True, True]]
    got = packing.loss_bearing(texts, lines, flat, at, enc.lengths)
    for i, t in enumerate(texts):
        done, want = 0, []
        raw = (t or "").encode()
        for n in enc.lengths[flat[at[i] : at[i + 1]]]:
            k = raw[:done].count(b"\n")
            want.append(bool(lines[i] and k < len(lines[i]) and lines[i][k]))
            done += n
        assert done == len(raw) and got[at[i] : at[i + 1]].tolist() == want
    after_first = packing.loss_bearing(texts, None, flat, at, enc.lengths)
    assert after_first[at[0] : at[1]].tolist()[:2] == [False, False] and after_first[at[1] - 1] and not after_first[at[4] :].any()


def test_packer_respects_limits_and_fills():
    rng = np.random.default_rng(0)
    limits = packing.Limits(200, 6, 180)
    tokens = rng.integers(0, 150, 3000)
    loss = (tokens * rng.random(3000)).astype(int)
    demand = np.stack([tokens, np.ones(3000), loss], 1).astype(float)
    p = packing.Packer(limits, pool=256)
    out = [x for k in range(0, 3000, 100) for x in p.add(demand[k : k + 100], np.arange(k, k + 100))] + [p.close()]
    items, where = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
    assert sorted(items.tolist()) == list(range(3000))
    used = np.zeros((where.max() + 1, 3))
    np.add.at(used, where, demand[items])
    assert (used <= [200, 6, 180]).all()
    assert used[:, 0].sum() / (200 * len(used)) > 0.97


def test_pack_texts(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else "Head\n" + "word " * (i * 40)) for i in range(60)] + [(99, "x y " * 5000), (3, None)], "id int, start string")
    got = packing.pack_texts(df, "id", "start", bpe.SharedEncoder(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.container_id, []).append(r)
    assert all(sum(r.n_tokens for r in rs) <= 2048 and len(rs) <= 16 for rs in by.values())
    assert all(sum(r.n_loss for r in rs) <= 1536 or sum(r.n_loss > 0 for r in rs) == 1 for rs in by.values())
    assert any(r.n_loss > 1536 for r in got)  # whole, though more than a container's loss
    assert sum(r.id == 3 for r in got) == 2
    pieces = sorted((r.piece, r.start, r.n_tokens) for r in got if r.id == 99)
    assert [p for p, *_ in pieces] == list(range(len(pieces))) and pieces[-1][1] + pieces[-1][2] == 10001
    totals = {}
    for r in got:
        totals.setdefault(r.id, []).append(r.n_tokens)
    assert all((sum(n) > 2048) == (len(n) > 1) for i, n in totals.items() if i != 3)


def test_the_loss_limit_binds(spark):
    # half of the items bear loss throughout, half none: only mixed containers are full in both
    df = spark.createDataFrame([(i, "word " * 200, [i % 2 == 0]) for i in range(400)], "id int, text string, bears array<boolean>").coalesce(1)
    limits = packing.Limits(1000, 100, 500)
    got = packing.pack_texts(df, "id", "text", bpe.SharedEncoder(spark), limits, "bears").collect()
    by = {}
    for r in got:
        t = by.setdefault(r.container_id, [0, 0])
        t[0] += r.n_tokens
        t[1] += r.n_loss
    assert all(t <= 1000 and q <= 500 for t, q in by.values())
    assert max(q for _, q in by.values()) > 400 and sum(t for t, _ in by.values()) > 0.75 * 1000 * len(by)
    plenty = packing.pack_texts(df, "id", "text", bpe.SharedEncoder(spark), packing.Limits(1000, 100, 1000), "bears").groupBy("container_id").agg(F.sum("n_loss").alias("q"))
    assert plenty.agg(F.max("q")).first()[0] > 500


# -- 10: reading level ---------------------------------------------------


ADVERTS = {
    "en": ("TO LET", ["Box {n}, this office", "Terms cash. No agents.", "a warm {w}, hardly used", "Telephone {n}"]),
    "de": ("ZU VERKAUFEN", ["Gute {w}, kaum benutzt", "Angebote unter {n} an die Expedition", "nur {n} Mark das Dutzend"]),
    "fr": ("À VENDRE", ["Bonne {w}, presque neuve", "S'adresser au bureau, {n}", "{n} francs la douzaine"]),
}


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    words = {"en": "the cat sold his road when mayor used this office box only from hardly and they have apply to it was", "de": "der hund sah das haus nur mark und die gute stadt unter dem wald", "fr": "le chat vendit sa route quand maire bureau au la bonne et neuve une"}
    out = []
    for i in range(360):
        lang = ("en", "de", "fr")[i % 3]
        vocabulary = words[lang].split()
        lines = ["HARBOUR POST, page 6", f"NEWS OF {''.join(rng.sample('BCDFGHKLMNP', 5))}"]
        lines += [" ".join(rng.choice(vocabulary) for _ in range(7)) for _ in range(14)]
        if i % 2:
            head, kinds = ADVERTS[lang]
            at = rng.randrange(4, 14)
            lines[at:at] = [head, *(x.format(n=rng.randrange(900), w=rng.choice(vocabulary)) for x in rng.sample(kinds, 2))]
        out.append((i, "\n".join(lines), lang))
    return out


@pytest.fixture(scope="module")
def line_model(spark, pages):
    return reading.fit_lines(spark.createDataFrame(pages, "doc_id long, text string, lang string"))


def test_lines_are_told_without_any_word_list(line_model, pages):
    assert line_model.headlines == {reading.headline(h) for h, _ in ADVERTS.values()}
    for _, text, _ in pages:
        head = {"en": "office", "de": "expedition", "fr": "douzaine"}
        words = reading.article_words(text, line_model)
        assert len(words) in (98, *range(91, 99)) and head["de"] not in words and head["fr"] not in words
    kept = ["it was the only", "He had hardly used the road", "they have to apply to the mayor", "short notes from 5d the whole town came", "the cat sold it only from this office"]
    for line in kept:
        page = "\n".join(["NEWS OF BIRKA", "the cat sold his road", line, "the mayor sold this box and it was"])
        assert len(reading.article_words(page, line_model)) == sum(len(reading._TOKEN(x)) for x in page.split("\n")[1:])
    for head, kinds in ADVERTS.values():
        page = "\n".join([head, *(x.format(n=7, w="cat") for x in kinds)])
        assert reading.article_words("FIRST LINE\n" + page, line_model) == []


def test_article_words(line_model):
    page = "HARBOUR POST, page 6\nCUP AT BIRKAS\nThe rail-\nway sold 0ur cup\r\nTO LET\nTerms cash. No agents.\nBox 582, this office\nit was s0."
    assert reading.article_words(page, line_model) == ["the", "rail|way|it", "sold", "our", "cup", "it", "was", "so"]
    assert reading.article_words(None, line_model) == reading.article_words("", line_model) == reading.article_words("TO LET\nTelephone 246", line_model) == []
    assert reading.article_words("THE MAYOR OPENED THE NEW HALL AND SPOKE", line_model) == "the mayor opened the new hall and spoke".split()
    assert reading.article_words("cup", line_model) == ["cup"] and len(reading.article_words("x" * 90, line_model)[0]) == 90
    assert reading.article_words("in\nTO LET\nit was so", reading.LineModel()) == ["in", "it", "was", "so"]


def test_few_pages_are_drawn_of_many(spark, pages):
    many = [(i * 10 + k, t.replace("NEWS OF", "NEWS OF " + "BCDFGHKLMN"[k] * 3), x) for i, t, x in pages for k in range(10)] + pages[:1] * 3600
    model = reading.fit_lines(spark.createDataFrame(many, "doc_id long, text string, lang string"), pages=1500)
    assert model.headlines == {reading.headline(h) for h, _ in ADVERTS.values()}


def test_lines_are_fitted_to_every_page(spark):
    rng, words = random.Random(5), "the cat sold his road when mayor and they have to it was".split()
    docs = []
    for i in range(4500):
        article = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(7)]
        docs.append((i, "\n".join(["POST", *article, "TO LET", f"Box {i}, this office", "Terms cash. No agents."]), "en"))
    model = reading.fit_lines(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    # an advert follows the headline of every page; their number is in the odds
    assert model.headlines == {reading.headline("TO LET")} and round(np.exp(model.prior[0])) == 2 * len(docs) + 1


def test_many_lines_read_like_single_pages(line_model, pages):
    import pyarrow as pa

    texts = [t for _, t, _ in pages[:60]] + ["TO LET\nTelephone 246", "in-\n-\nTO LET\nBox 5, this 0ffice", "a\r\n\r\nTO LET"]
    together = reading._article_texts(pa.array([reading.page_lines(t) for t in texts]), reading._Reader(line_model))
    assert together == [" ".join(reading.article_words(t, line_model)) for t in texts]


def test_only_lines_with_capitals_are_looked_at_one_by_one(pages, monkeypatch):
    seen, is_heading = [], reading.is_heading
    monkeypatch.setattr(reading, "is_heading", lambda line: seen.append(line) or is_heading(line))
    for _, text, _ in pages[:60]:
        seen.clear()
        assert reading.page_lines(text).count("#") == len(seen) == sum(map(is_heading, text.split("\n"))) < text.count("\n") / 4


def test_pages_are_taken_apart_together_like_line_by_line(pages, monkeypatch):
    rng = random.Random(3)
    odd = ["".join(rng.choice("abAB\xc0\xdf\u017f\u2020\u0130\u03a3\u01c5\xbd\xb2_-=\xad  \n\n\r\x85\x1c\u4e2d\u0301015|#") for _ in range(k % 50)) for k in range(2000)]
    texts = [None, "", *(t for _, t, _ in pages[:30]), None, *odd, None]

    def by_line(text):
        out = []
        for raw, low in zip(text.split("\n"), text.lower().replace("\u2020", "t").split("\n"), strict=True):
            tokens = " ".join(reading._TOKEN(low))
            if tokens:
                out.append("#" + reading.headline(raw) if reading.is_heading(raw) else "-" * (raw.rstrip()[-1:] in reading._BREAKS) + tokens)
        return "\n".join(out) or None

    expected = [by_line(t or "") for t in texts]
    for letters in (1, 500, 10**6):
        monkeypatch.setattr(reading, "TOGETHER_LETTERS", letters)
        assert reading.pages_lines(texts) == expected


def test_long_adverts_are_read_to_their_end(line_model, monkeypatch):
    import pyarrow as pa

    advert = ["Terms cash. No agents.", "Box 5, this office"] * 10
    texts = pa.array([reading.page_lines("\n".join(["POST", "the cat sold his road", "TO LET", *advert, "the cat sold his road when they have"]))] * 3)
    for steps in (1, 2, reading.STEPS, 100):
        monkeypatch.setattr(reading, "STEPS", steps)
        assert reading._article_texts(texts, reading._Reader(line_model)) == ["the cat sold his road the cat sold his road when they have"] * 3


def test_weights_of_lines_are_fitted_again_only_for_other_headlines(spark, pages, monkeypatch):
    passes, summed = [], reading._summed
    monkeypatch.setattr(reading, "_summed", lambda lines, of: passes.append(of.__name__) or summed(lines, of))
    reading.fit_lines(spark.createDataFrame(pages, "doc_id long, text string, lang string"))
    assert passes == ["heads", "below", "far", "read", "read"]
    passes.clear()
    reading.fit_lines(spark.createDataFrame([(i, t.replace("\n", "\nHOME AND ABROAD\n", 3), x) for i, t, x in pages], "doc_id long, text string, lang string"))
    assert passes == ["heads", *["below", "far", "read"] * 2]


def test_sections_of_a_paper_head_no_adverts(spark, pages):
    with_sections = [(i, t.replace("\n", "\nHOME AND ABROAD\n", 3), x) for i, t, x in pages]
    model = reading.fit_lines(spark.createDataFrame(with_sections, "doc_id long, text string, lang string"))
    assert reading.headline("HOME AND ABROAD") not in model.headlines and reading.headline("TO LET") in model.headlines


def test_levels_follow_planted_ones(spark):
    rng = random.Random(7)
    easy, mid, hard = ([f"{p}{a}{b}" for a in "bdfgkl" for b in "aeiou"] for p in ("", "mor", "constitut"))
    docs, labels = [], []
    for i in range(400):
        level = i % 5 + 1
        pool = {1: (9, 1, 0), 2: (6, 4, 0), 3: (3, 5, 2), 4: (2, 4, 4), 5: (1, 2, 7)}[level]
        text = " ".join(rng.choice(rng.choices((easy, mid, hard), pool)[0]) for _ in range(150))
        advert = "\nWANTED\nTelephone 246\nTerms cash. No agents." if i % 3 == 0 else ""
        lines = [text[k : k + 60] for k in range(0, len(text), 60)]
        docs.append((i, "Start " + "\n".join(lines[:5]) + advert + "\n" + "\n".join(lines[5:]), None if i % 7 == 0 else "en", "x"))
        if i % 4 == 0:
            labels += [(i, "r1", level), (i, "r1", level), (i, "r2", None)]
    docs += [(900, None, "en", "x"), (901, "  ", None, "x"), (902, "WANTED\nTelephone 246", "en", "x"), (903, "POST\nWANTED\nTelephone 246\nTerms cash. No agents.", "en", "x"), (904, "Start", "en", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, level string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, level int")
    got = {r.doc_id: r.level for r in reading.reading_levels(d, lab, rounds=4).collect()}
    assert set(got) == {*range(400), 904}  # a page of one word has a level, adverts alone have none
    assert sum(got[i] == i % 5 + 1 for i in range(400)) > 360
    assert {r.level for r in reading.reading_levels(d, lab.limit(0), rounds=1).collect()} == {None}


def test_levels_of_nothing(spark):
    d = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, rater string, level int")
    assert reading.reading_levels(d, lab).count() == 0
    assert reading.reading_levels(d.limit(0), lab).count() == 0
