import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import correlate, duplicates, enrich, index, joinsearch, lookup, ranges, skew
from lakeweave.plans import lake_queries
from lakeweave.sources import readers
from lakeweave.sources.catalog import LakeCatalog

CELL = "token string, tableid int, colid int, rowid int, table_col_id string"


def cells_of(spark, tables):
    """{tableid: rows of tokens} as cells."""
    rows = [(v, t, c, r, f"{t}_{c}") for t, data in tables.items() for r, line in enumerate(data) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, CELL)


@pytest.mark.parametrize("column, want", [
    (["3", "1", "2", "1"], (True, 1, [-1, 3, 0, 2], "0011")),
    (["b", "a", "", "b"], (False, 1, [3, 0, -1, 2], "0101")),
    (["5", "", "nan", "2"], (True, 3, [1, 2, -1, 0], "1001")),
])
def test_order_index(spark, column, want):
    r = index.order_index(cells_of(spark, {1: [[v] for v in column]})).first()
    assert (r.is_numeric, r.min_index, r.order_list, r.binary_list) == want


def test_order_list_is_a_permutation_ending_in_minus_one(spark):
    r = index.order_index(cells_of(spark, {1: [[str(i * 7 % 11)] for i in range(40)]})).first()
    at, seen = r.min_index, []
    while at != -1:
        seen.append(at)
        at = r.order_list[at]
    assert sorted(seen) == list(range(40))


@pytest.mark.parametrize("size", [1, 3, 100])
def test_ranks_of_order_index_agree(spark, size):
    c = cells_of(spark, {1: [[v, w] for v, w in zip("3121", ["b", "", "a", "b"], strict=True)]})
    a = {(r.table_col_id, r.rowid): r.rk for r in index.column_ranks(c).collect()}
    b = {(r.table_col_id, r.rowid): r.rk for r in index.order_ranks(index.order_blocks(c, size)).collect()}
    assert a == b


def test_unpivot_and_pivot(spark):
    df = spark.createDataFrame([(2, "Red fox", None), (1, "Hen", 5.0)], "id int, name string, x double")
    t = index.LakeTable(1, "t", df, ["id"])
    c = index.index_cells([t])
    wide = {r.rowid: (r.id, r["name"], r.x) for r in lookup.wide_table(c, index.index_headers(spark, [t]), 1).collect()}
    assert wide == {0: ("1", "hen", "5 0"), 1: ("2", "red fox", None)}


def test_wide_table_with_clashing_headers(spark):
    c = cells_of(spark, {1: [["x", "y"]]})
    h = spark.createDataFrame([(1, 0, "h", "h"), (1, 1, "h", "h")], "tableid int, colid int, header string, header_tokenized string")
    assert lookup.wide_table(c, h, 1).first().asDict() == {"rowid": 0, "h": "x", "h_1": "y"}


LAKE = {1: [["ann", "rome", "1"], ["bob", "oslo", "2"], ["cy", "rome", "3"]], 2: [["x", "ann", "rome"], ["y", "bob", "bern"]], 3: [["ann", "q", "z"]]}


@pytest.mark.parametrize("use_hash, stored", [(True, True), (True, False), (False, False)])
def test_join_search(spark, use_hash, stored):
    c = cells_of(spark, LAKE)
    data = spark.createDataFrame([("Ann", "Rome"), ("Bob", "Oslo"), ("Bob", "Oslo"), ("nan", "Rome"), (None, "x")], "who string, city string")
    q = joinsearch.prepare(data, ["who", "city"], ["who", "city"])
    s = joinsearch.join_search(c, q, 5, rows=index.row_signatures(c) if stored else None, use_hash=use_hash)
    assert [(r.rank, r.score, r.score_ref, r.tableid, r.cols) for r in s.tables.orderBy("rank").collect()] == [(1, 2, 1, 1, [0, 1]), (2, 1, 0, 2, [1, 2])]
    assert s.stats.first().matching_rows == 3


def test_early_termination_finds_the_same(spark):
    rng = random.Random(31)
    data = {t: [[rng.choice("abcdef"), rng.choice("uvwxyz"), rng.choice("abuv")] for _ in range(rng.randrange(1, 30))] for t in range(1, 40)}
    c = cells_of(spark, data)
    q = joinsearch.prepare(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(itertools.product("abc", "uvw"))], "i int, x string, y string"), ["x", "y"], ["i"])
    for k in (1, 5, 100):
        a, b = (joinsearch.join_search(c, q, k, early=e).tables.select("rank", "score", "tableid", "cols").collect() for e in (False, True))
        assert sorted(a) == sorted(b)
    assert joinsearch.join_search(c.limit(0), q, 3, early=True).tables.count() == 0


def test_prepare_takes_any_column_names(spark):
    data = spark.createDataFrame([("Ann", "x", 1), ("Ann", "x", 2), ("Bob", "y", 0)], "`Director Name` string, `a.b (c)` string, before int")
    q = joinsearch.prepare(data, ["Director Name", "a.b (c)"], ["before"])
    assert {(r.input_row, r.q0, r.q1) for r in q.collect()} == {(0, "bob", "y"), (1, "ann", "x")}
    assert {(r.before, r.input_row) for r in joinsearch.numbered(data, ["before"]).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_join_search_unary_names_the_column_twice(spark):
    c = cells_of(spark, LAKE)
    q = joinsearch.prepare(spark.createDataFrame([("rome",)], "city string"), ["city"], ["city"])
    assert [(r.tableid, r.score, r.cols) for r in joinsearch.join_search(c, q, 1).tables.collect()] == [(1, 2, [1, 1])]


def test_join_search_of_nothing(spark):
    c = cells_of(spark, LAKE)
    q = joinsearch.prepare(spark.createDataFrame([], "who string, city string"), ["who", "city"], ["who"])
    assert joinsearch.join_search(c, q, 3).tables.count() == 0
    empty = spark.createDataFrame([], CELL)
    assert joinsearch.join_search(empty, q, 3).tables.count() == 0


def test_duplicates(spark):
    c = cells_of(spark, {1: [["a", "b"], ["c", "d"]], 2: [["d", "c"], ["b", "a"]], 3: [["a", "b"]], 4: [["a", "b", "e"]], 5: [["a", "b"], ["a", "b"], ["x", "y"]]})
    rows = index.row_signatures(c)
    rel = {(r.tableid_1, r.tableid_2): r.n_pairs for r in duplicates.duplicate_relations(c, rows).collect()}
    assert rel == {(1, 2): 2, (1, 3): 1, (1, 5): 2, (2, 3): 1, (2, 5): 2, (3, 5): 2}
    full = {(r.tableid_1, r.tableid_2) for r in duplicates.duplicate_relations(c, rows, distinct=True).collect()}
    assert full == {(1, 2), (1, 3), (2, 3), (3, 5)}
    assert {(r.tableid_1, r.tableid_2) for r in duplicates.contained_tables(c).collect()} == full
    assert {r.tableid for r in duplicates.duplicate_tables(c, rows, 3).collect()} == {1, 2, 3, 5}
    assert {r.tableid for r in duplicates.duplicate_tables(c, rows, 1, full=True).collect()} == {1, 2}
    left = duplicates.remove_duplicates(spark.range(1, 6).withColumnRenamed("id", "tableid"), duplicates.duplicate_relations(c, rows))
    assert {r.tableid for r in left.collect()} == {1, 4}


def test_numeric_and_categorical_scores(spark):
    c = cells_of(spark, {1: [["a", "4", "u"], ["b", "3", "u"], ["c", "2", "w"], ["d", "1", "w"]]})
    pairs = spark.createDataFrame([(1, i, i) for i in range(4)], "tableid int, ext_row int, input_row int")
    targets = correlate.target_ranks(spark.createDataFrame([(i, float(i)) for i in range(4)], "input_row int, y double"), "y")
    got = {r.table_col_id: (r.is_numeric, round(r.corr, 4)) for r in correlate.column_scores(c.where("colid > 0"), pairs, targets).collect()}
    assert got == {"1_1": (True, -1.0), "1_2": (False, 0.8944)}


def test_constant_target_scores_null(spark):
    c = cells_of(spark, {1: [["1", "x"], ["2", "y"]]})
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "tableid int, ext_row int, input_row int")
    targets = correlate.target_ranks(spark.createDataFrame([(0, 5.0), (1, 5.0)], "input_row int, y double"), "y")
    assert {r.corr for r in correlate.column_scores(c, pairs, targets).collect()} == {None}


def test_enrich_keeps_first_external_row(spark):
    c = cells_of(spark, {7: [["rome", "1"], ["rome", "2"], ["oslo", "3"]]})
    h = spark.createDataFrame([(7, 1, "n", "n")], "tableid int, colid int, header string, header_tokenized string")
    df = spark.createDataFrame([("Rome",), ("Bern",)], "city string")
    got = {r.city: r["7_1:n"] for r in enrich.add_features(df, ["city"], c, h, 7, [0], [1]).collect()}
    assert got == {"Rome": "1", "Bern": None}


def test_impute_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    assert sorted(r.x for r in enrich.mean_impute(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


# -- skewed keys ---------------------------------------------------------


def test_skew_counts(spark):
    rows = [("hot", i % 3, i) for i in range(300)] + [("hot", 0, 0)] * 50 + [("cold", 1, 7), (None, 1, 1), ("cold", None, 8)]
    df = spark.createDataFrame(rows, "key string, value int, weight int").repartition(5)
    once = skew.value_frequencies(df, "key", "value", unit=["key", "value", "weight"], block_on="weight")
    assert {r.key: (r.n_rows, r.n_values) for r in skew.key_counts(once).collect()} == {"hot": (300, 3), "cold": (2, 1), None: (1, 1)}
    assert {r.key: (r.mode, r.mode_rows) for r in skew.key_modes(once).collect()}["hot"] == (0, 100)
    every = skew.value_frequencies(df, "key", "value")
    assert {r.key: r.n_rows for r in skew.key_counts(every).collect()}["hot"] == 350


def test_skew_percentiles_match_sorting(spark):
    import random

    rng = random.Random(3)
    rows = [("h" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(50)) for _ in range(2000)]
    got = {(r.key, r.p): r.percentile for r in skew.key_percentiles(skew.value_frequencies(spark.createDataFrame(rows, "a string, b int"), "a", "b"), [0.25, 0.5, 1.0]).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    want = {(k, p): sorted(v)[max(0, -(-int(p * 100) * len(v) // 100) - 1)] for k, v in by.items() for p in (0.25, 0.5, 1.0)}
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 3])
def test_running_totals_against_brute_force(spark, batch):
    rng = random.Random(21)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1.5, float("nan"), None, 2.0]), i, rng.choice([0, 1, 4, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, `x.y` double, i int, w int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for group in ([], ["g"], ["g", "`x.y`"]):
            got = ranges.running_totals(df, group, [F.col("i")], "w").collect()
            seen, want = {}, {}
            key = lambda r: tuple(repr(r[c.strip("`")]) for c in group)
            ordered = sorted((spark_row for spark_row in df.collect()), key=lambda r: r.i)
            for r in ordered:
                want[r.i] = seen.get(key(r), 0)
                seen[key(r)] = want[r.i] + (r.w or 0)
            assert {r.i: r["__before"] for r in got} == want and all(r["__total"] == seen[key(r)] for r in got)
            assert got[0].__fields__[:4] == ["g", "x.y", "i", "w"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ranges.running_totals(df.limit(0), ["g"], [F.col("i")], "w").count() == 0


def test_skew_of_nothing(spark):
    f = skew.value_frequencies(spark.createDataFrame([], "key string, value int"), "key", "value")
    assert skew.key_counts(f).count() == skew.key_modes(f).count() == skew.key_percentiles(f, [0.5]).count() == 0


def test_order_ranks_of_a_long_column(spark):
    """Against brute force; a fold that copies its result at each step takes time with the square of the length."""
    rng = random.Random(11)
    values = [rng.randrange(9000) for _ in range(60_000)]
    cells = spark.createDataFrame([(str(v), 3, 0, i, "3_0") for i, v in enumerate(values)], "token string, tableid int, colid int, rowid int, table_col_id string")
    first, count = {}, {}
    for i, v in enumerate(sorted(values), 1):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    began = time.time()
    got = {r.rowid: r.rk for r in index.order_ranks(index.order_blocks(cells, 7000)).collect()}
    assert got == {i: first[v] + (count[v] - 1) / 2 for i, v in enumerate(values)}
    assert time.time() - began < 60
    assert index.order_blocks(cells, 7000).agg(F.max(F.size("row_list"))).first()[0] == 7000


def test_ranks_of_joined_rows_against_brute_force(spark):
    rng = random.Random(12)
    values = [rng.randrange(20) for _ in range(300)]
    cells = spark.createDataFrame([(str(v), 3, 0, i, "3_0") for i, v in enumerate(values)], CELL)
    joined = {i: rng.randrange(60) for i in range(300) if rng.random() < 0.4}
    pairs = spark.createDataFrame([(3, i, r) for i, r in joined.items()], "tableid int, ext_row int, input_row int")
    order = sorted(values[i] for i in joined)
    want = {}
    for i, r in joined.items():
        e = order.index(values[i]) + (order.count(values[i]) + 1) / 2
        want[r] = max(want.get(r, 0), e)
    got = {r.input_row: r.e for r in index.joined_ranks(index.order_blocks(cells, 16), pairs).collect()}
    assert got == want


def test_category_runs(spark):
    c = cells_of(spark, {1: [["b"], ["a"], [""], ["b"], ["nan"]]})
    assert {tuple(r) for r in index.category_runs(index.order_blocks(c, 2)).collect()} == {("1_0", 1, 1, 1), ("1_0", 2, 2, 0), ("1_0", 3, 2, 2)}


def test_values_dealt_out_anew(spark):
    from lakeweave.operators import evaluate

    df = spark.createDataFrame([(i, i % 7, float(i)) for i in range(100)], "id int, a int, b double")
    out = evaluate.dealt(df, ["a", "b"], 3)
    for f in ("a", "b"):
        for r in range(3):
            rows = out.where((F.col("feature") == f) & (F.col("round") == r)).collect()
            assert sorted(x.id for x in rows) == list(range(100))
            assert sorted(x[f] for x in rows) == sorted(x[f] for x in df.collect())
            assert sum(x[f] != (x.id % 7 if f == "a" else float(x.id)) for x in rows) > 60
            assert all(x.b == float(x.id) for x in rows) or f == "b"
    assert evaluate.dealt(df.limit(0), ["a"], 2).count() == 0
    assert len(set(evaluate.shuffles(97, 10, 1))) == 10 and all(len({(a * p + b) % 97 for p in range(97)}) == 97 for a, b in evaluate.shuffles(97, 10, 1))


@pytest.mark.parametrize("name", ["W6_ranks_from_order_index", "L5_simhash", "H1_xash_variants"])
def test_queries_over_every_table(spark, sf_dir, name):
    lake = lake_queries.L.lake(spark, sf_dir)
    got, by = lake_queries.QUERIES[name](spark, sf_dir), "table_col_id" if name.startswith("W6") else "token"
    assert got.select(by).distinct().count() == lake.cells.select(by).distinct().count()


def test_variants_look_at_each_token_once(spark, sf_dir):
    plan = lake_queries.H1_xash_variants(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(token") == 1 and "RepartitionByExpression [token" in plan
    lake = lake_queries.L.lake(spark, sf_dir)
    assert {r.token for r in lake_queries.L.tokens(spark, sf_dir).collect()} == {r.token for r in lake.cells.select("token").distinct().collect()}


# -- sources -------------------------------------------------------------


def test_sniff():
    assert readers.sniff(b"a;b;c\n1;2;3\n") == ";"
    assert readers.sniff("näme,x\n".encode("latin-1")) == ","
    with pytest.raises(ValueError):
        readers.sniff(b"")


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "p"}, {"x": 2, "y": null}]')
    (tmp_path / "b.json").write_text('{"x": [1, 2], "y": ["p", "q"]}')
    (tmp_path / "c.json").write_text('{"x": {"0": 1, "1": 2}, "y": {"0": "p", "1": "q"}}')
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json")).select("x", "y").collect()] == [(1, "p"), (2, None)]
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "b.json")).select("x", "y").collect()] == [(1, "p"), (2, "q")]
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "c.json")).select("x", "y").collect()] == [("1", "p"), ("2", "q")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "y": "p"}\n\n{"x": 2}\n{"x": 3, "y": "q"}\n')
    assert sorted(tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json")).select("x", "y").collect()) == [(1, "p"), (2, None), (3, "q")]
    (tmp_path / "n.json").write_text("[{'x': 1.5}, {'x': NaN}]")
    assert readers.read_json(spark, str(tmp_path / "n.json")).count() == 2
    # several values that aren't one per line are an error, not their first value
    (tmp_path / "b.json").write_text('{"x": 1} {"x": 2}\n{"x": 3}\n')
    (tmp_path / "c.json").write_text('{\n"x": 1\n}\n{\n"x": 2\n}\n')
    report = readers.IndexReport()
    for name in ("b", "c"):
        assert readers.read_any(spark, str(tmp_path / f"{name}.json"), report) is None
    assert len(report.data_errors) == 2


def test_json_lines_are_indexed_whole(spark, tmp_path):
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "a.json").write_text("".join(f'{{"k": "v{i}"}}\n' for i in range(3)))
    cat = LakeCatalog(spark, str(tmp_path / "index"))
    cat.add_folder(str(tmp_path / "lake"))
    assert len(cat.update().inserted) == 1
    assert {r.token for r in cat.table("cells").collect()} == {"v0", "v1", "v2"}


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute n numeric\n@attribute 's t' {u,v}\n@data\n1.5,u\n?,'v, w'\n")
    assert [tuple(r) for r in readers.read_arff(spark, str(tmp_path / "a.arff")).collect()] == [(1.5, "u"), (None, "v, w")]


def test_arff_with_a_long_header(spark, tmp_path):
    long = ",".join(f"v{i}" for i in range(20_000))
    head = "% c\n" * 5000 + f"@relation r\n@attribute a numeric\n@attribute b {{{long}}}\n@attribute c string\n@attribute d real\n@DATA\n"
    rows = [(float(i), f"v{i}", "@x" if i % 2 else "y", i / 4) for i in range(2000)]
    (tmp_path / "a.arff").write_text(head + "% no row\n\n" + "".join(f"{a:g},{b},{c},{d}\n" for a, b, c, d in rows))
    (tmp_path / "b.arff").write_text("@relation r\n@attribute 'a' string\n@data\n@home\n@data\n% no row\nx\n")
    (tmp_path / "c.arff").write_text("@relation r\n@attribute a string\nx\n")
    for most in ("128m", "20000"):  # in one block, and the header over several
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            assert sorted(tuple(r) for r in readers.read_arff(spark, str(tmp_path / "a.arff")).collect()) == rows
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.a for r in readers.read_arff(spark, str(tmp_path / "b.arff")).collect()] == ["@home", "@data", "x"]
    with pytest.raises(ValueError):
        readers.read_arff(spark, str(tmp_path / "c.arff"))


def test_catalog_appends(spark, tmp_path):
    lake = tmp_path / "lake"
    (lake / "sub").mkdir(parents=True)
    (lake / "a.csv").write_text("x,y\n1,Red\n2,Blue\n")
    (lake / "b.tsv").write_text("p\tq\nu\tv\n")
    (lake / "bad.xyz").write_text("?")
    (lake / "empty.csv").write_text("x,y\n")
    (lake / "sub" / "c.json").write_text('[{"k": "z"}]')
    cat = LakeCatalog(spark, str(tmp_path / "index"))
    cat.add_folder(str(lake))
    r = cat.update()
    assert (len(r.inserted), len(r.file_errors), len(r.data_errors)) == (2, 1, 1)
    cat.add_folder(str(lake), recursive=True)
    cat.update()
    cat.add_folder(str(lake), recursive=True)
    assert cat.update().inserted == []
    assert cat.next_id() == 4
    assert {(r.tableid, r.max_row_id, r.max_col_id) for r in cat.table("tables").collect()} == {(1, 2, 1), (2, 1, 1), (3, 1, 0)}
    assert cat.table("rows").count() == 4
    assert {r.token for r in cat.table("cells").where("tableid = 3").collect()} == {"z"}
    cat.drop()
    assert cat.next_id() == 1


def test_bulk_parsers():
    from lakeweave.sources import bulk

    assert bulk.parse("a.csv", b"x;y\n1;\"p\nq\"\n2\n") == ("read", (["x", "y"], [["1", "p\nq"], ["2", None]]))
    late = ("x,y\n" + "a,b\n" * 40_000 + "Z\xfcrich,c\n").encode("latin-1")
    assert bulk.parse("a.CSV", late)[1][1][-1] == ["Zürich", "c"]
    assert bulk.parse("a.tsv", b"p\tq\n007\tu\n1.50\tv\n") == ("read", (["p", "q"], [["7.0", "u"], ["1.5", "v"]]))
    assert bulk.parse("a.json", b'{"k": "a"}\n\n{"k": "b", "n": 1}\n') == ("read", (["k", "n"], [["a", None], ["b", "1"]]))
    assert bulk.parse("a.json", b'{"x": [1, 2], "y": ["p", null]}') == ("read", (["x", "y"], [["1", "p"], ["2", None]]))
    assert bulk.parse("a.json", b'{"x": {"0": 1, "1": 2}, "y": {"0": "p"}}') == ("read", (["x", "y"], [["1", "p"], ["2", None]]))
    arff = b"% c\n@relation r\n@attribute n numeric\n@attribute 's t' string\n@data\n1.5,@home\n?,'v, w'\n% no row\n"
    assert bulk.parse("a.arff", arff) == ("read", (["n", "s t"], [["1.5", "@home"], [None, "v, w"]]))
    for name, raw in (("a.csv", b""), ("a.csv", b"x,y\n"), ("b.csv", b"x,y\n1,2\n1,2,3\n"), ("a.json", b"{"), ("a.json", b'{"x": [1], "y": []}'), ("a.parquet", b"PAR"), ("a.arff", b"@attribute a string\nx\n")):
        assert bulk.parse(name, raw)[0] == "data error"
    assert bulk.parse("a.xyz", b"?")[0] == "file error"


def test_many_files_are_read_in_one_job(spark, tmp_path, monkeypatch):
    from lakeweave.sources import bulk

    monkeypatch.setattr(bulk, "FILES_PER_SCAN", 70)
    lake = tmp_path / "lake [x]"
    for i in range(150):
        (lake / f"k={i % 10}").mkdir(parents=True, exist_ok=True)
        (lake / f"k={i % 10}" / f"f{i}.csv").write_text("a,b\n" + "".join(f"v{i},{j}\n" for j in range(i % 4)))
    (lake / "k=0" / "_SUCCESS").write_text("")
    (lake / "k=0" / "broken.csv").write_text("a,b\n" + "1,2\n" * 5000 + "1,2,3\n")
    cat = LakeCatalog(spark, str(tmp_path / "index"), row_layout=True)
    cat.add_folder(str(lake), recursive=True)
    r = cat.update()
    assert (len(r.inserted), len(r.file_errors), len(r.data_errors)) == (112, 0, 39)
    assert cat.table("cells").count() == cat.table("cells_by_row").count() == 2 * sum(i % 4 for i in range(150))
    sizes = {x.dataset_name.rsplit("/", 1)[1]: x.max_row_id for x in cat.table("tables").collect()}
    assert sizes == {f"f{i}.csv": i % 4 for i in range(150) if i % 4}
    assert cat.table("headers").count() == 224 and cat.table("order_index").count() == 224


def test_text_options_look_at_the_whole_file(spark, tmp_path):
    late = "x;y\n" + "a;b\n" * 40_000 + "Zürich;c\n"
    (tmp_path / "late.csv").write_bytes(late.encode("latin-1"))
    (tmp_path / "quotes.csv").write_text('x,y\n1,"p\nq"\n')
    assert readers.text_options(spark, str(tmp_path / "late.csv")) == {"encoding": "ISO-8859-1", "multiLine": False}
    assert readers.read_csv(spark, str(tmp_path / "late.csv")).where("y = 'c'").first().x == "Zürich"
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "quotes.csv")).collect()] == [("1", "p\nq")]


def test_dataset_columns_are_checked(spark, tmp_path):
    (tmp_path / "d.csv").write_text(" x , y\n1,2\n")
    assert readers.read_dataset(spark, str(tmp_path / "d.csv"), ",", ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError, match="no column z"):
        readers.read_dataset(spark, str(tmp_path / "d.csv"), ",", ["x", "z"])


def test_posting_list_round_trip(spark):
    c = cells_of(spark, LAKE)
    back = lookup.unpacked_posting_list(lookup.packed_posting_list(c, spark.createDataFrame([("rome",), ("rome",)], "token string")))
    assert {tuple(r) for r in back.collect()} == {("rome", 1, 1, 0), ("rome", 1, 1, 2), ("rome", 2, 2, 0)}


def test_correlation_matrix_with_text(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 5.0)], "s string, x double")
    codes = np.corrcoef([0, 1, -1], [1, 2, 5])[0, 1]
    assert {(r.x, r.y): r.corr for r in correlate.correlation_matrix(df, ["s", "x"]).collect()}[("s", "x")] == pytest.approx(codes)
    assert df.agg(correlate.pearson(df, "x", "x")).first()[0] == pytest.approx(1.0)
    assert df.where(F.col("s") == "a").agg(correlate.pearson(df, "x", "x")).first()[0] is None


def test_duplicate_page(spark):
    from lakeweave.sources.html import duplicate_page

    c = cells_of(spark, {1: [["a<b"]], 2: [["a<b"]]})
    h = spark.createDataFrame([(1, 0, "h", "h"), (2, 0, "h", "h")], "tableid int, colid int, header string, header_tokenized string")
    rel = spark.createDataFrame([(1, 2)], "tableid_1 int, tableid_2 int")
    with pytest.raises(ValueError):
        duplicate_page(rel, c, h, most=0)
    page = duplicate_page(rel, c, h)
    assert "href='#t2'" in page and "a&lt;b" in page


def test_relations_of_repeated_rows_against_brute_force(spark):
    import random

    rng = random.Random(8)
    data = {t: [[rng.choice("abcd"), rng.choice("xy")] for _ in range(rng.randrange(1, 7))] for t in range(1, 25)}
    c = cells_of(spark, data)
    got = {(r.tableid_1, r.tableid_2): r.n_pairs for r in duplicates.duplicate_relations(c, index.row_signatures(c)).collect()}
    want = {}
    for a in data:
        for b in data:
            n = sum(sorted(x) == sorted(y) for x in data[a] for y in data[b])
            if a < b and n >= min(len(data[a]), len(data[b])):
                want[a, b] = n
    assert got == want


def test_contained_tables_against_brute_force(spark):
    rng = random.Random(9)
    data = {t: [[rng.choice("ab"), rng.choice("xyz")] for _ in range(rng.randrange(1, 6))] for t in range(1, 30)}
    data |= {t: [["nan", "nan"]] for t in range(40, 60)} | {60: [["nan", "nan"], ["q", "r"]], 61: [["nan", "nan"], ["nan", "nan"]]}
    c = cells_of(spark, data)
    sets = {t: {tuple(sorted(r)) for r in rows} for t, rows in data.items()}
    found = duplicates.contained_tables(c).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == {(a, b) for a in sets for b in sets if a < b and (sets[a] <= sets[b] or sets[b] <= sets[a])}
    classes = duplicates.contained_classes(c)
    assert classes.members.where("rep = 40").count() == 21  # one class of all copies, which meets others once
    assert classes.pairs.where("small = 40").count() == 1


def test_stream_append_is_repeatable(spark, tmp_path):
    from lakeweave.streaming.append import append_cells

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("0,Red fox\n1,Hen\n")

    def run():
        s = spark.readStream.schema("id int, name string").csv(str(tmp_path / "in"))
        append_cells(s, 5, "id", ["name"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {(r.token, r.rowid) for r in spark.read.parquet(str(tmp_path / "out" / "cells")).collect()}

    assert run() == {("red fox", 0), ("hen", 1)}
    (tmp_path / "in" / "b.csv").write_text("2,Cow\n")
    assert run() == {("red fox", 0), ("hen", 1), ("cow", 2)}
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 3
    # read with files that were indexed otherwise
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "a.csv").write_text("x,y\n1,Red\n")
    cat = LakeCatalog(spark, str(tmp_path / "out"))
    cat.add_folder(str(tmp_path / "lake"))
    cat.update()
    assert {tuple(r) for r in cat.table("tables").select("tableid", "max_row_id", "max_col_id").collect()} == {(5, 3, 0), (6, 1, 1)}
    assert cat.table("cells").count() == 5 and cat.table("headers").count() == 3 and cat.table("rows").count() == 4


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from lakeweave.plans.scratch import scratch_dir

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, applicationId="x"))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077"))
    assert scratch_dir(session("spark://host:7077", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    assert scratch_dir(spark)


def test_join_map_of_unjoined_rows(spark):
    pairs = spark.createDataFrame([(1, [0, 1], 2, 7), (1, [0, 1], 0, 5)], "tableid int, cols array<int>, ext_row int, input_row int")
    sizes = spark.createDataFrame([(1, 4), (2, 3)], "tableid int, max_row_id int")
    assert [(r.tableid, r.join_map) for r in joinsearch.join_map(pairs, sizes).collect()] == [(1, [5, -1, 7, -1])]


def test_discovery(spark):
    from lakeweave.discovery import Discovery

    cells = cells_of(spark, {1: [[f"k{i}", str(i * i)] for i in range(20)], 2: [[f"k{i}", str(i * i)] for i in range(20)], 3: [["x", "y"]]})
    headers = spark.createDataFrame([(t, c, n, n) for t in (1, 2, 3) for c, n in ((0, "key"), (1, "square"))], "tableid int, colid int, header string, header_tokenized string")
    data = spark.createDataFrame([(f"K{i}", float(i)) for i in range(20)], "name string, y double")
    rows = index.row_signatures(cells)
    with pytest.raises(ValueError):
        Discovery(data, ["name"], "missing", ["name"], cells, rows, headers)
    d = Discovery(data, ["name"], "y", ["name"], cells, rows, headers)
    with pytest.raises(ValueError):
        d.correlated()
    assert [(r.tableid, r.headers) for r in d.joinable(5).collect()] == [(1, ["key", "key"]), (2, ["key", "key"])]
    assert [tuple(r)[:2] for r in d.without_duplicates().collect()] == [(1, 2)]
    assert [(r.table_col_id, r.header, round(r.corr, 6)) for r in d.correlated(5).collect()] == [("1_1", "square", 1.0)]
    wide = d.enriched(1, [0], [1])
    assert wide.columns == ["name", "y", "1_1:square"] and dict(wide.dtypes)["1_1:square"] == "double"
    assert d.lowered().where("name = 'k3'").count() == 1
