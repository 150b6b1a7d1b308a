"""Queries over the test lake: index, lookups, join search, duplicates, correlation, enrichment."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.discovery import Discovery
from lakeweave.functions import hashing
from lakeweave.functions.text import clean_text
from lakeweave.operators import correlate, duplicates, enrich, evaluate, index, joinsearch, lookup
from lakeweave.plans import lake as L
from lakeweave.plans.scratch import scratch_dir, written
from lakeweave.sources import readers
from lakeweave.sources.catalog import SCHEMAS, LakeCatalog
from lakeweave.sources.html import duplicate_page
from lakeweave.streaming.append import append_cells

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


CELLS = L.sql_cells()
DISTINCT = "SELECT DISTINCT token FROM cells"
CLEAN = L.sql_clean


def text_of(cols: str) -> Column:
    return F.array_join(F.transform(cols, lambda c: c.cast("string")), "_")


# -- index ---------------------------------------------------------------


@query(f"{CELLS} SELECT value, token FROM vocab WHERE value IS NOT NULL")
def L1_clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = None
    for t in L.tables(spark, sf_dir):
        one = t.df.select(F.explode(F.array(*(F.col(c).cast("string") for c in t.names()))).alias("value"))
        raw = one if raw is None else raw.unionByName(one)
    return raw.where("value IS NOT NULL").distinct().select("value", clean_text(F.col("value")).alias("token"))


@query(f"{CELLS} SELECT * FROM cells")
def H8_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_cells(L.tables(spark, sf_dir))


@query(f"""{CELLS} SELECT rowid, {', '.join(f"max(CASE WHEN colid = {i} AND token <> '' AND NOT regexp_matches(token, 'nan|unknown|null|none') THEN token END) AS {c}" for i, c in enumerate(L.TABLES[3][2]))}
    FROM cells WHERE tableid = 4 GROUP BY rowid""")
def F9_pivot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return lookup.wide_table(lake.cells, lake.headers, 4)


_HEADERS = ", ".join(f"({i}, {k}, '{c}')" for i, _, cols, _, _ in L.TABLES for k, c in enumerate(cols))


@query(f"SELECT tableid, colid, header, {CLEAN('header')} AS header_tokenized FROM (VALUES {_HEADERS}) AS h(tableid, colid, header)")
def M3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_headers(spark, L.tables(spark, sf_dir))


@query(f"""{CELLS} SELECT tableid, dataset_name, CAST(max(rowid) + 1 AS INT) AS max_row_id, max(colid) AS max_col_id FROM cells
    JOIN (VALUES {', '.join(f"({i}, '{n}')" for i, n, *_ in L.TABLES)}) AS t(tableid, dataset_name) USING (tableid) GROUP BY ALL""")
def M4_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lake(spark, sf_dir).info


@query(f"{CELLS} SELECT table_col_id, bool_and(regexp_matches(token, '^([0-9]+(e[0-9]+)?|nan|inf|infinity|)$')) AS is_numeric FROM cells GROUP BY 1")
def L7_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.numeric_columns(L.lake(spark, sf_dir).cells)


@query(f"{CELLS}, {L.sql_xash(DISTINCT)} SELECT token, array_to_string(ps, ',') AS bits FROM xash")
def H1_xash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = L.lake(spark, sf_dir).cells.select("token").distinct()
    return tokens.select("token", F.array_join(hashing.xash_positions("token").cast("array<string>"), ",").alias("bits"))


_VARIANTS = [(s, r) for s in (64, 128, 256, 512) for r in (True, False)]


def _sql_xash_variants(tokens: str) -> str:
    return (f"{CELLS}, {', '.join(L.sql_xash(tokens, s, r, name=f'x{s}{int(r)}') for s, r in _VARIANTS)} "
            + " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS hash_size, {str(r).lower()} AS rotation, token, {L.sql_bits('ps', s)} AS bits FROM x{s}{int(r)}" for s, r in _VARIANTS))


def _xash_variants(tokens: DataFrame) -> DataFrame:
    """(hash_size, rotation, token, bits): all variants are made of one look at a token.

    Tokens are short and their signatures long, so they are dealt out to all
    cores and not by their bytes.
    """
    letters = L.spread(tokens, "token").select("token", hashing.xash_letters("token").alias("x"))
    variants = [
        F.struct(F.lit(s).alias("hash_size"), F.lit(r).alias("rotation"), hashing.position_string(hashing.xash_placed("x", s, r), s).alias("bits")) for s, r in _VARIANTS
    ]
    return letters.select("token", F.explode(F.array(*variants)).alias("v")).select("v.hash_size", "v.rotation", "token", "v.bits")


@query(_sql_xash_variants(DISTINCT))
def H1_xash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xash_variants(L.tokens(spark, sf_dir))


_KEYS = f"""{L.sql_xash(DISTINCT)},
    rk AS MATERIALIZED (SELECT tableid, rowid, list(DISTINCT p) AS ps FROM (SELECT tableid, rowid, unnest(ps) AS p FROM cells JOIN xash USING (token)) GROUP BY ALL)"""


@query(f"{CELLS}, {_KEYS} SELECT tableid, rowid, {L.sql_bits('ps')} AS super_key FROM rk")
def H2_super_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lake(spark, sf_dir).rows.select("tableid", "rowid", hashing.bit_string(F.col("key"), 128).alias("super_key"))


@query(f"{CELLS} SELECT DISTINCT token, array_to_string(list_transform(string_split(md5(token), ''), lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', h) - 1) + 1, 4)), '') AS bits FROM cells")
def L4_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = L.lake(spark, sf_dir).cells.select("token").distinct()
    return tokens.select("token", hashing.bit_string(hashing.md5_words(F.col("token")), 128).alias("bits"))


def _sql_simhash(tokens: str) -> str:
    return f"""{CELLS}, t AS (SELECT token, regexp_replace(lower(token), '[^a-z0-9_]+', '', 'g') AS s FROM ({tokens})),
    sh AS (SELECT token, md5(substr(s, CAST(i AS INT), 3)) AS h FROM (SELECT token, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM t)),
    b AS (SELECT token, bit, sum((strpos('0123456789abcdef', substr(h, CAST(32 - bit // 4 AS INT), 1)) - 1) >> (bit % 4) & 1) AS ones, count(*) AS n
        FROM sh, (SELECT unnest(range(128)) AS bit) GROUP BY token, bit)
    SELECT token, array_to_string(list(bit ORDER BY bit) FILTER (2 * ones > n), ',') AS bits FROM b GROUP BY token"""


def _simhash(tokens: DataFrame) -> DataFrame:
    return tokens.select("token", F.array_join(hashing.simhash_positions("token").cast("array<string>"), ",").alias("bits"))


@query(_sql_simhash(DISTINCT))
def L5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash(L.lake(spark, sf_dir).cells.select("token").distinct())


def _sql_bloom(token: str, size: int, hashes: int) -> str:
    return f"list_distinct([CAST(('0x' || substr(md5(s || ':' || {token}), 1, 8))::BIGINT % {size} AS INT) FOR s IN {list(map(str, range(hashes)))}])"


@query(f"""{CELLS}, b AS MATERIALIZED (SELECT token, {_sql_bloom('token', 128, 5)} AS ps FROM ({DISTINCT}) WHERE token <> ''),
    r AS (SELECT tableid, rowid, list(DISTINCT p) AS ps FROM (SELECT tableid, rowid, unnest(ps) AS p FROM cells JOIN b USING (token)) GROUP BY ALL),
    q AS (SELECT DISTINCT token FROM cells WHERE table_col_id = '1_1')
    SELECT q.token, tableid, count(*) AS maybe FROM q JOIN b USING (token) JOIN r ON list_has_all(r.ps, b.ps) GROUP BY ALL""")
def H3_bloom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every region name the rows of each table whose Bloom filter may hold it."""
    cells, sig = L.lake(spark, sf_dir).cells, hashing.bloom(128, 5)
    rows = index.row_signatures(cells, sig)
    probes = cells.where("table_col_id = '1_1'").select("token").distinct().withColumn("w", sig.words("token"))
    return rows.join(probes, hashing.contained(F.col("w"), F.col("key"), 128)).groupBy("token", "tableid").agg(F.count(F.lit(1)).alias("maybe"))


@query("SELECT items, p, CAST(floor(-(items * ln(p)) / (ln(2) * ln(2))) AS INT) AS bits, CAST(floor(floor(-(items * ln(p)) / (ln(2) * ln(2))) / items * ln(2)) AS INT) AS hashes FROM (VALUES (6), (100), (5000)) AS a(items), (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) AS b(p)")
def H4_bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, p, hashing.bloom_size(n, p), hashing.bloom_hashes(hashing.bloom_size(n, p), n)) for n in (6, 100, 5000) for p in (0.05, 0.01)]
    return spark.createDataFrame(rows, "items int, p double, bits int, hashes int")


@query(f"""{CELLS}, q AS (SELECT DISTINCT token FROM cells WHERE table_col_id = '8_0')
    SELECT tableid || '_' || rowid || ';' || colid || '_' || token AS entry FROM cells SEMI JOIN q USING (token)""")
def F1_posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.lake(spark, sf_dir).cells
    return lookup.packed_posting_list(cells, cells.where("table_col_id = '8_0'"))


@query(f"""{CELLS}, {_KEYS}, q AS (SELECT DISTINCT token FROM cells WHERE table_col_id = '8_0')
    SELECT token, tableid, colid, rowid, {L.sql_bits('ps')} AS super_key FROM cells SEMI JOIN q USING (token) JOIN rk USING (tableid, rowid)""")
def F2_posting_list_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    hits = lookup.posting_list_with_key(lake.cells, lake.rows, lake.cells.where("table_col_id = '8_0'"))
    return hits.select("token", "tableid", "colid", "rowid", hashing.bit_string(F.col("key"), 128).alias("super_key"))


@query(f"""{CELLS}, q AS (SELECT DISTINCT tableid, rowid FROM cells WHERE token IN (SELECT token FROM cells WHERE table_col_id = '1_1'))
    SELECT * FROM cells SEMI JOIN q USING (tableid, rowid)""")
def F3_rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.lake(spark, sf_dir).cells
    return lookup.rows_by_id(cells, lookup.posting_list(cells, cells.where("table_col_id = '1_1'"))).select("token", "tableid", "colid", "rowid", "table_col_id")


@query(f"""{CELLS}, {_KEYS}, k AS (SELECT DISTINCT list_sort(ps) AS ps FROM rk WHERE tableid = 7)
    SELECT cells.* FROM cells JOIN rk USING (tableid, rowid) JOIN k ON k.ps = list_sort(rk.ps)""")
def F5_rows_by_super_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    found = lookup.rows_by_key(lake.cells, lake.rows, lake.rows.where("tableid = 7"))
    return found.select("token", "tableid", "colid", "rowid", "table_col_id").orderBy("tableid", "rowid", "colid")


@query(f"{CELLS}, {_KEYS} SELECT token, tableid, colid, rowid, {L.sql_bits('ps')} AS super_key FROM cells JOIN rk USING (tableid, rowid) WHERE tableid IN (2, 6, 7)")
def F6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return lookup.tables(lake.cells, lake.rows, [2, 6, 7]).select("token", "tableid", "colid", "rowid", hashing.bit_string(F.col("key"), 128).alias("super_key"))


@query(f"{CELLS} SELECT * FROM cells WHERE table_col_id IN ('4_4', '9_1')")
def F7_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.columns(L.lake(spark, sf_dir).cells, ["4_4", "9_1"]).select("token", "tableid", "colid", "rowid", "table_col_id")


@query(f"{CELLS} SELECT table_col_id, array_to_string(list(rowid ORDER BY rowid), ',') AS rowids, array_to_string(list(token ORDER BY rowid), ',') AS tokens FROM cells WHERE table_col_id IN ('2_1', '9_3') GROUP BY 1")
def A23_column_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lookup.column_arrays(L.lake(spark, sf_dir).cells, ["2_1", "9_3"])
    return packed.select("table_col_id", F.array_join(F.col("rowids").cast("array<string>"), ",").alias("rowids"), F.array_join("tokens", ",").alias("tokens"))


@query(f"""{CELLS}, q AS (SELECT DISTINCT token FROM cells WHERE table_col_id = '8_0')
    SELECT table_col_id, count(DISTINCT token) AS overlap FROM cells SEMI JOIN q USING (token) GROUP BY 1 ORDER BY overlap DESC, table_col_id LIMIT 10""")
def A1_joinable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.lake(spark, sf_dir).cells
    return lookup.joinable_columns(cells, cells.where("table_col_id = '8_0'"), 10)


_ROWS_ONLY = f"""{CELLS}, num AS (SELECT table_col_id, bool_and(regexp_matches(token, '^([0-9]+(e[0-9]+)?|nan|inf|infinity|)$')) AS is_numeric FROM cells GROUP BY 1),
    val AS (SELECT table_col_id, rowid, token, is_numeric, CASE WHEN is_numeric AND token NOT IN ('', 'nan') THEN TRY_CAST(token AS DOUBLE) END AS x,
        CASE WHEN NOT is_numeric THEN CASE WHEN token = '' THEN 'nan' ELSE token END END AS c FROM cells JOIN num USING (table_col_id)),
    rk0 AS (SELECT *, rank() OVER (PARTITION BY table_col_id ORDER BY x NULLS LAST, c NULLS LAST) + (count(*) OVER (PARTITION BY table_col_id, x, c) - 1) / 2 AS rk FROM val)"""


@query(f"{_ROWS_ONLY} SELECT table_col_id, rowid, token, is_numeric, CAST(rk AS DOUBLE) AS rk FROM rk0")
def W1_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.column_ranks(L.lake(spark, sf_dir).cells)


_ORDER = f"""{_ROWS_ONLY}, nx AS (SELECT *, coalesce(lead(rowid) OVER w, -1) AS nxt, CASE WHEN lead(rk) OVER w <> rk THEN '1' ELSE '0' END AS flag,
        first_value(rowid) OVER w AS lo FROM rk0 WINDOW w AS (PARTITION BY table_col_id ORDER BY rk, rowid)),
    oi AS (SELECT table_col_id, is_numeric, min(lo) AS min_index, array_to_string(list(nxt ORDER BY rowid), ',') AS order_list, string_agg(flag, '' ORDER BY rowid) AS binary_list
        FROM nx GROUP BY 1, 2)"""


@query(f"{_ORDER} SELECT * FROM oi")
def H7_order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    oi = index.order_index(L.lake(spark, sf_dir).cells)
    return oi.withColumn("order_list", F.array_join(F.col("order_list").cast("array<string>"), ","))


@query(f"{_ROWS_ONLY} SELECT table_col_id, rowid, CAST(rk AS DOUBLE) AS rk FROM rk0")
def W6_ranks_from_order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks told from the stored order of every table's columns."""
    return index.order_ranks(index.order_blocks(L.lake(spark, sf_dir).cells))


@query(f"{_ORDER} SELECT * FROM oi WHERE table_col_id IN ('9_1', '9_3')")
def F8_order_index_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch of two columns' orders, stored in the text encoding and decoded again."""
    oi = index.order_index(L.lake(spark, sf_dir).cells.where("table_col_id IN ('9_1', '9_3')"))
    stored = oi.select(
        "table_col_id", "is_numeric", "min_index", F.array_join(F.col("order_list").cast("array<string>"), ",").alias("order_list"),
        F.array_join(F.split(F.translate("binary_list", "10", "TF"), ""), ",").alias("binary_list"),
    )
    back = index.decode_order_index(stored)
    return back.withColumns({c: F.array_join(F.col(c).cast("array<string>"), s) for c, s in (("order_list", ","), ("binary_list", ""))})


# -- join search ---------------------------------------------------------


def _sql_query(q, cols: list[str]) -> str:
    cleaned = ", ".join(f"left({CLEAN(c)}, 200) AS q{i}" for i, c in enumerate(cols))
    ok = " AND ".join(f"q{i} NOT IN ('', 'nan', 'unknown')" for i in range(len(cols)))
    return f"""ds AS MATERIALIZED ({L.sql_dataset(q)}),
        q AS MATERIALIZED (SELECT * FROM (SELECT input_row, {cleaned} FROM (SELECT {', '.join(cols)}, min(input_row) AS input_row FROM ds GROUP BY ALL)) WHERE {ok})"""


def _sql_search(q, cols: list[str], k: int) -> str:
    n = len(cols)
    further = range(1, n) if n > 1 else [0]
    at = ", ".join(f"list(c.colid ORDER BY c.colid) FILTER (c.token = q{j}) AS at{j}" for j in further)
    some = " AND ".join(f"at{j} IS NOT NULL" for j in further)
    joined = "".join(f" || at{j}" for j in further)
    return f"""{_sql_query(q, cols)},
        hit AS (SELECT h.tableid, h.rowid, h.colid, q.* FROM cells h JOIN q ON h.token = q.q0),
        placed AS (SELECT h.tableid, h.rowid, h.colid, h.input_row, {at} FROM hit h JOIN cells c ON c.tableid = h.tableid AND c.rowid = h.rowid GROUP BY ALL),
        mt AS MATERIALIZED (SELECT tableid, rowid, input_row, [colid]{joined} AS cols FROM placed WHERE {some}),
        ct AS (SELECT tableid, cols, count(*) AS score FROM mt GROUP BY ALL),
        best AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY tableid ORDER BY score DESC, cols) = 1),
        top AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY score DESC, tableid) AS INT) AS rank, * FROM best ORDER BY score DESC, tableid LIMIT {k}),
        prs AS MATERIALIZED (SELECT tableid, cols, rowid AS ext_row, max(input_row) AS input_row FROM mt SEMI JOIN top USING (tableid, cols) GROUP BY ALL)"""


_TOP = "SELECT rank, score, score - 1 AS score_ref, tableid, array_to_string(cols, '_') AS cols FROM top"
_S1, _S2, _S3 = _sql_search(L.Q1, ["n_name", "r_name"], 20), _sql_search(L.Q2, ["r_name"], 20), _sql_search(L.Q3, ["p_brand", "p_type"], 20)


def _search(spark, sf_dir, q, cols, k=20, **options) -> joinsearch.JoinSearch:
    data, order = L.dataset(spark, sf_dir, q)
    lake = L.lake(spark, sf_dir)
    options.setdefault("rows", lake.rows)
    return joinsearch.join_search(lake.cells, joinsearch.prepare(data, cols, order), k, 200, **options)


def _tables(s: joinsearch.JoinSearch) -> DataFrame:
    return s.tables.withColumn("cols", text_of("cols"))


@query(f"{CELLS}, {_S1} {_TOP}")
def C1_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"]))


@query(f"{CELLS}, {_S1} {_TOP}")
def C2_join_search_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"], rows=None))


@query(f"{CELLS}, {_S1} {_TOP}")
def C3_join_search_nohash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"], use_hash=False))


@query(f"{CELLS}, {_S1} {_TOP}")
def C4_join_search_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"], rows=None, signature=hashing.bloom(128, -1)))


@query(f"{CELLS}, {_S2} {_TOP}")
def C1_join_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q2, ["r_name"]))


@query(f"{CELLS}, {_S3} {_TOP}")
def C1_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_search(spark, sf_dir, L.Q3, ["p_brand", "p_type"]))


@query(f"{CELLS}, {_sql_search(L.Q1, ['n_name', 'r_name'], 2)} {_TOP}")
def K4_early_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best tables; tables that can't be among them aren't looked at."""
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"], 2, early=True))


#: Hits that a table must have more of than this.
_RATIO = 12


@query(f"""{CELLS}, {_S1.replace("hit AS (SELECT h.tableid", f"ok AS (SELECT tableid FROM cells h JOIN (SELECT DISTINCT q0 FROM q) x ON h.token = x.q0 GROUP BY 1 HAVING count(*) > {_RATIO}), hit AS (SELECT h.tableid").replace("h.token = q.q0)", "h.token = q.q0 WHERE h.tableid IN (SELECT tableid FROM ok))")} {_TOP}""")
def F12_min_join_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tables with enough hits of the first query column are looked at."""
    return _tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"], min_join_ratio=_RATIO))


@query(f"{CELLS}, {_S1} {_TOP} WHERE rank <= 1")
def F15_keep_joinable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.keep_ranks(_tables(_search(spark, sf_dir, L.Q1, ["n_name", "r_name"])), 1)


@query(f"""{CELLS}, {_S1}, h AS (VALUES {_HEADERS})
    SELECT rank, tableid, array_to_string(list(coalesce(col2, '?') ORDER BY i), ',') AS headers FROM
        (SELECT rank, tableid, unnest(cols) AS colid, unnest(range(len(cols))) AS i FROM top) t LEFT JOIN h ON col0 = tableid AND col1 = colid GROUP BY ALL""")
def C13_joined_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _search(spark, sf_dir, L.Q1, ["n_name", "r_name"])
    return enrich.header_of(s.tables, L.lake(spark, sf_dir).headers).select("rank", "tableid", F.array_join("headers", ",").alias("headers"))


@query(f"""{CELLS}, {_S1}, sz AS (SELECT tableid, max(rowid) AS hi FROM cells GROUP BY 1),
    ex AS (SELECT tableid, cols, unnest(range(hi + 1)) AS ext_row FROM top JOIN sz USING (tableid))
    SELECT tableid, array_to_string(cols, '_') AS cols, array_to_string(list(coalesce(input_row, -1) ORDER BY ext_row), ',') AS join_map FROM ex LEFT JOIN prs USING (tableid, cols, ext_row) GROUP BY ALL""")
def J5_join_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _search(spark, sf_dir, L.Q1, ["n_name", "r_name"])
    m = joinsearch.join_map(s.pairs, L.lake(spark, sf_dir).info)
    return m.select("tableid", text_of("cols").alias("cols"), F.array_join(F.col("join_map").cast("array<string>"), ",").alias("join_map"))


@query(f"""{CELLS}, {_S1} SELECT token, cells.tableid, colid, rowid, ext_row IS NOT NULL AS is_matched
    FROM cells LEFT JOIN (SELECT DISTINCT ext_row FROM prs WHERE tableid = 8) ON rowid = ext_row WHERE cells.tableid = 8""")
def F16_highlighted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _search(spark, sf_dir, L.Q1, ["n_name", "r_name"])
    return joinsearch.highlighted(L.lake(spark, sf_dir).cells, s.pairs, 8).select("token", "tableid", "colid", "rowid", "is_matched")


_Q_KEYS = "qk AS (SELECT input_row, list_distinct(a.ps || b.ps) AS qps FROM q JOIN qx a ON a.token = q0 JOIN qx b ON b.token = q1)"


@query(f"""{CELLS}, {_KEYS}, {_S1}, {L.sql_xash('SELECT q0 AS token FROM q UNION SELECT q1 FROM q', name='qx')}, {_Q_KEYS},
    f AS (SELECT list_has_all(ps, qps) AS kept FROM hit JOIN rk USING (tableid, rowid) JOIN qk USING (input_row)), g AS (SELECT count(*) FILTER (NOT kept) AS nf, count(*) FILTER (kept) AS na FROM f)
    SELECT nf AS total_filtered, na AS total_approved, m AS matching_rows, na - m AS total_fp, round(m / greatest(na, 1), 6) AS precision FROM g, (SELECT count(*) AS m FROM mt)""")
def A20_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, L.Q1, ["n_name", "r_name"]).stats.withColumn("precision", F.round("precision", 6))


def _sql_variant(size: int, rotation: bool) -> tuple[str, str]:
    """CTEs and SELECT of the filter's counters for one kind of signature."""
    v = f"{size}{int(rotation)}"
    ctes = f"""{L.sql_xash(DISTINCT, size, rotation, name='x' + v)},
        rk{v} AS (SELECT tableid, rowid, list(DISTINCT p) AS ps FROM (SELECT tableid, rowid, unnest(ps) AS p FROM cells JOIN x{v} USING (token)) GROUP BY ALL),
        {L.sql_xash('SELECT q0 AS token FROM q UNION SELECT q1 FROM q', size, rotation, name='y' + v)},
        qk{v} AS (SELECT input_row, list_distinct(a.ps || b.ps) AS qps FROM q JOIN y{v} a ON a.token = q0 JOIN y{v} b ON b.token = q1),
        g{v} AS (SELECT count(*) FILTER (NOT list_has_all(ps, qps)) AS nf, count(*) FILTER (list_has_all(ps, qps)) AS na FROM hit JOIN rk{v} USING (tableid, rowid) JOIN qk{v} USING (input_row))"""
    return ctes, f"""SELECT CAST({size} AS INT) AS hash_size, {str(rotation).lower()} AS rotation, nf AS total_filtered, na AS total_approved, m AS matching_rows,
        na - m AS total_fp, round(m / greatest(na, 1), 6) AS precision FROM g{v}, (SELECT count(*) AS m FROM mt)"""


@query(f"{CELLS}, {_S1}, {', '.join(_sql_variant(*v)[0] for v in _VARIANTS)} {' UNION ALL '.join(_sql_variant(*v)[1] for v in _VARIANTS)}")
def C12_xash_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the signature filter for every signature size, with and without rotation."""
    out = None
    for size, rotation in _VARIANTS:
        s = _search(spark, sf_dir, L.Q1, ["n_name", "r_name"], rows=None, signature=hashing.xash(size, rotation))
        one = s.stats.select(F.lit(size).alias("hash_size"), F.lit(rotation).alias("rotation"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("precision", F.round("precision", 6)).orderBy(F.desc("precision"), "hash_size", "rotation")


# -- correlation ---------------------------------------------------------

_TARGET = """tg AS MATERIALIZED (SELECT input_row, CAST(rank() OVER (ORDER BY {t}) + (count(*) OVER (PARTITION BY {t}) - 1) / 2 AS DOUBLE) AS t FROM ds)"""
_KIND = "kind AS (SELECT table_col_id, bool_and(regexp_matches(token, '^([0-9]+(e[0-9]+)?|nan|inf|infinity|)$')) AS is_numeric FROM cells GROUP BY 1)"
_SCORES = """jc AS MATERIALIZED (SELECT f.grp, f.fid, f.is_numeric, f.token, f.rowid, p.input_row FROM feat f JOIN pairs p ON p.grp = f.grp AND p.ext_row = f.rowid),
    nr AS (SELECT grp, fid, rowid, input_row, rank() OVER (PARTITION BY grp, fid ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY grp, fid, x) - 1) / 2 AS e
        FROM (SELECT *, CASE WHEN token NOT IN ('', 'nan') THEN TRY_CAST(token AS DOUBLE) END AS x FROM jc WHERE is_numeric)),
    n1 AS (SELECT grp, fid, input_row, arg_max(e, (e, rowid)) AS e FROM nr GROUP BY ALL),
    fs AS (SELECT DISTINCT grp, fid FROM nr),
    nx AS (SELECT fs.grp, fs.fid, t, coalesce(e, ceil((SELECT count(*) FROM tg) / 2)) AS e FROM fs CROSS JOIN tg LEFT JOIN n1 ON n1.grp = fs.grp AND n1.fid = fs.fid AND n1.input_row = tg.input_row),
    cn AS (SELECT grp, fid, true AS is_numeric, CASE WHEN stddev_pop(e) > 0 AND stddev_pop(t) > 0 THEN corr(t, e) END AS corr FROM nx GROUP BY ALL),
    cv AS (SELECT DISTINCT grp, fid, CASE WHEN token = '' THEN 'nan' ELSE token END AS c, input_row FROM jc WHERE NOT is_numeric),
    cx AS (SELECT v.grp, v.fid, v.c, t, CASE WHEN w.input_row IS NULL THEN 0 ELSE 1 END AS o FROM (SELECT DISTINCT grp, fid, c FROM cv) v CROSS JOIN tg
        LEFT JOIN cv w ON w.grp = v.grp AND w.fid = v.fid AND w.c = v.c AND w.input_row = tg.input_row),
    cc AS (SELECT grp, fid, c, CASE WHEN stddev_pop(o) > 0 AND stddev_pop(t) > 0 THEN abs(corr(t, o)) END AS r FROM cx GROUP BY ALL),
    sc AS (SELECT * FROM cn UNION ALL SELECT grp, fid, false, max(r) FROM cc GROUP BY ALL)"""
_MULTI = f"""{_KIND}, {_S1}, {_TARGET.format(t='avg_bal')}, pairs AS (SELECT CAST(tableid AS VARCHAR) AS grp, ext_row, input_row FROM prs),
    kc AS (SELECT DISTINCT tableid, unnest(cols) AS colid FROM prs),
    feat AS (SELECT CAST(tableid AS VARCHAR) AS grp, table_col_id AS fid, is_numeric, token, rowid FROM cells JOIN kind USING (table_col_id)
        WHERE tableid IN (SELECT tableid FROM prs) AND (tableid, colid) NOT IN (SELECT tableid, colid FROM kc)), {_SCORES}"""


def _multi_inputs(spark, sf_dir):
    data, order = L.dataset(spark, sf_dir, L.Q1)
    s = _search(spark, sf_dir, L.Q1, ["n_name", "r_name"])
    targets = correlate.target_ranks(joinsearch.numbered(data, order), "avg_bal")
    return L.lake(spark, sf_dir).cells, written(s.pairs, "pairs"), targets


@query(f"{CELLS}, {_MULTI} SELECT fid AS table_col_id, is_numeric, round(corr, 6) AS corr FROM sc")
def C6_column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, pairs, targets = _multi_inputs(spark, sf_dir)
    keys = pairs.select("tableid", F.explode("cols").alias("colid")).distinct()
    scores = correlate.column_scores(cells.join(keys, ["tableid", "colid"], "left_anti"), pairs, targets)
    return scores.select("table_col_id", "is_numeric", F.round("corr", 6).alias("corr"))


@query(f"{CELLS}, {_MULTI} SELECT CAST(row_number() OVER (ORDER BY abs(corr) DESC, fid) AS INT) AS rank, round(corr, 6) AS corr, fid AS table_col_id, is_numeric FROM sc WHERE corr IS NOT NULL ORDER BY rank LIMIT 10")
def C6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.enrich_multicolumn(*_multi_inputs(spark, sf_dir), 10).withColumn("corr", F.round("corr", 6))


@query(f"""{CELLS}, {_MULTI} SELECT fid AS table_col_id, input_row, CAST(e AS DOUBLE) AS e FROM n1""")
def W6_joined_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the joined rows in every numeric column of the joined tables, told from the stored order."""
    cells, pairs, _ = _multi_inputs(spark, sf_dir)
    keys = pairs.select("tableid", F.explode("cols").alias("colid")).distinct()
    own = cells.join(pairs.select("tableid").distinct(), "tableid", "left_semi").join(keys, ["tableid", "colid"], "left_anti")
    return index.joined_ranks(index.order_blocks(own).where("is_numeric"), pairs)


@query(f"""{_ROWS_ONLY} SELECT table_col_id, dense_rank AS run, count(*) AS n, min(rowid) AS first_row
    FROM (SELECT table_col_id, rowid, dense_rank() OVER (PARTITION BY table_col_id ORDER BY c NULLS LAST) AS dense_rank FROM val WHERE NOT is_numeric) GROUP BY ALL""")
def W7_category_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal categories along the stored order of every column that isn't numeric."""
    return index.category_runs(index.order_blocks(L.lake(spark, sf_dir).cells))


@query(f"{CELLS}, {_MULTI} SELECT count(*) AS evaluated_features, round(max(abs(corr)), 6) AS max_corr_coeff FROM sc")
def A21_correlation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C6_column_scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("evaluated_features"), F.max(F.abs("corr")).alias("max_corr_coeff"))


_SINGLE = f"""{_KIND}, {_sql_query(L.Q1, ['n_name'])}, {_TARGET.format(t='avg_bal')},
    jn AS (SELECT table_col_id, count(DISTINCT token) AS overlap FROM cells SEMI JOIN q ON token = q0 GROUP BY 1 ORDER BY overlap DESC, table_col_id LIMIT 6),
    lt AS (SELECT tableid, table_col_id AS jcol, token, max(rowid) AS ext_row FROM cells SEMI JOIN jn USING (table_col_id) GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT jcol || '|' || tableid AS grp, tableid, jcol, ext_row, max(input_row) AS input_row FROM lt JOIN q ON token = q0 GROUP BY ALL),
    feat AS (SELECT g.grp, c.table_col_id AS fid, is_numeric, token, rowid FROM cells c JOIN kind USING (table_col_id) JOIN (SELECT DISTINCT grp, tableid, jcol FROM pairs) g ON g.tableid = c.tableid AND g.jcol <> c.table_col_id),
    {_SCORES}"""


@query(f"""{CELLS}, {_SINGLE} SELECT CAST(row_number() OVER (ORDER BY corr DESC, fid, grp) AS INT) AS rank, round(corr, 6) AS corr, fid AS table_col_id, is_numeric, split_part(grp, '|', 1) AS join_col
    FROM sc WHERE corr IS NOT NULL ORDER BY rank LIMIT 10""")
def C5_enrich_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, order = L.dataset(spark, sf_dir, L.Q1)
    targets = correlate.target_ranks(joinsearch.numbered(data, order), "avg_bal")
    cells = L.lake(spark, sf_dir).cells
    found = correlate.enrich_single(cells, joinsearch.prepare(data, ["n_name"], order), targets, 10, 6)
    return found.withColumn("corr", F.round("corr", 6))


# -- duplicates ----------------------------------------------------------

_VALS = "v AS MATERIALIZED (SELECT tableid, rowid, list(token ORDER BY token) AS vals FROM cells GROUP BY ALL)"


@query(f"{CELLS}, {_VALS} SELECT DISTINCT v.tableid FROM v JOIN v p ON p.tableid = 7 AND p.rowid = 0 AND p.vals = v.vals")
def C8_duplicate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return duplicates.duplicate_tables(lake.cells, lake.rows, 7)


@query(f"{CELLS}, {_VALS} " + " UNION ALL ".join(f"(SELECT DISTINCT v.tableid FROM v JOIN v p ON p.tableid = {t} AND p.rowid = 0 AND p.vals = v.vals)" for t in (2, 6, 7)))
def U1_duplicates_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return duplicates.duplicates_of_all(lake.cells, lake.rows, [2, 6, 7])


_REL = f"""{_VALS}, sz AS (SELECT tableid, count(*) AS n FROM v GROUP BY 1),
    eq AS (SELECT a.tableid AS tableid_1, b.tableid AS tableid_2, count(*) AS n_pairs FROM v a JOIN v b ON a.vals = b.vals AND a.tableid < b.tableid GROUP BY ALL),
    rel AS (SELECT eq.* FROM eq JOIN sz s1 ON s1.tableid = tableid_1 JOIN sz s2 ON s2.tableid = tableid_2 WHERE n_pairs >= least(s1.n, s2.n))"""


@query(f"{CELLS}, {_REL} SELECT * FROM rel")
def C9_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return duplicates.duplicate_relations(lake.cells, lake.rows)


@query(f"""{CELLS}, {_VALS}, sz AS (SELECT tableid, count(*) AS n FROM v GROUP BY 1),
    d AS (SELECT a.tableid AS tableid_1, b.tableid AS tableid_2, count(*) AS n_pairs, count(DISTINCT a.rowid) AS m1, count(DISTINCT b.rowid) AS m2 FROM v a JOIN v b ON a.vals = b.vals AND a.tableid < b.tableid GROUP BY ALL)
    SELECT tableid_1, tableid_2, n_pairs FROM d JOIN sz s1 ON s1.tableid = tableid_1 JOIN sz s2 ON s2.tableid = tableid_2 WHERE CASE WHEN s1.n <= s2.n THEN m1 = s1.n ELSE m2 = s2.n END""")
def A12_distinct_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate tables, every row of the smaller one having a partner."""
    lake = L.lake(spark, sf_dir)
    return duplicates.duplicate_relations(lake.cells, lake.rows, distinct=True)


@query(f"""{CELLS}, {_VALS}, p AS (SELECT rowid, vals FROM v WHERE tableid = 7)
    SELECT v.tableid FROM v JOIN p ON p.vals = v.vals GROUP BY 1 HAVING count(DISTINCT p.rowid) = (SELECT count(*) FROM p)""")
def A12_full_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that hold all rows of a table."""
    lake = L.lake(spark, sf_dir)
    return duplicates.duplicate_tables(lake.cells, lake.rows, 7, full=True)


@query(f"""{CELLS}, {_REL}, p AS (SELECT tableid_1 AS a, tableid_2 AS b FROM rel UNION ALL SELECT tableid_2, tableid_1 FROM rel)
    SELECT a AS tableid, string_agg(b, ',' ORDER BY b) AS partners FROM (SELECT DISTINCT a, b FROM p) GROUP BY a""")
def S21_duplicate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of the page of duplicate tables and their links."""
    lake = L.lake(spark, sf_dir)
    page = duplicate_page(duplicates.duplicate_relations(lake.cells, lake.rows), lake.cells, lake.headers)
    sections = re.findall(r"<h2 id='t(\d+)'>.*?<p>Same rows as (.*?)</p>", page)
    return spark.createDataFrame([(int(t), ",".join(re.findall(r"#t(\d+)", links))) for t, links in sections], "tableid int, partners string")


@query(f"{CELLS}, {_REL} SELECT DISTINCT tableid FROM cells WHERE tableid NOT IN (SELECT tableid_2 FROM rel)")
def C10_remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return duplicates.remove_duplicates(lake.info.select("tableid"), duplicates.duplicate_relations(lake.cells, lake.rows))


@query("""WITH r AS (SELECT DISTINCT least(tableid_1, tableid_2) AS t1, greatest(tableid_1, tableid_2) AS t2 FROM duplicate_relations WHERE tableid_1 <> tableid_2)
    SELECT DISTINCT tableid FROM maco_table_info WHERE tableid NOT IN (SELECT t2 FROM r)""")
def C10_remove_known_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = spark.read.parquet(f"{sf_dir}/duplicate_relations.parquet").where("tableid_1 <> tableid_2").select(
        F.least("tableid_1", "tableid_2").alias("tableid_1"), F.greatest("tableid_1", "tableid_2").alias("tableid_2")
    ).distinct()
    info = spark.read.parquet(f"{sf_dir}/maco_table_info.parquet").select("tableid").distinct()
    return duplicates.remove_duplicates(info, rel)


# -- enrichment ----------------------------------------------------------


@query(f"""{CELLS}, ds AS ({L.sql_dataset(L.Q1)}), w AS (SELECT rowid, max(CASE WHEN colid = 0 THEN token END) AS k, max(CASE WHEN colid = 1 THEN token END) AS f1, max(CASE WHEN colid = 3 THEN token END) AS f3 FROM cells WHERE tableid = 9 GROUP BY 1),
    o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY rowid) = 1)
    SELECT n_name, r_name, avg_bal, f1 AS "9_1:n_customers", f3 AS "9_3:top_segment" FROM ds LEFT JOIN o ON k = left({CLEAN('n_name')}, 200)""")
def C11_enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, _ = L.dataset(spark, sf_dir, L.Q1)
    lake = L.lake(spark, sf_dir)
    return enrich.add_features(data, ["n_name"], lake.cells, lake.headers, 9, [0], [1, 3])


@query(f"""{CELLS}, ds AS ({L.sql_dataset(L.Q1)}), w AS (SELECT rowid, max(CASE WHEN colid = 0 THEN token END) AS k, max(CASE WHEN colid = 1 THEN token END) AS f1 FROM cells WHERE tableid = 9 GROUP BY 1),
    o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY rowid) = 1)
    SELECT n_name, r_name, avg_bal, f1 AS "9_1:n_customers" FROM ds LEFT JOIN o ON k = left({CLEAN('n_name')}, 200)""")
def F14_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached columns of one header dropped again."""
    return enrich.drop_columns(C11_enrich_left_join(spark, sf_dir), ":top_segment")


@query(f"{CELLS} SELECT token, tableid, colid, rowid FROM cells SEMI JOIN (SELECT DISTINCT token FROM cells WHERE table_col_id = '8_0') q USING (token)")
def L11_unpacked_posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting list packed into composite ids and taken apart again."""
    return lookup.unpacked_posting_list(F1_posting_list(spark, sf_dir))


@query(f"SELECT lower(n_name) AS n_name, lower(r_name) AS r_name, CAST(avg_bal AS VARCHAR) AS avg_bal FROM ({L.sql_dataset(L.Q1)})")
def L12_lowered_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovery(spark, sf_dir, L.Q1, ["n_name", "r_name"], "avg_bal").lowered()


@query("SELECT c_mktsegment, round(avg(c_custkey), 6) AS c_custkey, round(avg(c_nationkey), 6) AS c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1")
def A13_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = enrich.group_mean(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_mktsegment"])
    return means.select("c_mktsegment", *(F.round(c, 6).alias(c) for c in means.columns[1:]))


@query("""WITH m AS (SELECT avg(imdb_score) AS s, avg(duration) AS d FROM movie)
    SELECT movie_id, round(coalesce(imdb_score, s), 6) AS imdb_score, round(coalesce(duration, d), 6) AS duration FROM movie, m""")
def L17_mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie = spark.read.parquet(f"{sf_dir}/movie.parquet").select("movie_id", "imdb_score", "duration")
    filled = enrich.mean_impute(movie, ["imdb_score", "duration"])
    return filled.select("movie_id", F.round("imdb_score", 6).alias("imdb_score"), F.round("duration", 6).alias("duration"))


@query("SELECT round(corr(c_acctbal, c_nationkey), 6) AS corr FROM customer")
def A18_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.agg(F.round(correlate.pearson(c, "c_acctbal", "c_nationkey"), 6).alias("corr"))


_MATRIX = ["p_brand", "p_size", "p_retailprice"]


@query(f"""WITH k AS (SELECT CASE WHEN p_brand IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY p_brand NULLS LAST) - 1 END AS p_brand, p_size, p_retailprice FROM part)
    {' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM k" for x in _MATRIX for y in _MATRIX)}""")
def A19_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = correlate.correlation_matrix(spark.read.parquet(f"{sf_dir}/part.parquet"), _MATRIX)
    return m.withColumn("corr", F.round("corr", 6))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY c_mktsegment NULLS LAST) - 1 AS INT) END AS code FROM customer")
def L20_category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coded = correlate.with_category_codes(c.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    return coded.withColumnRenamed("c_mktsegment", "code")


@query(f"{CELLS} SELECT rowid, max(CASE WHEN colid = 0 THEN token END) AS n_name, max(CASE WHEN colid = 1 THEN token END) AS r_name, max(CASE WHEN colid = 2 THEN token END) AS n_nationkey FROM cells WHERE tableid = 8 GROUP BY rowid ORDER BY rowid LIMIT 5")
def K8_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = L.lake(spark, sf_dir)
    return enrich.preview(lake.cells, lake.headers, 8, 5)


# -- the whole of it as one object ---------------------------------------


def _discovery(spark, sf_dir, q, columns: list[str], target: str) -> Discovery:
    data, order = L.dataset(spark, sf_dir, q)
    lake = L.lake(spark, sf_dir)
    return Discovery(data, columns, target, order, lake.cells, lake.rows, lake.headers)


@query(f"{CELLS}, {_MULTI}, h AS (VALUES {_HEADERS}) SELECT CAST(row_number() OVER (ORDER BY abs(corr) DESC, fid) AS INT) AS rank, round(corr, 6) AS corr, fid AS table_col_id, is_numeric, col2 AS header FROM sc LEFT JOIN h ON fid = col0 || '_' || col1 WHERE corr IS NOT NULL ORDER BY rank LIMIT 10")
def C14_correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joinable tables and the columns of theirs that tell most of the target, by their headers."""
    d = _discovery(spark, sf_dir, L.Q1, ["n_name", "r_name"], "avg_bal")
    d.joinable(20, 200)
    return d.correlated(10).withColumn("corr", F.round("corr", 6))


@query("SELECT s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def C15_load_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input dataset from a file; that it has its query and target columns is checked."""
    folder = _folder(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias(" s_name"), F.col("s_acctbal").alias("s_acctbal "))
    s.coalesce(1).write.csv(folder, header=True, sep=";")
    path, lake = _file(spark, folder, ".csv"), L.lake(spark, sf_dir)
    try:
        Discovery.load(spark, path, ";", ["s_name"], "missing", ["s_name"], lake)
        raise AssertionError("a missing target wasn't noticed")
    except ValueError:
        return Discovery.load(spark, path, ";", ["s_name"], "s_acctbal", ["s_name"], lake).data.withColumn("s_acctbal", F.round("s_acctbal", 6))


# -- models --------------------------------------------------------------


def _movies(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    movie = spark.read.parquet(f"{sf_dir}/movie.parquet").select("movie_id", "imdb_score", "voted_users", "duration", "reviewers").distinct()
    return movie, ["voted_users", "duration", "reviewers"]


@query("SELECT round(avg((imdb_score - duration / 20) * (imdb_score - duration / 20)), 6) AS mse FROM movie WHERE imdb_score IS NOT NULL AND duration IS NOT NULL")
def A22_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a given prediction."""
    movie = spark.read.parquet(f"{sf_dir}/movie.parquet").where("imdb_score IS NOT NULL AND duration IS NOT NULL")
    error = evaluate.mse(movie.withColumn("prediction", F.col("duration") / 20), "imdb_score")
    return spark.createDataFrame([(round(float(error), 6),)], "mse double")


@query()
def G1_fit_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of a model of the film's score."""
    movie, features = _movies(spark, sf_dir)
    return spark.createDataFrame([(float(evaluate.fit_model(movie, features, "imdb_score")[2]),)], "mse double")


@query()
def G2_perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase of the held-out error when one feature's values are dealt out anew, ten times each."""
    movie, features = _movies(spark, sf_dir)
    model, test, _ = evaluate.fit_model(movie, features, "imdb_score")
    return evaluate.permutation_importance(model, test, features, "imdb_score")


@query()
def G3_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a model of the parts' price with the dataset's own features, and with those of the lake's table that joins with it."""
    d = _discovery(spark, sf_dir, L.Q3, ["p_brand", "p_type"], "price")
    best = d.joinable(20, 200).where("tableid = 10").first()
    enriched = written(d.enriched(10, list(best.cols), [2, 3]), "enriched")
    return spark.createDataFrame([d.evaluated(enriched, ["p_brand"])], "base double, enriched double, reduction double")


# -- sources -------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _file(spark: SparkSession, folder: str, suffix: str) -> str:
    return next(p for p in readers.list_files(spark, folder) if p.endswith(suffix))


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


@query(_NATION)
def S1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.csv(folder, header=True, sep=";")
    return readers.read_csv(spark, _file(spark, folder, ".csv"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def S2_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.csv(folder, header=True, sep="\t")
    return readers.read_tsv(spark, _file(spark, folder, ".csv"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def S3_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    array = nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    array.coalesce(1).write.text(folder)
    return readers.read_json(spark, _file(spark, folder, ".txt")).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def S4_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf_dir}/nation.parquet")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, s_acctbal FROM supplier")
def S5_arff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    head = "% suppliers\n@relation supplier\n@attribute s_suppkey numeric\n@attribute 's_name' string\n@attribute s_acctbal real\n@data"
    lines = s.select(F.lit(1).alias("o"), F.concat_ws(",", "s_suppkey", F.concat(F.lit("'"), "s_name", F.lit("'")), F.coalesce(F.col("s_acctbal").cast("string"), F.lit("?"))).alias("value"))
    spark.createDataFrame([(0, head)], "o int, value string").unionByName(lines).coalesce(1).orderBy("o").select("value").write.text(folder)
    return readers.read_arff(spark, _file(spark, folder, ".txt"))


@query("SELECT CAST(3 AS INT) AS inserted, CAST(1 AS INT) AS file_errors, CAST(1 AS INT) AS data_errors, CAST(4 AS INT) AS next_id, (SELECT count(*) FROM nation) * 3 + (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM supplier) * 4 AS cells")
def S18_index_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of several kinds, indexed in two runs, with one file of no known kind and one without rows."""
    folder = _folder(spark)
    for name, write in (
        ("nation", lambda df, p: df.write.csv(p, header=True)), ("region", lambda df, p: df.write.parquet(p)),
    ):
        write(spark.read.parquet(f"{sf_dir}/{name}.parquet").coalesce(1), f"{folder}/{name}")
    spark.range(1).selectExpr("'x' AS value").coalesce(1).write.text(f"{folder}/other")
    spark.read.parquet(f"{sf_dir}/region.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/empty")
    catalog = LakeCatalog(spark, f"{folder}-index")
    catalog.add_folder(folder, recursive=True)
    first = catalog.update()
    spark.read.parquet(f"{sf_dir}/supplier.parquet").coalesce(1).write.json(f"{folder}/supplier")  # JSON lines
    catalog.add_folder(folder, recursive=True)
    second = catalog.update()
    n = catalog.table("cells").count()
    row = (len(first.inserted) + len(second.inserted), len(first.file_errors), len(first.data_errors), catalog.next_id(), n)
    return spark.createDataFrame([row], "inserted int, file_errors int, data_errors int, next_id int, cells long")


_FILES = 5000


@query(f"""WITH t AS (SELECT o_orderkey % {_FILES} AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(count(*) AS INT) AS inserted, count(*) AS tables, CAST(sum(n) * 3 AS BIGINT) AS cells, count(*) * 3 AS headers, count(*) * 3 AS order_blocks, CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS INT) AS longest, CAST(0 AS BIGINT) AS after_drop FROM t""")
def S18_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five thousand small files indexed in one job per relation: what all relations hold, and nothing once they are dropped."""
    folder = _folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % _FILES).alias("k"), "o_orderkey", "o_custkey", "o_totalprice")
    orders.repartition("k").write.partitionBy("k").option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(folder, header=True)
    catalog = LakeCatalog(spark, f"{folder}-index")
    catalog.add_folder(folder, recursive=True)
    report = catalog.update()
    sizes = [catalog.table(t).count() for t in ("tables", "cells", "headers", "order_index", "rows")]
    longest = catalog.table("tables").agg(F.max("max_row_id")).first()[0]
    catalog.drop()
    row = (len(report.inserted), *sizes, longest, sum(catalog.table(t).count() for t in SCHEMAS))
    return spark.createDataFrame([row], "inserted int, tables long, cells long, headers long, order_blocks long, rows long, longest int, after_drop long")


def _nation_catalog(spark: SparkSession, sf_dir: str, **options) -> LakeCatalog:
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").coalesce(1).write.csv(folder, header=True)
    catalog = LakeCatalog(spark, f"{folder}-index", **options)
    catalog.add_folder(folder)
    catalog.update()
    return catalog


@query(f"SELECT CAST(1 AS INT) AS tableid, colid, header, {CLEAN('header')} AS header_tokenized FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) AS h(colid, header)")
def S11_headers_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as an index has them after a file was indexed."""
    return _nation_catalog(spark, sf_dir).table("headers")


@query("SELECT CAST(1 AS INT) AS tableid, CAST(count(*) AS INT) AS max_row_id, CAST(2 AS INT) AS max_col_id FROM nation")
def S12_table_info_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_catalog(spark, sf_dir).table("tables").drop("dataset_name")


@query(f"SELECT {CLEAN('n_name')} AS token, CAST(1 AS INT) AS tableid, CAST(1 AS INT) AS colid, CAST(i AS INT) AS rowid FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i IN (3, 8)")
def S16_row_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows' names from the layout by table and row, of which only the row groups that may hold them are read."""
    cells = _nation_catalog(spark, sf_dir, row_layout=True).by_row()
    return cells.where("tableid = 1 AND rowid IN (3, 8) AND colid = 1").select("token", "tableid", "colid", "rowid")


@query("""WITH n AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS rowid, n_regionkey FROM nation)
    SELECT '1_2' AS table_col_id, true AS is_numeric, CAST(0 AS INT) AS block, string_agg(rowid, ',' ORDER BY n_regionkey, rowid) AS row_list,
        string_agg(new, '' ORDER BY n_regionkey, rowid) AS binary_list
    FROM (SELECT *, CASE WHEN lag(n_regionkey) OVER (ORDER BY n_regionkey, rowid) = n_regionkey THEN '0' ELSE '1' END AS new FROM n)""")
def S13_order_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored order of a numeric column."""
    stored = _nation_catalog(spark, sf_dir).table("order_index").where("table_col_id = '1_2'")
    return stored.withColumn("row_list", F.array_join(F.col("row_list").cast("array<string>"), ","))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def S3_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, all of them."""
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal").coalesce(1).write.json(folder)
    return readers.read_json(spark, _file(spark, folder, ".json")).select(F.col("s_suppkey").cast("int").alias("s_suppkey"), "s_name", "s_acctbal")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, '@' || s_name AS s_name FROM supplier")
def S5_arff_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long header, comments and blank lines among the rows, and rows that begin like a declaration."""
    folder = _folder(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    head = "% suppliers\n" * 8000 + "@relation supplier\n@attribute s_name string\n@attribute s_suppkey numeric\n@data"
    rows = s.select(F.lit(1).alias("o"), F.concat(F.lit("@"), "s_name", F.lit(","), "s_suppkey").alias("value"))
    noise = s.select(F.lit(1).alias("o"), F.when(F.col("s_suppkey") % 2 == 0, "% no row").otherwise("").alias("value"))
    spark.createDataFrame([(0, head)], "o int, value string").unionByName(rows).unionByName(noise).coalesce(1).orderBy("o").select("value").write.text(folder)
    return readers.read_arff(spark, _file(spark, folder, ".txt")).select("s_suppkey", "s_name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'Zürich' ELSE o_orderstatus END AS place FROM orders")
def S1_latin1_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that only its last line shows to be Latin-1."""
    folder = _folder(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    last = o.agg(F.max("o_orderkey")).first()[0]
    rows = o.orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.when(F.col("o_orderkey") == last, "Zürich").otherwise(F.col("o_orderstatus")).alias("place"))
    rows.coalesce(1).write.csv(folder, header=True, sep=";", encoding="ISO-8859-1")
    return readers.read_csv(spark, _file(spark, folder, ".csv"))


@query("SELECT s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def S19_load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias(" s_name"), F.col("s_acctbal").alias("s_acctbal "))
    s.coalesce(1).write.csv(folder, header=True, sep=";")
    return readers.read_dataset(spark, _file(spark, folder, ".csv"), ";").withColumn("s_acctbal", F.round("s_acctbal", 6))


@query(f"SELECT left({CLEAN('event_type')}, 200) AS token, CAST(99 AS INT) AS tableid, CAST(0 AS INT) AS colid, CAST(event_id AS INT) AS rowid, '99_0' AS table_col_id FROM events")
def ST1_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events indexed as they arrive, read back from the index."""
    path = _folder(spark)
    source = f"{sf_dir}/events.parquet"
    folder, name = os.path.split(source)
    schema = spark.read.parquet(source).schema
    glob = {} if os.path.isdir(source) else {"pathGlobFilter": name}
    stream = spark.readStream.schema(schema).options(**glob).parquet(source if os.path.isdir(source) else folder)
    append_cells(stream, 99, "event_id", ["event_type"], path, f"{path}-state").awaitTermination()
    return spark.read.parquet(f"{path}/cells").select("token", "tableid", "colid", "rowid", "table_col_id")
