import pytest
from pyspark.sql import functions as F

from lakeweave.functions import hashing, text

CLEANED = {
    "The Lord of the Rings": "lord rings", "Café_42!": "caf 42", "-994.28": "994 28", "1.0": "1 0", "to be or not to be": "to",
    "a a a c": "a c", "V for Vendetta": "vendetta", "the a": "the", "not a b": "b", "of": "of", "": "", "Customer#000000001": "customer 000000001",
}
POSITIONS = {"a": [39, 112], "ab": [46, 50, 113], "2020": [30, 35, 115], "hello": [77, 86, 99, 109, 116], "movies": [3, 17, 85, 97, 108, 117], "": [], "None": []}


def test_clean(spark):
    df = spark.createDataFrame(list(CLEANED.items()), "x string, want string")
    assert [r for r in df.select("x", "want", text.clean_text(F.col("x")).alias("got")).collect() if r.got != r.want] == []


def test_clean_null_and_long(spark):
    df = spark.createDataFrame([(None,), ("x" * 5000,)], "x string")
    assert [r[0] for r in df.select(text.clean_text(F.col("x"), null="none")).collect()] == ["none", "x" * 200]


def test_clean_distinct_join_keeps_rows(spark):
    df = spark.createDataFrame([("A b",), ("A b",), (None,)], "x string")
    assert sorted(r.t for r in text.with_clean(df, "x", "t").collect()) == ["b", "b", "nan"]


def test_numeric_tokens(spark):
    cases = {"12": True, "1e5": True, "nan": True, "inf": True, "": True, None: True, "1 0": False, "none": False, "1d": False, "1f": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert [r for r in df.select("t", "want", text.is_numeric_token(F.col("t")).alias("got")).collect() if r.got != r.want] == []


def test_null_like(spark):
    df = spark.createDataFrame([("banana",), ("",), ("nan",), ("ok",), ("none",)], "t string")
    lake = [r[0] for r in df.select(text.null_like_in_lake(F.col("t"))).collect()]
    exact = [r[0] for r in df.select(text.null_like_in_lake(F.col("t"), exact=True)).collect()]
    query = [r[0] for r in df.select(text.null_like_in_query(F.col("t"))).collect()]
    assert lake == [None, None, None, "ok", None]
    assert exact == ["banana", None, None, "ok", None]
    assert query == ["banana", None, None, "ok", "none"]


def test_xash_positions_and_words(spark):
    df = spark.createDataFrame([(k, v) for k, v in POSITIONS.items()], "t string, want array<int>")
    p = hashing.xash_positions("t")
    bits = hashing.bit_string(hashing.words_of(p, 128), 128)
    back = hashing.bit_string(hashing.words_of_bits(bits, 128), 128)
    for r in df.select("want", p.alias("p"), bits.alias("b"), back.alias("again")).collect():
        assert r.p == r.want
        assert sorted(127 - i for i, c in enumerate(r.b) if c == "1") == r.want
        assert r.again == r.b


def test_variants_share_one_look_at_a_token(spark):
    tokens = [*POSITIONS, "customer 000000012", "x" * 200, "a b c d e f g", "''", " ", None]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("x", hashing.xash_letters("t"))
    for size in hashing.SEGMENTS:
        for rotation in (True, False):
            direct, placed = hashing.xash_positions("t", size, rotation), hashing.xash_placed("x", size, rotation)
            words = hashing.bit_string(hashing.words_of(direct, size), size)
            for r in df.select("t", direct.alias("d"), placed.alias("p"), words.alias("w"), hashing.position_string(placed, size).alias("s")).collect():
                assert r.d == r.p and r.w == r.s and len(r.s) == size, r.t


@pytest.mark.parametrize("sig", [hashing.xash(64), hashing.xash(512, rotation=False), hashing.bloom(128, -1), hashing.md5_signature(), hashing.simhash()])
def test_row_key_contains_its_cells(spark, sig):
    df = spark.createDataFrame([("alpha", "beta 2", "c")], "a string, b string, c string")
    key = hashing.row_key(["a", "b", "c"], sig)
    row = df.select(*(hashing.contained(sig.words(c), key, sig.size).alias(c) for c in "abc")).first()
    assert all(row)


def test_md5_words(spark):
    import hashlib

    df = spark.createDataFrame([("movies",)], "t string")
    b = df.select(hashing.bit_string(hashing.md5_words(F.col("t")), 128)).first()[0]
    assert int(b, 2) == int(hashlib.md5(b"movies").hexdigest(), 16)


def test_bloom_sizes():
    assert hashing.bloom_size(6, 0.05) == 37
    assert hashing.bloom_hashes(128, 6) == 14
