import hashlib
import re

from pyspark.sql import functions as F

from marlstone.functions import ids, text

SAMPLES = [
    "  Straße-RS-12 (Σας) ﬁ ",
    "abc--1 a-b 1-a x_y9 B5-440 b5_440",
    "《论文》：Test_A · b",
    "a 　b\x1c c",
    "",
    "ÀÉÎ õ ǅ",
    "-" * 5,
]
IGNORED = r"[\s\-_/／·•—–_.,，。:：;；()（）\[\]【】]+"
CODE = (
    r"(?i)(?<![a-z0-9])(?=[a-z0-9_-]*[a-z])(?=[a-z0-9_-]*\d)[a-z0-9]+(?:[-_][a-z0-9]+)*(?![a-z0-9])"
)


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_name_key_equals_folding(spark):
    assert _column(spark, SAMPLES, text.normalize_name) == [re.sub(IGNORED, "", s.strip().casefold()) for s in SAMPLES]


def test_model_codes(spark):
    expected = []
    for s in SAMPLES:
        codes = [re.sub("[-_]", "", c).casefold() for c in re.findall(CODE, s)]
        expected.append(list(dict.fromkeys(codes)))
    assert _column(spark, SAMPLES, text.model_codes) == expected


def test_strip_and_collapse(spark):
    assert _column(spark, SAMPLES, text.strip) == [s.strip() for s in SAMPLES]
    assert _column(spark, SAMPLES, text.collapse_spaces) == [re.sub(r"\s+", " ", s).strip() for s in SAMPLES]


def test_unique_strings_keeps_first_spelling(spark):
    df = spark.createDataFrame([(["Ab-c", "ABC", "x", None, " d  e ", "de", "f g"],)], "v array<string>")
    assert df.select(text.unique_strings(F.col("v"))).head()[0] == ["Ab-c", "d e", "f g"]
    assert df.select(text.unique_strings(F.col("v"), 2)).head()[0] == ["Ab-c", "d e"]


def test_parse_list(spark):
    values = ['["aa","b b","AA",3]', "x1，yy;zz|  ", '{"a":1}', None, "", "5", "plain text"]
    assert _column(spark, values, text.parse_list) == [["aa", "b b"], ["x1", "yy", "zz"], [], [], [], [], ["plain text"]]


def test_low63_matches_big_endian(spark):
    got = _column(spark, SAMPLES, lambda c: ids.low63(ids.sha256_hex(c)))
    assert got == [int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") & ((1 << 63) - 1) for s in SAMPLES]


def test_same_content_in_two_versions_has_two_ids(spark):
    df = spark.createDataFrame([("ver_a", "x" * 300), ("ver_b", "x" * 300)], "v string, c string")
    keys = df.select(ids.chunk_id(F.col("v"), F.lit("doc"), F.lit("sec"), F.lit(0), F.col("c")).alias("k")).collect()
    raw = "\x1f".join(["ver_a", "doc", "sec", "0", "x" * 200])
    assert keys[0].k == int.from_bytes(hashlib.sha256(raw.encode()).digest()[:8], "big") & ((1 << 63) - 1)
    assert keys[0].k != keys[1].k


def test_logical_id_sources(spark):
    ready = "ldoc_" + "a" * 24
    df = spark.createDataFrame([("T", "h", None), ("", "h", None), ("T", "h", " My ID "), ("T", "h", ready)], "t string, h string, e string")
    rows = df.select(ids.logical_id(F.col("t"), F.col("h"), F.col("e")).alias("l")).select("l.*").collect()
    digest = lambda seed: "ldoc_" + hashlib.sha256(seed.encode()).hexdigest()[:24]
    assert [tuple(r) for r in rows] == [
        (digest("title:t"), "canonical_title"),
        (digest("content:h"), "content_hash_fallback"),
        (digest("explicit:my id"), "user_provided"),
        (ready, "user_provided"),
    ]
