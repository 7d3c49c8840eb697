from pyspark.sql import functions as F

from poolsift.functions import ids, prompts, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


# The 29 blanks of the split, written out.
BLANKS = [
    *"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0",
    *(chr(c) for c in range(0x2000, 0x200B)),
    *(chr(c) for c in (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)),
]


def test_every_blank_separates_and_nothing_else(spark):
    others = [*(chr(c) for c in (0x200B, 0xFEFF, 0x180E, 0x301, 0)), "-", "_"]
    captions = [f"a{b}b" for b in BLANKS + others] + ["", " ", " a ", chr(0x3000) + "a" + chr(0x3000), None]
    want = [None if c is None else len(c.split()) for c in captions]
    assert column(spark, captions, text.word_count) == want
    assert len(BLANKS) == 29


def test_has_words_is_the_count_test(spark):
    captions = ["", " ", "a", " a ", "a b", "a\xa0b c", "a b c d", "\n\na\n\nb\n\nc", "a" * 5000]
    for least in (1, 2, 3, 4):
        want = [len(c.split()) >= least for c in captions]
        assert column(spark, captions, lambda c: text.has_words(c, least)) == want


def test_keyword_borders(spark):
    captions = ["écar", "car.", "CAR", "scar", "car_", "car2", "a car!", "é car é", None, ""]
    got = column(spark, captions, lambda c: text.matches_keywords(c, ["car"]))
    assert got == [False, True, True, False, False, False, True, True, False, False]


def test_keyword_terms_are_literal(spark):
    captions = ["a.b", "axb", "semi-truck", "semi truck", "STRASSE", "c++", "c++x", "xc++"]
    got = column(spark, captions, lambda c: text.matches_keywords(c, ["a.b", "semi-truck", "c++"]))
    # A term that ends in punctuation needs a word character after it.
    assert got == [True, False, True, False, False, False, True, False]


def test_truncate_and_names(spark):
    assert column(spark, ["a  b\nc d", "a", "", None], lambda c: text.truncate_words(c, 2)) == ["a b", "a", "", ""]
    paths = ["x/y.tar.gz", "x/.hidden", "plain", "d.x/f", "a/b.JPG"]
    assert column(spark, paths, text.path_stem) == ["y.tar", ".hidden", "plain", "f", "b"]
    assert column(spark, paths, text.path_suffix) == [".gz", "", "", "", ".jpg"]
    members = ["d/a.b.c", "a.JSON", "noext", "d.e/a.jpg"]
    assert column(spark, members, text.member_prefix) == ["d/a", "a", "", "d.e/a"]
    assert column(spark, members, text.member_suffix) == ["b.c", "json", "", "jpg"]
    assert column(spark, ["00000012.tar", "src7", "x"], text.shard_number) == [12, 7, None]
    assert column(spark, ["race:a:b", "x"], lambda c: text.split_objective(c)[1]) == ["a:b", None]


def test_uid_rules(spark):
    short = "abc" * 10 + "d"
    values = [short, "AB" * 16, "0" * 33, None]
    assert column(spark, values, ids.canonical_uid) == ["0" + short, "ab" * 16, None, None]
    top = "f" * 32
    assert column(spark, [top], ids.uid_hi) == [2**64 - 1]
    back = lambda c: ids.uid_from_pair(ids.uid_hi(c), ids.uid_lo(c))
    assert column(spark, [top, "0" * 31 + "1", short], back) == [top, "0" * 31 + "1", "0" + short]


def test_prompts(spark):
    rows = [("alt", "cap"), (None, "cap"), ("alt", ""), ("", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, c string")
    got = [r.p for r in df.select("i", prompts.caption_prompt(F.col("a"), F.col("c")).alias("p")).orderBy("i").collect()]
    assert got[0] == prompts.GUIDED_PROMPT % ("alt", "cap")
    assert got[1] == prompts.GUIDED_PROMPT % ("(none)", "cap")
    assert got[2] == prompts.GUIDED_PROMPT % ("alt", "(none)")
    assert got[3] == prompts.PLAIN_PROMPT
    assert column(spark, ["Owl", "Cat"], prompts.cue_prompt) == ["An owl", "A cat"]


def test_numbers(spark):
    assert column(spark, ["0.5", "x", "", None], text.number_or_null) == [0.5, None, None, None]
    assert column(spark, [0.1234, 1.0], text.percent_text, "double") == ["12.3", "100.0"]
