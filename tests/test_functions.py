import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<float>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\n", ["a", "b", "c", ""]), ("\n", [""])],
)
def test_lines(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=text) == want


def test_tokens_split_at_unicode_space(spark):
    assert one(spark, T.tokens(F.col("t")), t=" a b  c ") == ["a", "b", "c"]


@pytest.mark.parametrize(("word", "want"), [("running", "runn"), ("sing", "sing"), ("boxed", "box"), ("boxes", "box"), ("cats", "cat"), ("glass", "glass"), ("this", "thi")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.col("t")), t=word) == want


def test_identifiers_split_at_case_and_digits(spark):
    assert one(spark, T.split_identifier(F.col("t")), t="readHTTP2Frame") == ["read", "HTTP", "2", "Frame"]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("*.md", "a/b/c.md", True), ("*.md", "c.md", True), ("a/*.md", "a/b/c.md", False), ("a/**/*.md", "a/b/c/d.md", True), ("a/**/*.md", "a/d.md", True),
        ("?.txt", "ab.txt", False), ("src\\*.cs", "src/x.cs", True), ("/top.txt", "x/top.txt", True), ("A.txt", "a.txt", False), ("a.b", "axb", False),
        ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**", "ab", False), ("**", "a/b", True), ("**/x", "x", True), ("**/**/x", "a/b/x", True), ("**/x", "ax", False), ("a/**/**/b", "a/b", True), ("a/**/b", "ab", False),
        ("x**y", "x1y", True), ("x**y", "x1/2y", False), (" *.md ", "a/b.md", True), ("(x)+.txt", "(x)+.txt", True), ("a/**.md", "a/b.md", True), ("a/**.md", "a/b/c.md", False),
    ],
)
def test_globs(spark, glob, path, want):
    assert one(spark, F.col("t").rlike(T.glob_pattern(glob)), t=path) is want


@pytest.mark.parametrize("glob", ["", "  ", "/", "..", "../x", "a/../b", "a\\\\.."])
def test_globs_refused(glob):
    with pytest.raises(ValueError):
        T.glob_pattern(glob)


@pytest.mark.parametrize(
    ("pattern", "kwargs", "line", "want"),
    [
        ("a.b", {}, "a.b", True), ("a.b", {}, "axb", False), ("a.b", {"regex": True}, "axb", True), ("CAT", {"ignore_case": True}, "a cat", True), ("cat", {"whole_word": True}, "concat cat_ cat", True),
        ("cat", {"whole_word": True}, "cat_ concat", False), ("$1", {}, "cost $1", True),
        (r"\p{L}+", {"regex": True}, "é", True), (r"^the", {"regex": True, "whole_word": True}, "these the", False), (r"foo|foobar", {"regex": True, "whole_word": True}, "foobar", False), (r"a+", {"regex": True, "whole_word": True}, "aaa_b aa", True),
        ("  ", {}, "a  b", True), ("C[aeiou]T", {"regex": True, "ignore_case": True}, "the cut", True),
    ],
)
def test_matching(spark, pattern, kwargs, line, want):
    assert one(spark, F.col("t").rlike(T.matcher(pattern, **kwargs)), t=line) is want


@pytest.mark.parametrize("pattern", ["(", "", "[a", r"\p{Nothing}", "a**"])
def test_bad_pattern_is_refused(spark, pattern):
    with pytest.raises(ValueError):
        T.matcher(pattern, regex=True)


def test_replacing_without_case_and_in_whole_words(spark):
    new, n = T.replace_literal(F.col("t"), "cat", r"\$0", ignore_case=True, whole_word=True)
    assert one(spark, F.struct(new.alias("a"), n.alias("b")), t="Cat concat CAT_ (cat) cat's") == (r"\$0 concat CAT_ (\$0) \$0's", 3)


def test_terms_keep_order_and_drop_single_letters(spark):
    assert one(spark, T.terms(F.col("t")), t="b The-the 2x É éA a1 THE x") == ["the", "2x", "éa", "a1"]


def test_cosine_edges(spark):
    c = V.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, c, a=[3.0, 4.0], b=[6.0, 8.0]) == pytest.approx(1)
    with pytest.raises(Exception, match="dimension"):
        one(spark, c, a=[1.0], b=[1.0, 0.0])


def test_pack_round_trip_and_bad_length(spark):
    v = [1.5, -2.25, float("inf")]
    assert one(spark, V.unpack(V.pack(F.col("a"))), a=v) == v
    with pytest.raises(Exception, match="multiple"):
        spark.createDataFrame([(b"abc",)], "b binary").select(V.unpack(F.col("b"))).collect()


def test_vectors_of_json(spark):
    assert one(spark, V.from_json(F.col("t")), t="[1, -2.5, 3e1]") == [1.0, -2.5, 30.0] and one(spark, V.from_json(F.col("t")), t=None) is None
    for bad in ("{", "[1, null]", "x"):
        with pytest.raises(Exception, match="rebuilt"):
            one(spark, V.from_json(F.col("t")), t=bad)


def test_pack_and_unpack_batches_with_nulls(spark):
    rows = [(i, None if i % 5 == 0 else [float(i)] * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, a array<float>").repartition(3).where("i > 2")
    got = {r.i: (r.b, r.c) for r in df.select("i", V.pack(F.col("a")).alias("b")).select("i", "b", V.unpack(F.col("b")).alias("c")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: a for i, a in rows if i > 2}
    assert all(b is None if a is None else len(b) == 4 * len(a) for i, a in rows if i > 2 for b in [got[i][0]])


def test_histogram_counts_utf16_units(spark):
    h = one(spark, V.histogram(F.col("t")), t="a\U0001f600")
    want = [0] * 64
    for unit in (97, 0xD83D, 0xDE00):
        want[unit % 64] += 1
    assert h == want
