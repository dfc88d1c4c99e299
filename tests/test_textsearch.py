"""Search by trigrams: what patterns require, and the same answers as a search of every file."""

import os
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import trigrams as T
from lodestone.operators import textsearch as X
from lodestone.operators import tools as O
from lodestone.sources import folder


def test_what_patterns_require():
    r = T.required
    assert r("abc") == "abc" and r("abcd") == ("and", ("abc", "bcd")) and r("ab") is None and r("a.c") is None
    assert r("(abc|xyz)") == ("or", ("abc", "xyz")) and r("(abc|x)") is None and r("abc|xyzw") == ("or", ("abc", ("and", ("xyz", "yzw"))))
    assert r("foo+bar") == ("and", ("foo", "oba", "bar")) and r("fooo?bar") == ("and", ("foo", "bar")) and r("(?:abc)*def") == "def" and r("(abc){2,3}d") == "abc"
    assert r(r"\Qa.b\Ec") == ("and", ("a.b", ".bc")) and r(r"\bword\b") == ("and", ("wor", "ord")) and r(r"abc\d+def") == ("and", ("abc", "def"))
    assert r("[abc]def[^]x]ghi") == ("and", ("def", "ghi")) and r("(?=abc)def") == "def" and r("(?<n>abc)") == "abc" and r("a{3}bcd") == ("and", ("abc", "bcd"))
    assert r("THE", True) == "the" and r("(?i)Straße") == ("and", ("str", "tra")) and r("Straße") == ("and", ("str", "tra", "raß", "aße")) and r("(?x)a b c") is None
    assert T.literal("a") is None and T.literal("The") == "the"


def text_of(condition, text):
    folded = T._fold(text)
    if condition is None:
        return True
    if isinstance(condition, str):
        return condition in folded
    return (all if condition[0] == "and" else any)(text_of(p, text) for p in condition[1])


ATOM = st.sampled_from([*"abAB", "ab", "[ab]", "(?:ab|ba)", "(aab|b)", r"\w", ".", "(?>ab)", r"\x61", "(?i:B)", "ſ", "s", r"\Qab\E", "^", r"\b", "(?!b)", "[^b]", "(b(a|ab)a)"])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ATOM, st.sampled_from(["", "", "", "+", "*", "?", "{2}", "{0,2}", "+?"])), min_size=1, max_size=7), st.text("abABsSſ", max_size=14), st.booleans(), st.booleans())
def test_a_condition_never_rules_out_a_match(parts, text, ignore_case, either):
    """Hypothesis over patterns: whatever matches has what is required."""
    simple = lambda a, q: a if a in ("^", r"\b", "(?!b)") else a + q
    pattern = "".join(simple(a, q) for a, q in parts)
    pattern = f"{pattern}|bab" if either else pattern
    run = pattern.replace(r"\Qab\E", "(?:ab)") if not any(a == r"\Qab\E" and q for a, q in parts) else None
    if run is not None and regex.search(("(?i)" if ignore_case else "") + run, text):
        assert text_of(T.required(pattern, ignore_case), text), (pattern, text)


FILES = {
    "a.txt": "the cat sat\nThe Cat SAT\nnothing", "d/b.txt": "a cAtalogue of cats\n\nend", "d/e/c.txt": "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!\nno match here", "f.txt": "ſtraße STRASSE straKe", "d/big.txt": "cat " * 2000, "d/g.txt": "dog only\r\ncaT\r\n",
    "h/i.txt": "x" * 300 + " cat " + "y" * 300,
}
CASES = [("cat", {}), ("cat", {"ignore_case": True}), ("cat", {"whole_word": True, "ignore_case": True}), ("c[aA]t", {"regex": True}), ("ca", {}), ("(cat|dog)s? ", {"regex": True}), ("straſſe|stra.e", {"regex": True, "ignore_case": True}), (".", {}), (r"^\p{Lu}", {"regex": True}), ("STR", {"ignore_case": True}), ("zzz", {}), ("e+nd|nothing$", {"regex": True})]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("texts")
    for p, t in FILES.items():
        os.makedirs((root / p).parent, exist_ok=True)
        (root / p).write_bytes(t.encode())
    opened = spark.sparkContext.accumulator(0)
    files = folder.Folder(spark, str(root), opened=opened)
    index = X.TextIndex.build(spark.createDataFrame(list(FILES.items()) + [("d/locked.txt", None)], "path string, text string"), f"file://{tmp_path_factory.mktemp('index')}/x", max_bytes=4096)
    return index, files, opened


def test_every_case_equals_a_search_of_all_files(spark, where):
    index, *_ = where
    texts = spark.createDataFrame(list(FILES.items()), "path string, text string")
    for scope in ("", "d"):
        small = O.in_scope(texts, scope, 4096).persist()
        for pattern, options in CASES:
            want = sorted(map(tuple, O.grep(small, pattern, **options).collect()))
            got = sorted(map(tuple, X.search_lines(index, texts, pattern, scope=scope, max_bytes=4096, **options).collect()))
            assert got == want, (pattern, options)
        small.unpersist()


def test_one_call_opens_only_what_may_match(where):
    index, files, opened = where
    before = opened.value
    found = X.search_text(index, files, "catal", ignore_case=True, max_bytes=4096, seconds=120)
    assert [x[:3] for x in found.lines] == [("d/b.txt", 1, 3)] and opened.value - before <= 2  # the lines, and whether there are more
    assert (found.searched, found.oversize, found.unreadable, found.opened, found.timed_out, found.truncated, found.late) == (6, 1, 1, 1, 0, False, False)
    found = X.search_text(index, files, "cat", ignore_case=True, scope="d", most=2, max_bytes=4096, seconds=120)
    assert [x[:2] for x in found.lines] == [("d/b.txt", 1), ("d/g.txt", 2)] and (found.searched, found.oversize, found.unreadable, found.opened, found.truncated) == (3, 1, 1, 2, False)
    assert X.search_text(index, files, "cat", ignore_case=True, most=1, max_bytes=4096, seconds=120).truncated
    assert X.search_text(index, files, "cat", ignore_case=True, chars=30, max_bytes=4096, seconds=120).truncated


def test_a_match_that_takes_too_long_ends(where):
    index, files, _ = where
    start = time.perf_counter()
    found = X.search_text(index, files, r"(a|aa)+$", regex=True, match_s=0.3, max_bytes=4096, seconds=120)
    assert found.timed_out == 1 and not found.late and time.perf_counter() - start < 60
    # One that is as slow elsewhere is settled at once here.
    assert X.search_text(index, files, r"(a+)+$", regex=True, match_s=0.3, max_bytes=4096, seconds=120).timed_out == 0


def test_a_search_that_takes_too_long_is_given_up(where):
    index, files, _ = where
    found = X.search_text(index, files, "cat", max_bytes=4096, seconds=0.01)
    assert found.late and found.truncated and not found.lines and found.searched == 6


def test_patterns_that_are_none(where):
    index, files, _ = where
    for bad in ("", "(", "a{2"):
        with pytest.raises(ValueError):
            X.search_lines(index, files, bad, regex=True)


def test_trigrams_of_texts(spark):
    got = spark.createDataFrame([("AbCd",), ("ab",), ("",), (None,), ("aaaa",)], "t string").select(T.text_trigrams(T.folded(F.col("t"))).alias("x"))
    assert [r.x for r in got.collect()] == [["abc", "bcd"], [], [], [], ["aaa"]]


def test_files_on_several_shelves(spark, tmp_path):
    """More files than a shelf holds, read by one task; equal paths, empty, short and null texts, and characters beyond the first plane."""
    word = F.concat(F.lit("w"), F.col("id"), F.when(F.col("id") % 1000 == 7, "\U0001f600\U0001f601\U0001f602 end").otherwise(""))
    texts = spark.range(2 * X.SHELF_FILES + 100).coalesce(1).select(F.concat(F.lit("p"), F.col("id") - F.col("id") % 2).alias("path"), F.when(F.col("id") % 5 == 4, "").when(F.col("id") % 5 == 3, "w").otherwise(word).alias("text"))
    texts = texts.union(spark.createDataFrame([("none", None)], "path string, text string")).coalesce(1).persist()
    index = X.TextIndex.build(texts, f"file://{tmp_path}/x")
    assert spark.read.parquet(f"{index.root}/shelves").count() == 3 and not os.path.exists(f"{tmp_path}/x/staged")
    assert spark.read.parquet(f"{index.root}/postings").groupBy("shelf", "trigram").count().where("count > 1").isEmpty()
    for pattern, options in [("w123", {}), ("\U0001f600\U0001f601\U0001f602", {}), ("w77\\d|w4000$", {"regex": True}), ("w1001|zzzz", {"regex": True}), ("😂 e", {})]:
        want = sorted(map(tuple, O.grep(texts.where("text IS NOT NULL"), pattern, **options).collect()))
        assert sorted(map(tuple, X.search_lines(index, texts, pattern, **options).collect())) == want, pattern
        # Two files of one path count as one, which may match if either does.
        may = [r.path for r in index.candidates(pattern, options.get("regex", False)).collect()]
        assert len(may) == len(set(may)) < 300
    texts.unpersist()


def test_an_index_of_nothing(spark, tmp_path):
    index = X.TextIndex.build(spark.createDataFrame([], "path string, text string"), f"file://{tmp_path}/x")
    assert index.candidates("abc").count() == 0 and index.candidates("a").count() == 0 and X.search_notes(index).first().searched == 0


def test_many_patterns_find_what_each_finds_and_read_the_texts_once(spark, tmp_path, monkeypatch):
    texts = [("a/1.txt", "The cat\nsat on 12 mats\n\nTHE END."), ("a/2.txt", "other words\nof the cats"), ("b/3.txt", "x" * 90), ("b/4.txt", None), ("b/5.txt", ""), ("a/6.txt", "a" * 60 + "b")]
    df = spark.createDataFrame(texts, "path string, text string")
    index = X.TextIndex.build(df, f"{tmp_path}/many")
    patterns = [("the", {"ignore_case": True}), ("cat", {"whole_word": True}), (r"[0-9]+", {"regex": True}), (r"^o\w+", {"regex": True}), ("absent", {}), (r"x{80}", {"regex": True}), (r"\w+t|12", {"regex": True, "whole_word": True, "ignore_case": True}), (r"(a|aa)+$", {"regex": True})]
    cuts, real = [], X.line_rows
    monkeypatch.setattr(X, "line_rows", lambda rows: cuts.append(1) or real(rows))
    for bounds in ({}, {"scope": "a"}, {"max_bytes": 80}):
        cuts.clear()
        got = X.search_many(index, df, patterns, match_s=0.05, **bounds)
        assert len(cuts) == 1
        one = [(i, *r) for i, (p, o) in enumerate(patterns) for r in X.search_lines(index, df, p, **o, match_s=0.05, **bounds).select("path", "line", "place", "text").collect()]
        assert sorted(tuple(r) for r in got.select("pattern", "path", "line", "place", "text").collect()) == sorted(one)
        assert {r[0] for r in one} >= {0, 1, 2, 3} and (7, "a/6.txt", 1, X.TIMED_OUT) in {r[:4] for r in one}
    monkeypatch.setattr(X, "TOGETHER", 3)
    assert sorted(r[:4] for r in one) == sorted(tuple(r) for r in X.search_many(index, df, patterns, max_bytes=80, match_s=0.05).select("pattern", "path", "line", "place").collect())
