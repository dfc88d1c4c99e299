"""Column functions over text: tokens, terms, stems, lines, matching, paths and globs."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "has", "had", "was", "one", "our", "out", "use", "with", "this", "that",
    "from", "have", "will", "your", "they", "them", "then", "than", "into", "over", "such", "when", "what", "which", "while", "were", "been", "also", "each",
)
TERM = r"[\p{L}\p{Nd}]+"
LONG_TERM = r"[\p{L}\p{Nd}]{2,}"
IDENTIFIER_CUT = r"(?<=\P{Lu})(?=\p{Lu})|(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})"
NEWLINE = r"\r\n|\r|\n"


def tokens(text: Column) -> Column:
    """Runs of characters that are not Unicode white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def has_token(text: Column) -> Column:
    """Whether there are any: the search ends at the first one."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits longer than one character, in order of appearance."""
    # Lower-casing first keeps runs apart as they are, and their order; runs of one character never match.
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_TERM), F.lit(0)))


def split_identifier(token: Column) -> Column:
    """Parts at lower-to-upper and digit boundaries."""
    return F.filter(F.split(token, IDENTIFIER_CUT), lambda p: p != "")


def stem(word: Column) -> Column:
    """The first suffix rule that fits: ing, ed, es, s."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n > 5) & word.endswith("ing"), cut(3))
        .when((n > 4) & word.endswith("ed"), cut(2))
        .when((n > 4) & word.endswith("es"), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def index_terms(text: Column) -> Column:
    """Words of the index, repeats included: runs split as identifiers, lower-cased, stemmed, without stop words and single characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    words = F.flatten(F.transform(runs, split_identifier))
    return F.filter(F.transform(words, lambda w: stem(F.lower(w))), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def trigrams(word: Column) -> Column:
    """Character trigrams of ^word$, marked as such."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.lit("3:"), F.substring(padded, i, F.lit(3))))


def lines(text: Column) -> Column:
    """Lines ended by CR LF, LF or CR; a terminator at the end adds none."""
    parts = F.split(text, NEWLINE, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.rlike(r"[\r\n]\z"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def newline_of(text: Column) -> Column:
    """The first terminator, or LF."""
    found = F.regexp_extract(text, NEWLINE, 0)
    return F.when(found == "", F.lit("\n")).otherwise(found)


def checked(pattern: str) -> str:
    """The pattern; one that Java, which runs it, can't parse raises ValueError. Without a session that shows only when it runs."""
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:
            raise ValueError(f"not a pattern: {e}") from None
    return pattern


#: What stands around the pattern of a whole word.
WHOLE = (r"(?<![\p{L}\p{Nd}_])(?>", r")(?![\p{L}\p{Nd}_])")


def matcher(pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> str:
    """A Java pattern; an empty or invalid one raises ValueError here. Whole words have no letter, digit or _ beside them.

    A match that isn't whole is not shortened to one that is; the search goes on behind its begin.
    """
    if not pattern:
        raise ValueError("an empty pattern")
    flags = "(?iu)" if ignore_case else ""
    body = checked(pattern) if regex else re.sub(r"([^\w\s])", r"\\\1", pattern)
    if whole_word:
        body = WHOLE[0] + body + WHOLE[1]
    return checked(flags + body)


def matches(line: Column, pattern: str) -> Column:
    return line.rlike(pattern)


def match_window(line: Column, at: Column, width: int = 400, before: int = 100) -> Column:
    """At most `width` characters around the 1-based place, with an ellipsis on each side that is cut."""
    start = F.greatest(F.lit(1), at - before)
    cut = F.substring(line, start, F.lit(width))
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(line), "…").otherwise("")))


def replace_literal(text: Column, old: str, new: str, ignore_case: bool = False, whole_word: bool = False) -> tuple[Column, Column]:
    """The text with every match replaced, and the number of matches."""
    pattern = matcher(old, ignore_case=ignore_case, whole_word=whole_word)
    return F.regexp_replace(text, pattern, new.replace("\\", r"\\").replace("$", r"\$")), F.regexp_count(text, F.lit(pattern))


def glob_pattern(glob: str) -> str:
    """An anchored pattern over paths whose separator is /.

    * and ? stay within a segment; ** as a whole segment is any number of them, none included. A glob
    of one segment is a name at any depth. Empty globs and segments .. raise ValueError.
    """
    whole = glob.strip().replace("\\", "/").lstrip("/")
    if not whole or re.search(r"(^|/)\.\.(/|$)", whole):
        raise ValueError(f"not a glob: {glob!r}")
    if "/" not in whole and whole != "**":
        whole = "**/" + whole
    # Any segments with the separator that joins them to the rest; several in a row are one.
    part = re.compile(r"^(?:\*\*/)+|(?:/\*\*)+(?=/|$)|^\*\*$|\*|\?|[^*?]")
    mark = {"*": "[^/]*", "?": "[^/]", "**": ".*"}
    return "^" + part.sub(lambda m: mark.get(m[0]) or ("(?:.*/)?" if m[0].endswith("**/") else "(?:/.*)?" if m[0].startswith("/**") else re.escape(m[0])), whole) + "$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sanitize(name: Column, keep: str = r"\p{L}\p{Nd}") -> Column:
    return F.regexp_replace(name, f"[^{keep}]", "_")
