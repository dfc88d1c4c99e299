"""What a text must hold for a pattern to match in it: conditions over trigrams, and the trigrams of a text.

A condition is a trigram, ("and", parts), ("or", parts), or None where nothing can be said. It is derived from
literal runs of the pattern; whatever isn't understood ends a run and demands nothing, so a condition never rules out a match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Letters outside ASCII that Java takes for an ASCII letter where case doesn't count, and those letters.
ALIKE = ("Kſİı", "ksii")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Condition = str | tuple | None
Combine = Callable[[Column, Column], Column]


def folded(text: Column) -> Column:
    """The text as its trigrams see it: ASCII letters in lower case, and letters alike to them as those."""
    return F.translate(text, UPPER + ALIKE[0], LOWER + ALIKE[1])


def text_trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a folded text, sorted; those over a line's end are among them, and do no harm. None of a null text."""

    @arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted({t[i : i + 3] for i in range(len(t) - 2)}) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def trigram_numbers(text: str) -> np.ndarray:
    """The distinct runs of three characters of a folded text as numbers, ascending: 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def trigram_number(trigram: str) -> int:
    return int(trigram_numbers(trigram)[0])


def _fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER + ALIKE[0], LOWER + ALIKE[1]))


def all_of(parts: list[Condition]) -> Condition:
    known = list(dict.fromkeys(q for p in parts if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])))
    return None if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def any_of(parts: list[Condition]) -> Condition:
    """Nothing is required if one of the alternatives requires nothing."""
    if not parts or any(p is None for p in parts):
        return None
    known = list(dict.fromkeys(parts))
    return known[0] if len(known) == 1 else ("or", tuple(known))


def literal(text: str, ignore_case: bool = False) -> Condition:
    """All trigrams of a literal; where case doesn't count, those of ASCII alone, as other letters have cases of their own."""
    s = _fold(text)
    return all_of([t for t in (s[i : i + 3] for i in range(len(s) - 2)) if not ignore_case or t.isascii()])


def required(pattern: str, ignore_case: bool = False) -> Condition:
    """The condition of a Java pattern that has been checked already."""
    reader = _Reader(pattern, ignore_case or "i" in _flags(pattern))
    if "x" in _flags(pattern):
        return None  # spaces and comments would not be what they seem
    out = reader.alternatives()
    return out if reader.at == len(pattern) else None


def _flags(pattern: str) -> str:
    """Letters of all inline flags that a pattern may set."""
    found, i = "", pattern.find("(?")
    while i >= 0:
        j = i + 2
        while j < len(pattern) and (pattern[j].isalpha() or pattern[j] == "-"):
            j += 1
        if j < len(pattern) and pattern[j] in ":)":
            found += pattern[i + 2 : j]
        i = pattern.find("(?", i + 2)
    return found


class _Reader:
    """Reads a pattern from left to right, one alternative after the other."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.at, self.ignore_case = pattern, 0, ignore_case

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def alternatives(self) -> Condition:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return any_of(parts)

    def sequence(self) -> Condition:
        """One alternative: the runs of literal characters that it can't do without, and what its groups require."""
        found: list[Condition] = []
        run = ""
        while self.at < len(self.p) and self.peek() not in "|)":
            char, inner = self.atom()
            least, most = self.quantifier()
            if char is not None and (least, most) == (1, 1):
                run += char
                continue
            # The character before a + is there at least once, but what follows it need not follow this one.
            found.append(literal(run + (char or "") if least else run, self.ignore_case))
            run = char if char is not None and len(char) == 1 and least else ""
            found.append(inner if least else None)
        found.append(literal(run, self.ignore_case))
        return all_of(found)

    def atom(self) -> tuple[str | None, Condition]:
        """(literal characters, condition) of the next atom; (None, None) for any other character, ("", None) for what takes no character."""
        c = self.peek()
        self.at += 1
        if c == "\\":
            return self.escape(), None
        if c == "[":
            self.character_class()
            return None, None
        if c == "(":
            return self.group()
        if c in "^$":
            return "", None
        return (None, None) if c == "." else (c, None)

    def escape(self) -> str | None:
        c = self.peek()
        self.at += 1
        if c == "Q":
            end = self.p.find("\\E", self.at)
            text = self.p[self.at :] if end < 0 else self.p[self.at : end]
            self.at = len(self.p) if end < 0 else end + 2
            return text
        if c in ("b", "B", "A", "z", "Z", "G"):
            # \b{g} and the like have their own end.
            if self.peek() == "{":
                self.at = self.p.find("}", self.at) + 1 or len(self.p)
            return ""
        if c in ("p", "P", "x", "N", "k") and self.peek() in ("{", "<"):
            self.at = self.p.find("}" if self.peek() == "{" else ">", self.at) + 1 or len(self.p)
            return None
        if c in ("p", "P", "c"):
            self.at += 1
            return None
        if c in ("x", "u"):
            self.at += 2 if c == "x" else 4
            return None
        if c.isdigit():
            while self.peek().isdigit():
                self.at += 1
            return None
        return None if c.isalpha() else c

    def character_class(self) -> None:
        """Past the end of a class, with those in it; a ] at its start is a character."""
        if self.peek() == "^":
            self.at += 1
        first = True
        while self.at < len(self.p):
            c = self.peek()
            self.at += 1
            if c == "\\":
                if self.peek() == "Q":
                    self.at = self.p.find("\\E", self.at) + 2 if "\\E" in self.p[self.at :] else len(self.p)
                else:
                    self.at += 1
            elif c == "[":
                self.character_class()
            elif c == "]" and not first:
                return
            first = False

    def group(self) -> tuple[str | None, Condition]:
        looks = False
        if self.peek() == "?":
            self.at += 1
            if self.peek(2) in ("<=", "<!") or self.peek() in ("=", "!"):
                looks = True
                self.at += 2 if self.peek() == "<" else 1
            elif self.peek() in (">", ":"):
                self.at += 1
            elif self.peek() == "<":
                self.at = self.p.find(">", self.at) + 1 or len(self.p)
            else:
                while self.peek().isalpha() or self.peek() == "-":
                    self.at += 1
                if self.peek() == ")":  # flags alone, for what follows
                    self.at += 1
                    return "", None
                self.at += 1
        inner = self.alternatives()
        self.at += 1
        # What is looked at isn't required, as it may be looked for in vain.
        return ("", None) if looks else (None, inner)

    def quantifier(self) -> tuple[int, int | None]:
        c = self.peek()
        least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (1, 1)) if c else (1, 1)
        if c == "{":
            end = self.p.find("}", self.at)
            bounds = self.p[self.at + 1 : end].split(",")
            least = int(bounds[0])
            # Often enough is all that counts: {3} is taken as once or more.
            most = None
            self.at = end + 1
        elif c and c in "*+?":
            self.at += 1
        else:
            return 1, 1
        if self.peek() and self.peek() in "?+":
            self.at += 1
        return least, most


def trigrams_of(condition: Condition) -> list[str]:
    """All trigrams that a condition names."""
    if condition is None:
        return []
    if isinstance(condition, str):
        return [condition]
    return sorted({t for part in condition[1] for t in trigrams_of(part)})


def holds(condition: Condition, has: dict[str, Column], both: Combine = and_, either: Combine = or_) -> Column:
    """A condition as a column, given one for each of its trigrams: of booleans, or of what `both` and `either` combine, such as sets of places."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, str):
        return has[condition]
    return reduce(both if condition[0] == "and" else either, [holds(part, has, both, either) for part in condition[1]])
