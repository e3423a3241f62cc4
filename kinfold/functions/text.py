"""Text columns with Unicode-aware white space, as Python's str methods have it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f names it; a plain expression would be repeated each time."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def filled(c: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_group(c: Column, pattern: str, needs: tuple[str, ...] = (), low: Column | None = None) -> Column:
    """The first group of the first match, null if there is none or it is empty.

    needs: texts in lower case of which every match holds one in some case. A text without them isn't searched, which
    matters for patterns that try many places or long stretches from each. low: the text in lower case, if it is at hand.
    """
    found = F.get(F.filter(F.array(F.regexp_extract(c, pattern, 1)), lambda x: x != ""), 0)
    low = F.lower(c) if low is None else low
    return F.when(reduce(lambda a, b: a | b, [low.contains(x) for x in needs]), found) if needs else found


def split_list(c: Column, separators: str = ",") -> Column:
    """Stripped non-blank parts."""
    return F.filter(F.transform(F.split(c, separators, -1), strip), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+", -1), lambda x: x != "")


def number_at_least_zero(c: Column) -> Column:
    """Text as a double of zero or more, else null. Digits may be grouped by single underscores; nan is refused."""
    text = strip(c)
    plain = text.rlike(r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$|(?i)^\+?inf(inity)?$")
    value = F.when(plain, F.regexp_replace(F.regexp_replace(text, "_", ""), r"(?i)^\+?inf(inity)?$", "Infinity").try_cast("double"))
    return F.when(value >= 0, value)


def note_layout(c: Column) -> Column:
    """Line ends as \\n, tabs and runs of other white space as one space."""
    lines = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(lines, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")


#: A rule of three or more - = _ *, or a line "candidate N"; a rule on the first line doesn't split.
BLOCK_BREAK = r"(?iUd)\n\s*(?:---+|===+|___+|\*\*\*+)\s*\n|\n\s*candidate\s*(?:\d+|#\d+)\s*:?\s*\n"


def blocks(c: Column) -> Column:
    """array<struct<pos, text>>: non-blank blocks with their position before blanks were dropped."""
    numbered = F.transform(F.split(c, BLOCK_BREAK, -1), lambda x, i: F.struct(i.alias("pos"), strip(x).alias("text")))
    return F.filter(numbered, lambda b: b["text"] != "")
