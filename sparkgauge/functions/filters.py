"""Response filters: Column of array<string> to Column, composable by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgauge.registry import FILTERS


@FILTERS.register("take_first")
def take_first() -> Callable[[Column], Column]:
    """The first response, as a scalar; null for an empty array."""
    return lambda r: F.get(r, F.lit(0))


@FILTERS.register("take_first_k")
def take_first_k(k: int) -> Callable[[Column], Column]:
    return lambda r: F.slice(r, 1, k)


@FILTERS.register("majority_vote")
def majority_vote() -> Callable[[Column], Column]:
    """The most common response, as an array of one; of several, the one seen first."""

    def vote(r: Column) -> Column:
        counted = F.transform(F.array_distinct(r), lambda v: F.struct((-F.size(F.filter(r, lambda x: x == v))).alias("n"), F.array_position(r, v).alias("at"), v.alias("v")))
        return F.when(F.size(r) > 0, F.array(F.array_min(counted)["v"])).otherwise(r)

    return vote


@FILTERS.register("regex")
def regex(pattern: str, group_select: int = 0, fallback: str = "[invalid]", group: int | None = None) -> Callable[[Column], Column]:
    """Per response the ``group_select``-th match, trimmed, or the fallback.

    ``group`` is the capture group to read; by default the first one if the pattern has any.
    """
    import re

    index = min(1, re.compile(pattern).groups) if group is None else group

    def one(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(index))
        got = F.try_element_at(found, F.lit(group_select + 1 if group_select >= 0 else group_select))
        return F.when(F.trim(got) != "", F.trim(got)).otherwise(fallback)

    return lambda r: F.transform(r, one)


@FILTERS.register("remove_whitespace")
def remove_whitespace() -> Callable[[Column], Column]:
    """Cut one leading space."""
    return lambda r: F.transform(r, lambda x: F.regexp_replace(x, "^ ", ""))


@FILTERS.register("lowercase")
def lowercase() -> Callable[[Column], Column]:
    return lambda r: F.transform(r, F.lower)


@FILTERS.register("uppercase")
def uppercase() -> Callable[[Column], Column]:
    return lambda r: F.transform(r, F.upper)


@FILTERS.register("map")
def mapping(mapping_dict: dict[str, str], default_value: str | None = None) -> Callable[[Column], Column]:
    pairs = F.create_map(*(F.lit(x) for kv in mapping_dict.items() for x in kv))
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(pairs, x), F.lit(default_value)))


@FILTERS.register("normalise")
def normalise(regexes_to_ignore: tuple[str, ...] = (), ignore_case: bool = True, ignore_punctuation: bool = True, ignore_numbers: bool = False) -> Callable[[Column], Column]:
    def one(x: Column) -> Column:
        for p in regexes_to_ignore:
            x = F.regexp_replace(x, p, "")
        x = F.lower(x) if ignore_case else x
        x = F.regexp_replace(x, r"\p{P}", "") if ignore_punctuation else x
        return F.regexp_replace(x, "[0-9]", "") if ignore_numbers else x

    return lambda r: F.transform(r, one)


@FILTERS.register("multi_choice")
def multi_choice(choices: Column, fallback: str = "[invalid]") -> Callable[[Column], Column]:
    """Per response a letter in brackets, else the choice whose text stands first in it, else a bare letter."""

    def one(x: Column) -> Column:
        letter = F.regexp_extract(x, r"\(([A-Z])\)", 1)
        low = F.lower(x)
        spots = F.transform(choices, lambda c, i: F.struct(F.instr(low, F.lower(c)).alias("at"), i.alias("i")))
        first = F.array_min(F.filter(spots, lambda s: s["at"] > 0))
        bare = F.regexp_extract(x, r"(?:^|[\s:])([A-Z])(?:[\s.:,)]|$)", 1)
        return F.when(letter != "", letter).when(first.isNotNull(), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").substr(first["i"] + 1, F.lit(1))).when(bare != "", bare).otherwise(fallback)

    return lambda r: F.transform(r, one)


def question_choices(question: Column) -> Column:
    """The texts of "A. text" lines of a question."""
    return F.regexp_extract_all(question, F.lit(r"\b[A-Z]\.\s+([^\n]*)"), F.lit(1))


@FILTERS.register("simple_multi_choice")
def simple_multi_choice(question: Column) -> Callable[[Column], Column]:
    """Per response, without signs, the letter of the choice of ``question`` that stands first in it, else the response.

    Choices are lettered in their order; of equal ones the last letter counts.
    """
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def one(x: Column) -> Column:
        bare = strip(F.regexp_replace(x, r"(?U)[^\w\s]", ""))
        choices = F.transform(question_choices(question), strip)
        spots = F.transform(choices, lambda c, i: F.struct(F.instr(bare, c).alias("at"), i.alias("i"), c.alias("c")))
        first = F.array_min(F.filter(spots, lambda s: s["at"] > 0))
        last = F.size(choices) - F.array_position(F.reverse(choices), first["c"])
        return F.when(first.isNotNull(), F.chr(F.lit(65) + last)).otherwise(bare)

    return lambda r: F.transform(r, one)


def pipeline(steps: list[tuple]) -> Callable[[Column], Column]:
    """A chain of (name, keyword arguments) steps from the registry."""
    made = [FILTERS.find(name)(**(args[0] if args else {})) for name, *args in steps]
    return lambda r: reduce(lambda x, f: f(x), made, r)
