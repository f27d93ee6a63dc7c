"""Text helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def js_trim(text: Column) -> Column:
    """Trim every Unicode white-space character (``trim`` alone strips only spaces)."""
    return F.btrim(text, F.lit(P.JS_SPACE_CHARS))


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.PY_SPACE_CHARS))


def lines(text: Column) -> Column:
    """Pieces between line feeds; trailing empty lines are kept."""
    return F.split(text, "\n", -1)


def universal_lines(text: Column) -> Column:
    """Pieces between any line break; a final empty line is dropped."""
    closing = F.when(F.endswith(text, F.lit("\r\n")), 2).when(
        F.right(text, F.lit(1)).isin(list(P.PY_LINE_BREAK_CHARS)), 1).otherwise(0)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.left(text, F.length(text) - closing), P.PY_LINE_BREAK, -1))


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{P.JS_SPACE}]+")).cast("long")


def first_token(stripped: Column) -> Column:
    return F.regexp_extract(stripped, f"^[^{P.PY_SPACE}]+", 0)


def fragments_to_text(items: Column) -> Column:
    """Text of one page from its ordered text-layer fragments (``array<struct<str:string>>``)."""
    return js_trim(F.array_join(F.transform(items, lambda item: F.coalesce(item["str"], F.lit(""))), " "))


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def strip_structure_tags(text: Column) -> Column:
    return F.regexp_replace(text, P.STRUCTURE_TAG, "")


def has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def issue_list(*rules: tuple[Column, Column | str]) -> Column:
    """Names of the rules that hold, in the given order."""
    return F.array_compact(F.array(*[
        F.when(rule, F.lit(name) if isinstance(name, str) else name) for rule, name in rules]))


def before(array: str) -> Column:
    """The array shifted so that each position shows the element before it.

    Neighbours are zipped in rather than looked up by index inside a lambda: an array that a
    lambda captures may be inlined there by the optimizer and computed again for every element.
    """
    return F.slice(F.concat(F.array(F.lit(None)), array), F.lit(1), F.size(array))


def ahead(array: str, steps: int) -> Column:
    """The array from ``steps`` on; zipping fills the end with NULL."""
    return F.slice(array, F.lit(1 + steps), F.size(array))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Values that :func:`running` adds up in one go; it copies an array for each.
RUN = 64


def running(values: Column) -> Column:
    """Sums up to and including each element of a ``bigint`` array.

    Adding to an array copies it, so sums run within short stretches, and the totals of stretches are added on top.
    """
    def last(sums: Column) -> Column:
        return F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0).cast("long"))

    def added(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array().cast("array<bigint>"), lambda sums, n: F.array_append(sums, last(sums) + n))

    def summed(numbers: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")),
                                lambda k: added(F.slice(numbers, k * RUN + 1, F.lit(RUN))))
        return let(stretches, lambda parts: let(added(F.transform(parts, last)), lambda totals: F.flatten(F.transform(
            parts, lambda part, k: let(F.get(totals, k) - last(part), lambda ahead_: F.transform(part, lambda n: n + ahead_))))))

    return let(values, lambda numbers: F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(summed(numbers)))
