"""Array expressions used by the in-row operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so ``body`` can use it often yet it is computed once.

    Needed because an expression captured by an array lambda is otherwise
    evaluated again for every element.  A fold over nothing hands the value to
    its finishing lambda as is, whereas ``transform`` would copy the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def running_total(values: Column) -> Column:
    """Inclusive prefix sums of an ``array<bigint>`` in log2(n) array passes.

    Pass p adds the array shifted by 2^p to itself, so the cost is n log n with
    no window and no shuffle; appending to an accumulator would be quadratic.
    """
    def add_shifted(total: Column, shift: Column) -> Column:
        size = F.size(total)
        gap = F.least(shift, size)
        shifted = F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap),
                           F.slice(total, F.lit(1), size - gap))
        return F.zip_with(total, shifted, lambda a, b: a + b)

    def totals(bound: Column) -> Column:
        last = F.ceil(F.log2(F.greatest(F.size(bound), F.lit(1)))).cast("int")
        shifts = F.transform(F.sequence(F.lit(0), last),
                             lambda p: F.pow(F.lit(2), p).cast("int"))
        return F.aggregate(shifts, bound, add_shifted)

    return let(values, totals)


def run_starts(items: Column, is_start: Callable[[Column, Column], Column]) -> Column:
    """Indexes of ``items`` at which a run begins.

    ``is_start(previous, current)`` decides for every element after the first.
    """
    return F.array_compact(F.transform(
        items,
        lambda x, i: F.when((i == 0) | is_start(F.get(items, i - 1), x), i)))


def one_run(length: Column) -> Column:
    """``length`` at the first place of a run, 0 at the others."""
    return F.concat(F.array(length), F.array_repeat(F.lit(0), length - 1))


def run_lengths(items: Column, is_start: Callable[[Column, Column], Column],
                body: Callable[[Column, Column], Column]) -> Column:
    """An array aligned with ``items``, made of ``body(first index, length)`` for each run.

    ``items`` must be a bound lambda variable or a plain column.
    """
    def lengths(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s, p: body(
            s, F.coalesce(F.get(starts, p + 1), F.size(items)) - s)))

    return let(run_starts(items, is_start), lengths)


def explode_at(df: DataFrame, columns: list[str] | tuple[str, ...], array: Column | str, position: str,
               value: str) -> DataFrame:
    """``columns`` plus position and value of every array element.

    For a plain explode the optimizer adds a filter "array is not empty" and
    pushes it below the projection that builds the array, which then is built
    twice.  The outer variant with the empty rows removed afterwards is not
    subject to that.
    """
    return (df.select(*columns, F.posexplode_outer(array).alias(position, value))
            .where(F.col(position).isNotNull()))


def inline_rows(df: DataFrame, columns: list[str] | tuple[str, ...], array: Column,
                never_null: str) -> DataFrame:
    """``columns`` plus the fields of every struct in ``array``; see ``explode_at``.

    ``never_null`` names a struct field that has a value in every element.
    """
    return df.select(*columns, F.inline_outer(array)).where(F.col(never_null).isNotNull())
