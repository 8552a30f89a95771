"""Column helpers shared by the marts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
# A sum counts units of 1/10000, in two 64-bit halves of this many low bits and the rest.
MONEY_UNITS, LOW_BITS = 10_000, 30


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month(c: Column | str) -> Column:
    """``YYYY-MM`` of a date."""
    return F.date_format(col(c), "yyyy-MM")


def money_units(c: Column | str) -> Column:
    """``c`` as ``MONEY``, counted in units of its last decimal.

    A value below 1e11 that is a number of units already is counted in plain arithmetic; its
    double has one such number. Only others are rounded as decimals, which costs far more.
    """
    c = col(c)
    x = c.cast("double")
    k = F.rint(x * MONEY_UNITS)
    return F.when((F.abs(x) < 1e11) & (k / MONEY_UNITS == x), k.cast("bigint")).otherwise(
        (c.cast(MONEY) * MONEY_UNITS).cast("bigint"))


def exact_sum(c: Column | str) -> Column:
    """Sum in fixed point, so the result does not depend on row order.

    The halves are summed as 64-bit integers; they are put together once a group, as a decimal
    only where a double would not hold the units.
    """
    units = money_units(c)
    high = F.sum(F.shiftright(units, LOW_BITS))
    low = F.sum(units.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    total = F.try_add(F.try_multiply(high, F.lit(1 << LOW_BITS)), low)
    wide = high.cast("decimal(20,0)") * F.lit(1 << LOW_BITS).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return F.when(total.between(-(1 << 53), 1 << 53), total.cast("double") / MONEY_UNITS).otherwise(
        (wide * F.lit("0.0001").cast("decimal(4,4)")).cast("double"))


def by_value(pair: Column) -> Column:
    """A pivot without a list of values: the (value, measures) pairs of a group, in order of the value.

    A group has one pair per value, as it was aggregated by the value before.
    """
    return F.array_sort(F.collect_list(pair))


def sum0(c: Column | str) -> Column:
    """Exact sum where a group of only NULLs counts as 0."""
    return F.coalesce(exact_sum(c), F.lit(0.0))


def exact_avg(c: Column | str) -> Column:
    """Mean over non-NULL values, from an exact sum."""
    c = col(c)
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))


RATE = "decimal(28,10)"


def rate_avg(c: Column | str) -> Column:
    """Mean of a ratio column at ten decimals, independent of row order."""
    c = col(c)
    return F.try_divide(F.sum(c.cast(RATE)).cast("double"), F.count(c).cast("double"))


def weighted_avg(c: Column | str, weight: Column | str) -> Column:
    """sum(x * w) / sum(w) over rows where x is known."""
    c, w = col(c), col(weight)
    known = F.when(c.isNotNull(), w)
    return F.try_divide(F.sum((c * w).cast(RATE)).cast("double"), F.sum(known).cast("double"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Single-row frames as one row."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def n_unique(c: Column | str) -> Column:
    """Distinct count where NULL is one more value."""
    c = col(c)
    return (F.count_distinct(c) + F.max(c.isNull().cast("bigint"))).cast("bigint")


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den where den > 0, else a constant (NULL by default)."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def days_between(end: Column | str, start: Column | str) -> Column:
    return F.datediff(col(end), col(start))


def lookup(key: Column, mapping: dict[str, object], default: object) -> Column:
    """Dictionary lookup as a CASE expression."""
    out: Column | None = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def worst_flag(*flags: Column) -> Column:
    """ACTUAL only when every input is ACTUAL; unknown counts as PARTIAL."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & (F.coalesce(f, F.lit("PARTIAL")) == "ACTUAL")
    return F.when(ok, F.lit("ACTUAL")).otherwise(F.lit("PARTIAL"))


def flag_of_rows(flag: Column | str) -> Column:
    """Aggregate form of :func:`worst_flag` over the rows of a group."""
    ok = F.bool_and(F.coalesce(col(flag), F.lit("PARTIAL")) == "ACTUAL")
    return F.when(ok, F.lit("ACTUAL")).otherwise(F.lit("PARTIAL"))


def _sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[object]]) -> DataFrame:
    """A configuration table as VALUES, whose exact size the optimizer knows."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
