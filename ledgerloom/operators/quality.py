"""Data-quality checks. Each returns rows (check_name, severity, passed, bad_rows)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import literal_table
from ledgerloom.operators.ingest import to_date
from ledgerloom.policy import Policy
from ledgerloom.session import FEW, materialize
from ledgerloom.sources.contracts import CONTRACTS

# ---- fixed values -------------------------------------------------------
QUANTITY_COLUMNS = ["qty_ordered", "qty_shipped", "qty_returned", "onhand_qty", "qty_received"]
AMOUNT_COLUMNS = ["amount", "unit_price", "cost_per_unit_krw", "net_payout", "gross_sales"]
# ---- end of fixed values ------------------------------------------------


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def counted(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """All (name, severity, bad-row condition) checks in one pass over the rows."""
    counts = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(name).alias("check_name"), F.lit(severity).alias("severity"),
            (F.col(f"c{i}") == 0).alias("passed"), F.col(f"c{i}").alias("bad_rows"))
        for i, (name, severity, _) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def null_keys(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    return [(f"null_business_key_{k}", "CRITICAL", F.col(k).isNull()) for k in CONTRACTS[table].key if k in df.columns]


def type_coercion(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    """Only numbers can fail; dates are always read leniently."""
    contract = CONTRACTS[table]
    strings = {name for name, kind in df.dtypes if kind == "string"}
    out = []
    for c, kind in contract.columns.items():
        if c in df.columns:
            bad = F.lit(False)
            if c in strings and kind in ("BIGINT", "DOUBLE"):
                bad = F.col(c).isNotNull() & F.col(c).try_cast(kind.lower()).isNull()
            out.append((f"type_coercion_{c}", "HIGH", bad))
    return out


def quantity_range(df: DataFrame) -> list[tuple[str, str, Column]]:
    return [(f"quantity_range_{c}", "HIGH", _number(c) < 0) for c in QUANTITY_COLUMNS if c in df.columns]


def amount_outlier(df: DataFrame, policy: Policy) -> list[tuple[str, str, Column]]:
    return [(f"amount_outlier_{c}", "MEDIUM", F.abs(_number(c)) > policy.amount_outlier)
            for c in AMOUNT_COLUMNS if c in df.columns]


def date_range(df: DataFrame, table: str, policy: Policy, days: dict[str, Column] | None = None) -> list[tuple[str, str, Column]]:
    """Two checks a date column; ``days`` are columns of texts that were read as dates before."""
    days = days or {}
    newest = F.lit(policy.as_of + dt.timedelta(days=policy.date_future_days))
    oldest = F.lit(policy.as_of - dt.timedelta(days=policy.date_past_days))
    kinds = dict(df.dtypes)
    out = []
    for c in CONTRACTS[table].of_type("DATE"):
        if c in kinds:
            day = days.get(c, to_date(F.col(c)) if kinds[c] == "string" else F.col(c))
            out += [(f"date_range_future_{c}", "MEDIUM", day > newest), (f"date_range_past_{c}", "MEDIUM", day < oldest)]
    return out


def required_columns(df: DataFrame, table: str) -> DataFrame:
    """Missing required columns, found in the schema; no data is read."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in CONTRACTS[table].required if c.lower() not in have]
    return literal_table(
        df.sparkSession, ["check_name", "severity", "passed", "bad_rows"],
        [("required_columns", "CRITICAL", not missing, len(missing))],
    ).withColumn("bad_rows", F.col("bad_rows").cast("bigint"))


def _one_row(df: DataFrame, name: str, severity: str, bad: Column) -> DataFrame:
    bad = F.coalesce(bad, F.lit(0)).cast("bigint")
    return df.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"),
                     (bad == 0).alias("passed"), bad.alias("bad_rows"))


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Rows beyond the first per key; NULL equals NULL."""
    keys = [k for k in CONTRACTS[table].key if k in df.columns]
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(F.sum("_x").alias("_x"))
    return _one_row(extra, "duplicate_business_keys", "HIGH", F.col("_x"))


def charge_types(df: DataFrame, policy: Policy) -> DataFrame:
    known = policy.charge_policy(df.sparkSession).select("charge_type")
    unknown = df.select("charge_type").distinct().join(F.broadcast(known), "charge_type", "left_anti")
    return _one_row(unknown.agg(F.count(F.lit(1)).alias("_x")), "charge_type_validation", "HIGH", F.col("_x"))


def missing_months(df: DataFrame, period: str = "period") -> DataFrame:
    """Months without a row between the first and last ``YYYY-MM`` seen."""
    seen = df.select(F.trim(F.col(period)).alias("period")).filter(
        F.col("period").rlike("^[0-9]{4}-[0-9]{2}")).select(F.substring("period", 1, 7).alias("period")).distinct()
    day = F.try_to_date(F.concat("period", F.lit("-01")), "yyyy-MM-dd")
    span = seen.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo IS NOT NULL")
    every = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("_d")).select(
        F.date_format("_d", "yyyy-MM").alias("period"))
    return every.join(seen, "period", "left_anti")


def period_continuity(df: DataFrame) -> DataFrame:
    gaps = missing_months(df).agg(F.count(F.lit(1)).alias("_x"))
    return _one_row(gaps, "period_continuity", "MEDIUM", F.col("_x"))


def total_exceeds(left: DataFrame, left_qty: str, right: DataFrame, right_qty: str, name: str) -> DataFrame:
    """One total against another; both sides are a single row."""
    a = left.agg(F.sum(_number(left_qty).cast("decimal(18,4)")).alias("_a")).withColumn("_one", F.lit(1))
    b = right.agg(F.sum(_number(right_qty).cast("decimal(18,4)")).alias("_b")).withColumn("_one", F.lit(1))
    over = a.join(b, "_one")
    return _one_row(over, name, "MEDIUM", (F.col("_a") > F.col("_b")).cast("int"))


def run_all(
    df: DataFrame, table: str, policy: Policy, context: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Every check that applies to ``table``; ``context`` holds tables loaded with it."""
    context = context or {}
    single = [
        *null_keys(df, table), *type_coercion(df, table), *quantity_range(df), *amount_outlier(df, policy),
        *date_range(df, table, policy)]
    out = required_columns(df, table).unionByName(counted(df, single)).unionByName(duplicate_keys(df, table))
    if table == "fact_charge_actual" and "charge_type" in df.columns:
        out = out.unionByName(charge_types(df, policy))
    if "period" in df.columns:
        out = out.unionByName(period_continuity(df))
    if table == "fact_shipment" and "fact_inventory_snapshot" in context:
        out = out.unionByName(total_exceeds(
            df, "qty_shipped", context["fact_inventory_snapshot"], "onhand_qty", "cross_shipment_vs_inventory"))
    if table == "fact_return" and "fact_shipment" in context:
        out = out.unionByName(total_exceeds(
            df, "qty_returned", context["fact_shipment"], "qty_shipped", "cross_return_vs_shipment"))
    return out


#: Offending rows that a quantity check names.
SAMPLE_ROWS = 5


def samples(df: DataFrame, by: str, row_no: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(by, check_name, sample): the first ``SAMPLE_ROWS`` row numbers that break each check.

    The rank is asked for below a constant, so every task sends at most that many rows per
    group into the shuffle, however many offend.
    """
    rules = [(name, cond) for name, _, cond in checks]
    hits = _broken(df, rules).select(by, row_no, _names(rules).alias("check_name")).filter("check_name IS NOT NULL")
    w = Window.partitionBy(by, "check_name").orderBy(row_no)
    first = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= SAMPLE_ROWS)
    return first.groupBy(by, "check_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row_no)), lambda r: r.cast("string")), ", ").alias("sample"))


def report_by_file(df: DataFrame, table: str, policy: Policy, by: str, row_no: str | None = None) -> DataFrame:
    """The whole rule set for each file: (by, check_name, severity, passed, bad_rows, sample).

    One pass counts all row checks; keys, charge types and months are aggregated within the
    file. ``row_no`` numbers the rows of a file from 1; without it no rows are named. A file
    without rows has no report.
    """
    quantities = quantity_range(df)
    # A text is read as a date once a row, not once a check.
    texts = [c for c, kind in df.dtypes if kind == "string" and c in CONTRACTS[table].of_type("DATE")]
    dated = df.withColumns({f"_day_{c}": to_date(F.col(c)) for c in texts})
    single = [*null_keys(df, table), *type_coercion(df, table), *quantities, *amount_outlier(df, policy),
              *date_range(df, table, policy, {c: F.col(f"_day_{c}") for c in texts})]
    keys = [k for k in CONTRACTS[table].key if k in df.columns]
    per_key = df.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("_n"))
    extra = per_key.groupBy(by).agg((F.sum("_n") - F.count(F.lit(1))).alias("_twice"))
    facts = dated.groupBy(by).agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(single)]).join(extra, by)
    missing = [c for c in CONTRACTS[table].required if c.lower() not in {x.lower() for x in df.columns}]
    checks = [("required_columns", "CRITICAL", F.lit(len(missing)))]
    checks += [(name, severity, F.col(f"c{i}")) for i, (name, severity, _) in enumerate(single)]
    checks.append(("duplicate_business_keys", "HIGH", F.col("_twice")))
    if table == "fact_charge_actual" and "charge_type" in df.columns:
        known = policy.charge_policy(df.sparkSession).select("charge_type")
        unknown = df.select(by, "charge_type").distinct().join(F.broadcast(known), "charge_type", "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("_unknown"))
        facts = facts.join(unknown, by, "left")
        checks.append(("charge_type_validation", "HIGH", F.col("_unknown")))
    if "period" in df.columns:
        stamp = F.trim(F.col("period"))
        number = F.when(stamp.rlike("^[0-9]{4}-[0-9]{2}"), F.substring(stamp, 1, 4).cast("int") * 12 + F.substring(stamp, 6, 2).cast("int"))
        months = df.select(by, number.alias("_m")).filter("_m IS NOT NULL").distinct().groupBy(by).agg((F.max("_m") - F.min("_m") + 1 - F.count(F.lit(1))).alias("_gaps"))
        facts = facts.join(months, by, "left")
        checks.append(("period_continuity", "MEDIUM", F.col("_gaps")))
    bad = [F.coalesce(n, F.lit(0)).cast("bigint") for *_, n in checks]
    rows = [F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), (n == 0).alias("passed"), n.alias("bad_rows"))
            for (name, severity, _), n in zip(checks, bad, strict=True)]
    report = facts.select(by, F.inline(F.array(*rows)))
    if row_no is None or not quantities:
        return report.withColumn("sample", F.lit(None).cast("string"))
    return report.join(samples(df, by, row_no, quantities), [by, "check_name"], "left").select(*report.columns, "sample")


def gate(report: DataFrame, by: list[str]) -> DataFrame:
    """Failures and warnings per file; any failed CRITICAL or HIGH check rejects it."""
    hard = ~F.col("passed") & F.col("severity").isin("CRITICAL", "HIGH")
    soft = ~F.col("passed") & F.col("severity").isin("MEDIUM", "LOW")
    return report.groupBy(*by).agg(
        F.count_if(hard).alias("failures"), F.count_if(soft).alias("warnings"), F.bool_or(hard).alias("rejected"))


def _broken(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rows that break a rule."""
    return df.filter(reduce(Column.__or__, (F.coalesce(cond, F.lit(False)) for _, cond in rules)))


def _names(rules: list[tuple[str, Column]]) -> Column:
    """One row per rule: its name where it is broken, else NULL."""
    return F.explode(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


# ---- uploads ------------------------------------------------------------
def flagged(df: DataFrame, ids: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per row and broken rule.

    Sound rows are dropped first and the rules stay plain conditions, which Spark compiles.
    """
    hits, problem = _broken(df, rules), "problem"
    return hits.select(*ids, _names(rules).alias(problem)).filter(F.col(problem).isNotNull())


#: Rows of one key that are put side by side; keys of more rows are joined to the rows.
ROWS_OF_KEY = 1_000
_MISSING = "__NONE__"


def _later_rows(rows: DataFrame, file_col: str, row_col: str, keys: list[str]) -> DataFrame:
    """(file, row) of the rows after the first of their key. Rows dealt out by a key part are not moved."""
    groups = rows.groupBy(file_col, *keys).agg(
        F.min(row_col).alias("_first"), F.max(row_col).alias("_last"), F.count(row_col).alias("_n"))
    again = materialize(groups.filter("_last > _first"), "repeated-keys")
    later = again.filter("_n = 2").select(file_col, F.col("_last").alias(row_col))
    hot = again.filter(F.col("_n") > ROWS_OF_KEY).select(F.col(file_col).alias("_file"), "_first", *[F.col(k).alias(f"_{k}") for k in keys])
    most, longest = again.agg(F.max("_n"), F.count_if(F.col("_n") > ROWS_OF_KEY)).first()
    if (most or 0) <= 2:
        return later
    rest = rows
    if longest:
        # Sent to every task if they are few, else joined by a shuffle.
        hot = F.broadcast(hot) if longest <= FEW else hot.hint("merge")
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(file_col) == F.col("_file"))
        later = later.unionByName(rows.join(hot, same).filter(F.col(row_col) > F.col("_first")).select(file_col, row_col))
        rest = rows.join(hot, same, "left_anti")
    listed = rest.groupBy(file_col, *keys).agg(F.min(row_col).alias("_first"), F.collect_list(row_col).alias("_rows")).filter("size(_rows) > 2")
    return later.unionByName(listed.select(file_col, F.explode(F.filter("_rows", lambda r: r > F.col("_first"))).alias(row_col)))


def repeated_keys(df: DataFrame, file_col: str, row_col: str, keys: list[str]) -> DataFrame:
    """Rows after the first of their key in a file; a missing key part counts as one value.

    The first row is found by aggregation, so a key that fills a file is not
    gathered in one task. The later row of a key with two rows is its last one; only if
    there are keys with more rows are these listed, up to ``ROWS_OF_KEY`` a key, and those of
    longer keys joined to the rows again.

    A part may be missing as NULL, as an empty text or by name. Texts are grouped as they are, so
    that rows dealt out by one stay where they are; only if a part is missing in two ways are the
    rows that lack a part brought to one form and grouped apart.
    """
    kinds = dict(df.dtypes)

    def one_form(k: str) -> Column:
        return F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(_MISSING)).alias(k)

    # Days and whole numbers are as different as their texts are. A missing file name is no file: its rows meet in no key.
    plain = [F.col(k) if kinds[k] in ("string", "date", "bigint", "int") else one_form(k) for k in keys]
    rows = df.filter(F.col(file_col).isNotNull()).select(file_col, row_col, *plain)
    texts = [k for k in keys if kinds[k] == "string"]
    parts = [rows]
    if texts:
        ways = [[F.col(k).isNull(), F.col(k) == "", F.col(k) == _MISSING] for k in texts]
        met = rows.agg(*[F.bool_or(F.coalesce(way, F.lit(False))) for of_one in ways for way in of_one]).first()
        if any(sum(bool(x) for x in met[3 * i:3 * i + 3]) > 1 for i in range(len(texts))):
            lacks = reduce(Column.__or__, [F.coalesce(F.col(k), F.lit("")).isin("", _MISSING) for k in texts])
            parts = [rows.filter(~lacks), rows.filter(lacks).withColumns({k: one_form(k) for k in texts})]
    later = reduce(DataFrame.unionByName, [_later_rows(part, file_col, row_col, keys) for part in parts])
    return later.withColumn("problem", F.lit("duplicate business key"))
