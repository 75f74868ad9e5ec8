"""Data checks. Each returns the violations; `strict` raises on the first few of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check found violations; the message holds up to ten."""


def strict(violations: DataFrame, what: str) -> None:
    """Raises if there are violations, with ten samples."""
    if samples := violations.limit(10).collect():
        raise CheckFailed(f"{what}: {[r.asDict() for r in samples]}")


def first_k(df: DataFrame, keys: list[str], k: int = 50) -> DataFrame:
    """The first k distinct keys."""
    return df.select(*keys).distinct().orderBy(*keys).limit(k)


def check_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_null of the columns with nulls, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_null").where("n_null > 0")


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_allowed(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the allowed set, with their counts; null counts as outside."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_contiguous(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups whose numbers are not 1, 2, ... n."""
    found = df.groupBy(*keys).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("n_distinct"))
    return found.where("NOT (lo = 1 AND hi = n AND n = n_distinct)")


def check_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_bad of the columns with text that isn't a number."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "column_name", "n_bad").where("n_bad > 0")


def missing_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the child that the parent lacks."""
    return child.join(parent, key, "left_anti").select(key).distinct()


def check_row_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_in, n_out where they differ or either is 0."""
    one, two = a.agg(F.count(F.lit(1)).alias("n_in")), b.agg(F.count(F.lit(1)).alias("n_out"))
    return one.join(two, F.lit(True)).where("n_in != n_out OR n_in = 0")


def check_constant(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups in which the column has several values."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def check_exactly_one(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNull() == F.col(b).isNull())


def check_state_shape(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text is there but not of the shape."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def check_min_segment(lengths: DataFrame, n: int, length: Column | None = None) -> DataFrame:
    """Games with fewer than n used rows."""
    return lengths.where((F.col("used_length") if length is None else length) < n)


def missing_clock_report(moves: DataFrame, k: int = 50) -> DataFrame:
    """n_missing over all rows, beside each of the first k games with a null clock."""
    gaps = moves.where(F.col("clock").isNull())
    return first_k(gaps, ["game_id"], k).join(gaps.agg(F.count(F.lit(1)).alias("n_missing")), F.lit(True))


#: Samples of a check's violations, at most.
SAMPLES = 10


@dataclass
class Checks:
    """Checks of one table, fused: one aggregate for each distinct key, whatever the number of checks.

    `row` adds a check of single rows; all of them share one pass. `group` adds a check of groups by a
    key; those of one key share one aggregate. `report` gives a row for each check, in one plan.
    """

    table: DataFrame
    rows: list[tuple[str, Column, tuple[str, ...]]] = field(default_factory=list)
    groups: dict[tuple[str, ...], list[tuple[str, Column, Callable[[Column], Column]]]] = field(default_factory=dict)

    def row(self, what: str, bad: Column, *sample: str) -> Checks:
        """Rows where `bad` is true; null counts as false. sample: the columns that a message shows."""
        self.rows.append((what, bad, sample))
        return self

    def group(self, what: str, key: list[str], value: Column, bad: Callable[[Column], Column]) -> Checks:
        """Groups by the key whose aggregate `value` is bad."""
        self.groups.setdefault(tuple(key), []).append((what, value, bad))
        return self

    def nulls(self, what: str, *columns: str) -> Checks:
        return self.row(what, reduce(Column.__or__, [F.col(c).isNull() for c in columns]), *columns)

    def numeric(self, what: str, *columns: str) -> Checks:
        return self.row(what, reduce(Column.__or__, [F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in columns]), *columns)

    def allowed(self, what: str, column: str, values: list) -> Checks:
        return self.row(what, ~F.coalesce(F.col(column).isin(*values), F.lit(False)), column)

    def unique(self, what: str, *key: str) -> Checks:
        return self.group(what, list(key), F.count(F.lit(1)), lambda n: n > 1)

    def constant(self, what: str, key: list[str], column: str) -> Checks:
        """Groups whose column has several values, by its least and greatest one; nulls do not count."""
        return self.group(what, key, F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")), lambda v: v["lo"] != v["hi"])

    def contiguous(self, what: str, key: list[str], order: str) -> Checks:
        """Groups whose numbers do not run from 1 to their count; a group in which that holds beside a doubled number is for `unique`."""
        value = F.struct(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("n"))
        return self.group(what, key, value, lambda v: ~F.coalesce((v["lo"] == 1) & (v["hi"] == v["n"]), F.lit(False)))

    def report(self) -> DataFrame:
        """what, n, samples: how many violations each check has, and up to ten of them as JSON."""
        out = [told(self.table, [(what, bad, F.struct(*sample)) for what, bad, sample in self.rows])] if self.rows else []
        for key, checks in self.groups.items():
            grouped = self.table.groupBy(*key).agg(*[value.alias(f"__{k}") for k, (_, value, _) in enumerate(checks)])
            out.append(told(grouped, [(what, bad(F.col(f"__{k}")), F.struct(*key, F.col(f"__{k}").alias("value"))) for k, (what, _, bad) in enumerate(checks)]))
        return reduce(DataFrame.union, out)


def sampled(bad: Column, sample: Column) -> Column:
    """Up to SAMPLES violations as JSON: the least of each of as many hashed classes, which partial aggregates merge."""
    text = F.to_json(sample)
    place = F.pmod(F.xxhash64(text), F.lit(SAMPLES))
    return F.array_compact(F.array(*[F.min(F.when(bad & (place == k), text)) for k in range(SAMPLES)]))


def told(rows: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """what, n, samples of checks (what, bad, sample), by one aggregate over all rows."""
    found = [F.struct(F.lit(what).alias("what"), F.count_if(bad).alias("n"), sampled(bad, sample).alias("samples")) for what, bad, sample in checks]
    return rows.agg(F.array(*found).alias("found")).select(F.inline("found"))


def strict_all(*reports: DataFrame) -> None:
    """Raises if any check of the reports has violations, in one job, and names each with its samples."""
    found = reduce(DataFrame.union, reports).where("n > 0").collect()
    if found:
        raise CheckFailed("; ".join(f"{r['what']}: {r['n']}, such as {', '.join(r['samples'])}" for r in found))
