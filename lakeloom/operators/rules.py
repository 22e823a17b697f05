"""Data quality: rules over rows, reports in one aggregation, policies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .rows import duplicate_keys


@dataclass(frozen=True)
class Rule:
    """A condition that rows should meet; null counts as broken. Severity: warn, drop or fail."""

    name: str
    condition: Column
    severity: str = "warn"
    mostly: float = 1.0  # share of rows that must meet it


@dataclass
class Result:
    """[Q8]"""

    passed: bool
    row_count: int
    failures: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def require(self) -> Result:
        if not self.passed:
            raise ValueError("; ".join(self.failures))
        return self


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def expect(df: DataFrame, rules: Sequence[Rule], observation: Observation | str | None = None) -> DataFrame:
    """[Q1, Q2, Q3, M11] Rows after the rules: ``drop`` rows go, ``fail`` rows stop the job, ``warn`` rows stay.

    Counts of broken rules are observed on the way, without a job of their own: into an ``Observation`` in a batch, under a name
    in a stream, where a listener gets them for each micro-batch.
    """
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(~holds(r.condition)).alias(r.name) for r in rules])
    for r in rules:
        if r.severity == "drop":
            df = df.filter(holds(r.condition))
        elif r.severity == "fail":
            df = df.filter(F.when(holds(r.condition), True).otherwise(F.raise_error(F.lit(f"expectation failed: {r.name}")).cast("boolean")))
    return df


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """[Q4, Q5, Q6, Q9, Q10, Q11] (rule, severity, rows, broken, passed), one row a rule, from one pass over ``df``."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~holds(r.condition)).alias(f"r{i}") for i, r in enumerate(rules)])
    lines = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col("rows"), F.col(f"r{i}").alias("broken"), F.lit(r.mostly).alias("mostly")) for i, r in enumerate(rules)]
    return counts.select(F.explode(F.array(*lines)).alias("x")).select(
        "x.rule", "x.severity", "x.rows", "x.broken", (F.col("x.broken") <= F.col("x.rows") * (1 - F.col("x.mostly")) + 1e-9).alias("passed")
    )


def validate(df: DataFrame, rules: Sequence[Rule], unique: Sequence[str] = (), empty_is_error: bool = False) -> Result:
    """[Q4-Q9] The outcome as an object; broken ``warn`` rules only warn."""
    rows = report(df, rules).collect()  # one row a rule
    total = rows[0]["rows"] if rows else df.count()
    text = lambda r: f"{r['rule']}: {r['broken']} of {r['rows']} rows"
    failures = [text(r) for r in rows if not r["passed"] and r["severity"] != "warn"]
    warnings = [text(r) for r in rows if not r["passed"] and r["severity"] == "warn"]
    if total == 0 and empty_is_error:
        failures.append("no rows")
    if unique and (n := duplicate_keys(df, unique).count()):
        failures.append(f"{n} keys met more than once")
    return Result(not failures, total, failures, warnings)


def uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """[Q9, Q10] (rows, distinct_keys, unique_share): 1 on an empty table."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys")).withColumn(
        "unique_share", F.when(F.col("rows") > 0, F.col("distinct_keys") / F.col("rows")).otherwise(1.0)
    )


def freshness(df: DataFrame, loaded_at: str, now: Column, warn_hours: float = 12, error_hours: float = 24) -> DataFrame:
    """[Q12] One row: hours since the last load, and pass, warn or error (never loaded: error)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max(F.col(loaded_at).cast("timestamp")))) / 3600.0
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return df.agg(age.alias("age_hours")).withColumn("status", status)


def row_loss(before: DataFrame, after: DataFrame, limit: float = 0.001) -> DataFrame:
    """[Q13] One row: counts of two layers, the share lost, and whether it is below the limit."""
    a, b = before.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("after"))
    lost = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0)
    return a.join(b).withColumn("loss", lost).withColumn("passed", F.col("loss") < limit)


def reconcile(fact: DataFrame, mart: DataFrame, fact_total: Column, mart_total: Column, tolerance: float = 1.0) -> DataFrame:
    """[A28] One row: two totals, their distance, and whether it is below the tolerance."""
    both = fact.agg(fact_total.alias("fact_total")).join(mart.agg(mart_total.alias("mart_total")))
    return both.withColumn("distance", F.abs(F.col("fact_total") - F.col("mart_total"))).withColumn("passed", F.col("distance") < tolerance)


def coverage(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """[Q15] (column, distinct_values, expected, passed)."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values"), F.lit(n).cast("long").alias("expected")) for c, n in columns.items()]
    return counts.select(F.explode(F.array(*lines)).alias("x")).select("x.*").withColumn("passed", F.col("distinct_values") == F.col("expected"))


def history_report(history: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """[Q14] One row: keys without exactly one open row, and rows that don't begin before they end."""
    per_key = history.groupBy(*keys).agg(F.count_if(F.col(end).isNull()).alias("open"), F.count_if(F.col(start) >= F.col(end)).alias("reversed"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("open") != 1).alias("not_one_open"), F.coalesce(F.sum("reversed"), F.lit(0)).alias("reversed"))


def integrity_report(history: DataFrame, keys: Sequence[str], row_id: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """[Q14] One row: versions; keys without exactly one open version; versions that don't begin before they end, or begin before an earlier one of the key has ended; ids met more than once."""
    before = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).asc_nulls_last(), F.col(row_id)).rowsBetween(Window.unboundedPreceding, -1)
    overlap = F.coalesce(F.max(F.col(end).isNull()).over(before), F.lit(False)) | F.coalesce(F.col(start) < F.max(end).over(before), F.lit(False))
    rows = history.withColumn("_overlap", overlap)
    per_key = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(end).isNull()).alias("open"), F.count_if(F.col(start) >= F.col(end)).alias("reversed"), F.count_if("_overlap").alias("overlapping")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    report = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count_if(F.col("open") != 1).alias("not_one_open"), total("reversed"), total("overlapping"))
    ids = duplicate_keys(history, [row_id]).agg(F.count(F.lit(1)).alias("repeated_ids"))
    passed = (F.col("not_one_open") + F.col("reversed") + F.col("overlapping") + F.col("repeated_ids")) == 0
    return report.join(ids).withColumn("passed", passed)  # one row each


def table_stats(df: DataFrame, name: str) -> DataFrame:
    """[Q16, A27] One row for the audit: table, rows, columns."""
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def run_datasets(datasets: dict[str, Callable[[], Result]], policy: str = "skip") -> dict[str, list[str]]:
    """[C19] Names loaded and skipped; with 'fail-fast' the first failure is raised."""
    out: dict[str, list[str]] = {"loaded": [], "skipped": []}
    for name, check in datasets.items():
        result = check()
        if not result.passed and policy == "fail-fast":
            raise ValueError(f"{name}: {'; '.join(result.failures)}")
        out["loaded" if result.passed else "skipped"].append(name)
    return out
