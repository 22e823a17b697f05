"""Rule sets of the motorsport layers, for :func:`lakeloom.operators.rules.report` and ``validate``; an empty frame breaks none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import duplicate_keys
from .rules import Rule, report

#: The categories of a result and the tyre compounds.
STATUS_CATEGORIES = ("FINISHED", "DISQUALIFIED", "DID_NOT_START", "RETIRED_MECHANICAL", "RETIRED_ACCIDENT", "OTHER")
COMPOUNDS = ("SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET", "UNKNOWN", "")


def _unless_null(column: str, condition: Column) -> Column:
    return F.col(column).isNull() | condition


def key_rules(df: DataFrame, keys: Sequence[str]) -> list[Rule]:
    """[Q4] A warning for each key that is null or empty; keys that ``df`` lacks are passed over."""
    return [Rule(f"{k} given", F.col(k).isNotNull() & (F.col(k).cast("string") != ""), "warn") for k in keys if k in df.columns]


def result_rules(df: DataFrame) -> list[Rule]:
    """[Q5] Race results: keys present, points 0 to 26, known categories; fastest laps outside 60 to 300 seconds warn."""
    rules = [Rule(f"{k} present", F.col(k).isNotNull(), "fail") for k in ("driver_id", "season", "round")]
    some = {
        "points": Rule("points 0 to 26", _unless_null("points", F.col("points").between(0, 26)), "fail"),
        "fastest_lap_seconds": Rule("fastest lap 60 to 300 s", _unless_null("fastest_lap_seconds", F.col("fastest_lap_seconds").between(60, 300)), "warn"),
        "status_category": Rule("category known", _unless_null("status_category", F.col("status_category").isin(*STATUS_CATEGORIES)), "fail"),
    }
    return rules + [rule for c, rule in some.items() if c in df.columns]


def lap_rules(df: DataFrame) -> list[Rule]:
    """[Q6] Laps: keys present; durations of laps that don't leave the pit outside 50 to 300 seconds, and unknown compounds, warn."""
    rules = [Rule(f"{k} present", F.col(k).isNotNull(), "fail") for k in ("session_key", "driver_number", "lap_number") if k in df.columns]
    if "lap_duration_seconds" in df.columns:
        timed = F.coalesce(F.col("is_pit_out_lap"), F.lit(True)) | F.col("lap_duration_seconds").between(50, 300)
        rules.append(Rule("lap outside the pit 50 to 300 s", _unless_null("lap_duration_seconds", timed), "warn"))
    if "compound" in df.columns:
        rules.append(Rule("compound known", _unless_null("compound", F.col("compound").isin(*COMPOUNDS)), "warn"))
    return rules


def standings_rules(df: DataFrame) -> list[Rule]:
    """[Q7] Standings: positions from 1 to 25."""
    if "current_position" not in df.columns:
        return []
    return [Rule("position 1 to 25", _unless_null("current_position", F.col("current_position").between(1, 25)), "fail")]


def standings_key(df: DataFrame) -> list[str]:
    """[Q7] What has to be unique: the season with the driver, else with the constructor."""
    return ["season", "driver_id" if "driver_id" in df.columns else "constructor_id"]


def report_with_key(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """[Q7, Q9] The report, and a line for the keys met more than once."""
    repeated = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("broken"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    line = rows.join(repeated).select(F.lit(f"one row for each {', '.join(key)}").alias("rule"), F.lit("fail").alias("severity"), "rows", "broken", (F.col("broken") == 0).alias("passed"))  # one row each
    return report(df, rules).unionByName(line) if rules else line
