"""Aggregates beside the compiled metrics: survey summary, counts, parity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parity tolerances (counts exact, money to the cent, rates to 1e-4), sample size.
TOLERANCES = {
    "call_volume": 0.0,
    "average_mortgage_note_rate": 0.0001,
    "banking_available_balance": 0.01,
    "credit_card_outstanding": 0.01,
    "first_contact_resolution_rate": 0.0001,
}
SAMPLE_COMMENTS = 5
COUNT_COLUMNS_MAX = 3


def survey_filter(min_score: int | None = None, max_score: int | None = None,
                  category: str | None = None, start_date: str | None = None,
                  end_date: str | None = None) -> Column:
    """Scores inclusive, dates half-open on the survey's own day."""
    keep = F.lit(True)
    if min_score is not None:
        keep &= F.col("score") >= min_score
    if max_score is not None:
        keep &= F.col("score") <= max_score
    if category:
        keep &= F.col("category_code") == category
    days = {}
    for name, value in (("start_date", start_date), ("end_date", end_date)):
        if value:
            try:
                days[name] = date.fromisoformat(str(value))
            except ValueError:
                raise ValueError(f"{name} must be YYYY-MM-DD, got {value!r}") from None
    if len(days) == 2 and days["end_date"] <= days["start_date"]:
        raise ValueError("end_date must be after start_date")
    if "start_date" in days:
        keep &= F.col("surveyed_at") >= F.lit(days["start_date"])
    if "end_date" in days:
        keep &= F.col("surveyed_at") < F.lit(days["end_date"])
    return keep


def survey_summary(surveys: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row: responses, mean, how many gave each score, and the first comments by survey id.

    The first comments are a bounded aggregate: each task keeps only the five lowest ids.
    """
    chosen = surveys if keep is None else surveys.filter(keep)
    totals = chosen.agg(
        F.count("*").alias("responses"), F.avg("score").alias("average_score"),
        *(F.count_if(F.col("score") == s).alias(f"score_{s}") for s in range(1, 6)))
    first = chosen.select("survey_id", "comment").orderBy("survey_id").limit(SAMPLE_COMMENTS)
    comments = first.filter(F.length("comment") > 0).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("survey_id", "comment"))),
                                 lambda r: r["comment"]), " | ").alias("comments"))
    return totals.join(comments)  # one row beside one row


def count_by(df: DataFrame, *columns: str, keep: Column | None = None) -> DataFrame:
    if not 1 <= len(columns) <= COUNT_COLUMNS_MAX or set(columns) - set(df.columns):
        raise ValueError(f"count_by takes 1 to {COUNT_COLUMNS_MAX} columns of {df.columns}")
    chosen = df if keep is None else df.filter(keep)
    return chosen.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns)


def parity(values: DataFrame, targets: list[str], tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """metric, max_diff, ok, note from (target, metric, value) rows.

    A metric passes when every target has a number and the spread is within tolerance.
    """
    numbers = F.col("value").isNotNull() & ~F.isnan("value")
    wanted = F.array(*map(F.lit, targets))
    limits = F.create_map(*(F.lit(x) for kv in tolerances.items() for x in kv))
    seen = values.groupBy("metric").agg(
        F.collect_set(F.when(numbers, F.col("target"))).alias("have"),
        (F.max(F.when(numbers, F.col("value"))) - F.min(F.when(numbers, F.col("value")))).alias("spread"),
    )
    missing = F.array_sort(F.array_except(wanted, F.col("have")))
    note = (F.when(F.size(missing) > 0, F.concat(F.lit("missing targets: "), F.array_join(missing, ", ")))
            .when(F.size("have") < 2, F.lit("fewer than 2 targets returned numbers")))
    limit = F.coalesce(F.try_element_at(limits, F.col("metric")), F.lit(0.0))
    return seen.select(
        "metric", F.when(note.isNull(), F.col("spread")).alias("max_diff"),
        (note.isNull() & (F.col("spread") <= limit)).alias("ok"), note.alias("note"))
