"""Recurring payments (recurring/v1) and unusually large amounts (anomalies/v1).

Input: txn_id, account_key, posted_at, amount, currency, merchant, description. Both group by account,
currency, sign and counterparty.

No group's rows are ever gathered. Rows are first counted by group, day and amount, or by group and amount, with a
map-side combine. A group has no more days than its history is long, so the gaps between them are a window over a bounded
number of rows; medians come from running counts over a group's distinct amounts, which a sort may spill. Only the spike
rows of a group are read from the ledger again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.errors import CofferError
from coffer.functions.text import counterparty, round_to, sign_key, trimmed

GROUP = ["account_key", "currency", "sign", "counterparty"]


@dataclass(frozen=True)
class Cadence:
    name: str
    least_rows: int
    tolerance: int
    priority: int
    active_days: int
    gap: int | None  # None: one calendar month


# The policy of both detectors.
CADENCES = [Cadence("weekly", 4, 1, 1, 14, 7), Cadence("biweekly", 4, 2, 2, 28, 14), Cadence("monthly", 3, 3, 3, 62, None)]
LEAST_FIT, LEAST_SCORE = 0.75, 0.78
WEIGHTS = (0.65, 0.25, 0.10)
AMOUNT_SHARE, AMOUNT_FLOOR = 0.15, 1.0
SPIKE_ROWS, SPIKE_FLOOR, SPIKE_SHARE, SPIKE_MADS, SPIKE_RATIO, SPIKE_SCORE = 6, 15.0, 0.45, 3.0, 2.2, 0.82
HIGH, MEDIUM = 0.92, 0.86


def grouped(transactions: DataFrame, *more: str) -> DataFrame:
    """Nonzero, dated rows with their counterparty and sign, and the columns ``more``. Rows that have them stay as they are."""
    if "counterparty" in transactions.columns:
        return transactions
    t = transactions.where("amount <> 0 and posted_at is not null")
    t = t.select(*more, "txn_id", trimmed("account_key").alias("account_key"), "posted_at", "amount", F.upper(trimmed("currency")).alias("currency"), trimmed("merchant").alias("merchant"), trimmed("description").alias("description"))
    t = t.withColumn("who", counterparty("merchant", "description")).where("who is not null")
    return t.select("*", sign_key("amount").alias("sign"), F.col("who.key").alias("counterparty")).drop("merchant")


def bucket(buckets: int, name: str = "counterparty") -> Column:
    """Which of ``buckets`` a group belongs to; both signs of a counterparty share one. The detectors call the counterparty merchant."""
    return F.pmod(F.xxhash64("account_key", "currency", name), F.lit(buckets)).cast("int")


def group_key() -> Column:
    return F.concat_ws("|", *GROUP)


def _error(c: Cadence) -> Column:
    gap = F.datediff("posted_at", "prev") if c.gap else F.datediff("posted_at", F.add_months("prev", 1))
    return F.abs(F.abs(gap) - c.gap) if c.gap else F.abs(gap)


def _by_day(rows: DataFrame, *more: Column) -> DataFrame:
    """The days of each group with the day before (prev) and further aggregates."""
    days = rows.groupBy(*GROUP, "posted_at").agg(F.min("txn_id").alias("first_txn"), *more)
    return days.withColumn("prev", F.lag("posted_at").over(Window.partitionBy(*GROUP).orderBy("posted_at")))


def interval_errors(rows: DataFrame) -> DataFrame:
    """Each row after a group's first with its distance in days from each cadence. Rows of a day follow each other by txn_id, so
    only its first one looks back at another day."""
    t = rows.join(_by_day(rows), [*GROUP, "posted_at"]).withColumn("prev", F.when(F.col("txn_id") == F.col("first_txn"), F.col("prev")).otherwise(F.col("posted_at")))
    return t.select("*", *[_error(c).alias(f"err_{c.name}") for c in CADENCES]).drop("first_txn")


def cells(rows: DataFrame) -> DataFrame:
    """Rows counted by group, day and amount, with the first row's identity and the first description."""
    first = F.min_by(F.struct("txn_id", "who.source", "who.quality", "who.eligible"), "txn_id").alias("first")
    return rows.groupBy(*GROUP, "posted_at", "amount").agg(F.count("*").alias("c"), first, F.min("description").alias("description"))


def counted_median(counts: DataFrame, value: str, name: str) -> DataFrame:
    """``counts`` (group, value, c) with the exact median of the counted values of each group: the mean of the middle two."""
    group = Window.partitionBy(*GROUP)
    t = counts.withColumns({"__upto": F.sum("c").over(group.orderBy(value)), "__n": F.sum("c").over(group)})
    low = F.min(F.when(2 * F.col("__upto") >= F.col("__n"), F.col(value))).over(group)
    high = F.min(F.when(F.col("__upto") >= F.floor(F.col("__n") / 2) + 1, F.col(value))).over(group)
    return t.withColumns({name: (low + high) / 2, "n": F.col("__n")}).drop("__upto", "__n")


def _abs_counts(rows: DataFrame, count: Column) -> DataFrame:
    return rows.groupBy(*GROUP, F.abs("amount").alias("value")).agg(count.alias("c"))


def _amount_stats(counts: DataFrame) -> DataFrame:
    t = counted_median(counts, "value", "abs_median").withColumn("tolerance", F.greatest(AMOUNT_SHARE * F.col("abs_median"), F.lit(AMOUNT_FLOOR)))
    near = F.when(F.abs(F.col("value") - F.col("abs_median")) <= F.col("tolerance"), F.col("c")).otherwise(0)
    same = lambda c: F.first(c).alias(c)
    g = t.groupBy(*GROUP).agg(same("n"), same("abs_median"), same("tolerance"), F.sum(near).alias("near"), F.min("value").alias("least"), F.max("value").alias("most"))
    # All amounts of a group have its sign, so signed figures mirror the absolute ones.
    debit = F.col("sign") == "debit"
    signed = lambda a, b, name: F.when(debit, -F.col(a)).otherwise(F.col(b)).alias(name)
    return g.select(
        *GROUP, "n", "abs_median", signed("abs_median", "abs_median", "signed_median"), signed("most", "least", "amount_min"), signed("least", "most", "amount_max"), "tolerance",
        (F.col("near") / F.col("n")).alias("amount_fit"),
    )


def amount_stats(rows: DataFrame) -> DataFrame:
    """Per group: n, median of absolute amounts, tolerance, share within it, signed median, min, max."""
    return _amount_stats(_abs_counts(rows, F.count("*")))


def _candidates(counted: DataFrame) -> DataFrame:
    identity = F.min_by("first", "first.txn_id").alias("first")
    lead = F.min(F.struct("amount", "description")).alias("lead")
    days = counted.groupBy(*GROUP, "posted_at").agg(F.sum("c").alias("c"), identity, lead)
    days = days.withColumn("prev", F.lag("posted_at").over(Window.partitionBy(*GROUP).orderBy("posted_at")))
    # A day's first row looks back at the day before, its others at the day itself.
    looks = F.array(F.struct(F.col("prev").alias("prev"), F.when(F.col("prev").isNotNull(), 1).otherwise(0).cast("long").alias("w")), F.struct(F.col("posted_at").alias("prev"), (F.col("c") - 1).alias("w")))
    t = days.withColumn("x", F.explode(looks)).select(*GROUP, "posted_at", "first", "lead", F.col("x.prev").alias("prev"), F.col("x.w").alias("w"))
    t = t.select("*", *[_error(c).alias(f"err_{c.name}") for c in CADENCES])
    each = []
    for c in CADENCES:
        error = F.col(f"err_{c.name}")
        each.append(F.sum(F.when(error <= c.tolerance, F.col("w")).otherwise(0)).alias(f"in_{c.name}"))
        # A group has at most as many errors as days, so their counts stay small.
        each.append(F.floor(F.percentile(F.when(F.col("w") > 0, error), 0.5, F.greatest("w", F.lit(1)))).alias(f"med_{c.name}"))
    first = F.min_by("first", "posted_at").alias("who")
    sample = F.min_by("lead.description", F.struct("posted_at", "lead")).alias("sample_description")
    g = t.groupBy(*GROUP).agg((F.sum("w") + 1).alias("n"), F.min("posted_at").alias("first_seen_at"), F.max("posted_at").alias("last_seen_at"), first, sample, *each)
    g = g.where("n >= 3 and who.eligible")
    options = F.array(*[
        F.struct(
            F.lit(c.name).alias("cadence"), F.lit(c.least_rows).alias("least_rows"), F.lit(c.priority).alias("priority"), F.lit(2 * c.active_days).alias("active_days"),
            (F.col(f"in_{c.name}") / (F.col("n") - 1)).alias("cadence_fit"), F.col(f"med_{c.name}").alias("median_error"),
        ) for c in CADENCES
    ])
    g = g.select(*GROUP, "n", "first_seen_at", "last_seen_at", "who", "sample_description", F.explode(options).alias("o"))
    return g.select("*", "o.*").drop("o").where("n >= least_rows")


def cadence_candidates(rows: DataFrame) -> DataFrame:
    """Per group and cadence with enough rows: fit, integer median error, and the group's identity and bounds."""
    return _candidates(cells(rows))


def is_active(latest: Column) -> Column:
    """Whether a series was seen lately, as of the latest day of all grouped rows."""
    return (F.datediff(latest, "last_seen_at") <= F.col("active_days")).cast("long")


def recurring(transactions: DataFrame) -> DataFrame:
    """The detected series, with their evidence."""
    counted = cells(grouped(transactions))  # one exchange, which the three branches share
    latest = counted.agg(F.max("posted_at").alias("latest"))  # one row
    amounts = _amount_stats(_abs_counts(counted, F.sum("c"))).drop("n")
    c = _candidates(counted).where(F.col("cadence_fit") >= LEAST_FIT).join(amounts, GROUP).where(F.col("amount_fit") >= LEAST_FIT)
    c = c.withColumn("raw", WEIGHTS[0] * F.col("cadence_fit") + WEIGHTS[1] * F.col("amount_fit") + WEIGHTS[2] * F.col("who.quality")).where(F.col("raw") >= LEAST_SCORE)
    rank = F.struct("cadence_fit", -F.col("median_error"), "n", "priority")
    kept = ["raw", "cadence", "active_days", "cadence_fit", "amount_fit", "n", "first_seen_at", "last_seen_at", "who", "sample_description", "signed_median", "amount_min", "amount_max"]
    best = c.groupBy(*GROUP).agg(F.max_by(F.struct(*kept), rank).alias("b")).select(*GROUP, "b.*").crossJoin(F.broadcast(latest))
    due = F.when(F.col("cadence") == "weekly", F.date_add("last_seen_at", 7)).when(F.col("cadence") == "biweekly", F.date_add("last_seen_at", 14)).otherwise(F.add_months("last_seen_at", 1))
    return best.select(
        group_key().alias("group_key"), "account_key", F.col("counterparty").alias("merchant"), "cadence", round_to("signed_median", 2).alias("typical_amount"), "currency", "last_seen_at", due.alias("next_expected_at"),
        F.col("n").alias("occurrence_count"), round_to("raw", 4).alias("score"), is_active(F.col("latest")).alias("is_active"), "active_days",
        round_to("cadence_fit", 4).alias("cadence_fit"), round_to("amount_fit", 4).alias("amount_fit"), "amount_min", "amount_max", "first_seen_at", F.col("who.source").alias("source"), "sample_description",
    )


RECURRING_COLUMNS = ["group_key", "account_key", "merchant", "cadence", "typical_amount", "currency", "last_seen_at", "next_expected_at", "occurrence_count", "score", "is_active"]


def median_mad(rows: DataFrame) -> DataFrame:
    """Per group: n, median of absolute amounts, median absolute deviation from it."""
    t = counted_median(_abs_counts(rows, F.count("*")), "value", "med").withColumn("deviation", F.abs(F.col("value") - F.col("med")))
    t = counted_median(t, "deviation", "mad")
    same = lambda c: F.first(c).alias(c)
    return t.groupBy(*GROUP).agg(same("n"), same("med"), same("mad"))


def anomaly_scores(transactions: DataFrame) -> DataFrame:
    """Every row above its group's spike threshold, with score and severity, before the score gate."""
    rows = grouped(transactions)
    base = median_mad(rows).where((F.col("n") >= SPIKE_ROWS) & (F.col("med") > 2.220446049250313e-16))
    base = base.withColumn("tol", F.greatest(F.lit(SPIKE_FLOOR), SPIKE_SHARE * F.col("med"), SPIKE_MADS * F.col("mad")))
    t = rows.join(base, GROUP).withColumn("delta", F.abs("amount") - F.col("med")).withColumn("ratio", F.abs("amount") / F.col("med"))
    t = t.where((F.col("delta") > F.col("tol")) & (F.col("ratio") >= SPIKE_RATIO))
    raw = 0.6 * F.least(F.col("delta") / (2.5 * F.col("tol")), F.lit(1.0)) + 0.3 * F.least((F.col("ratio") - SPIKE_RATIO) / 2.0, F.lit(1.0)) + 0.1 * F.col("who.quality")
    t = t.withColumn("score", round_to(raw, 4))
    severity = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    reason = F.concat(F.lit("Amount is unusually high for this merchant ("), F.format_string("%.2f", round_to("ratio", 2)), F.lit("x typical)."))
    return t.select("txn_id", "account_key", "posted_at", F.col("counterparty").alias("merchant"), round_to("amount", 2).alias("amount"), "currency", F.lit("amount_spike").alias("reason_code"), reason.alias("reason"), "score", severity.alias("severity"))


def anomalies(transactions: DataFrame) -> DataFrame:
    return anomaly_scores(transactions).where(F.col("score") >= SPIKE_SCORE)


def between_dates(df: DataFrame, column: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows whose date lies in the inclusive bounds; bounds select results and never change detection."""
    bounds = []
    for text in (date_from, date_to):
        try:
            bounds.append(date.fromisoformat(text) if text and re.fullmatch(r"\d{4}-\d\d-\d\d", text, re.A) else None)
        except ValueError:
            bounds.append(None)
        if text is not None and bounds[-1] is None:
            raise CofferError("invalid_argument", f"{text!r} is not a date, YYYY-MM-DD.")
    if all(bounds) and bounds[0] > bounds[1]:
        raise CofferError("invalid_argument", "The first date must not be after the last.")
    for x, keep in zip(bounds, (F.col(column) >= F.lit(bounds[0]), F.col(column) <= F.lit(bounds[1])), strict=True):
        df = df.where(keep) if x else df
    return df


def order_recurring(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("next_expected_at").asc_nulls_last(), F.desc("score"), "merchant", "group_key")


def order_anomalies(df: DataFrame) -> DataFrame:
    return df.orderBy("posted_at", "merchant", "txn_id")
