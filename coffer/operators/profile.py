"""Rollups, key inventories, sign profiles and drift warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROPERTIES = ["account_key", "account_type", "currency", "merchant", "category"]
# The sign check's least samples and threshold, and the nearest keys' bounds.
LEAST_HISTORY, LEAST_INCOMING, SIGN_SHIFT = 20, 5, 0.40
MOST_EDITS, MOST_SUGGESTIONS = 3, 3


def transactions_view(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    return transactions.join(accounts.select("account_key", "account_type"), "account_key", "left")


def _money(c: str):
    return F.coalesce(F.sum(F.col(c).cast("decimal(38,2)")), F.lit(0)).cast("double")


def account_rollup(view: DataFrame) -> DataFrame:
    return view.groupBy("account_key", "account_type", "currency").agg(F.min("posted_at").alias("first_posted_at"), F.max("posted_at").alias("last_posted_at"), F.count("*").alias("txn_count"), _money("amount").alias("net_amount"))


def account_summary(view: DataFrame) -> DataFrame:
    typed = F.count_distinct(F.when(F.trim("account_type") != "", F.col("account_key")))
    s = view.agg(F.count_distinct("account_key").alias("account_count"), F.count("*").alias("transaction_count"), F.count_distinct("currency").alias("currency_count"), typed.alias("typed_account_count"), F.min("posted_at").alias("earliest"), F.max("posted_at").alias("latest"), _money("amount").alias("net_amount"))
    return s.withColumn("untyped_account_count", F.col("account_count") - F.col("typed_account_count"))


def data_range(view: DataFrame) -> DataFrame:
    return view.agg(F.min("posted_at").alias("earliest"), F.max("posted_at").alias("latest"))


def _stacked(view: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in PROPERTIES])
    return view.select(F.explode(pairs).alias("p")).select("p.*")


def key_inventory(view: DataFrame) -> DataFrame:
    """(property, value, count) of values that are not blank, for all properties in one pass."""
    return _stacked(view).where("trim(value) <> ''").groupBy("property", "value").agg(F.count("*").alias("count"))


def key_counts(view: DataFrame) -> DataFrame:
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    return _stacked(view).groupBy("property").agg(F.count_if(blank).alias("null_count"), F.count("*").alias("total_count"), F.count_distinct(F.when(~blank, F.col("value"))).alias("unique_count"))


def sign_profiles(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("account_key").agg(F.count_if(F.col("amount") < 0).alias("negative_count"), F.count_if(F.col("amount") > 0).alias("positive_count"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("negative_count") + F.col("positive_count")), F.lit(0.0))
    return n.select("*", share("negative_count").alias("negative_ratio"), share("positive_count").alias("positive_ratio"))


def unseen_values(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Values of incoming rows that a property's history lacks; a property without history is not checked."""
    skip = F.col("property") != "account_type"
    new = _stacked(incoming).where(skip & (F.trim("value") != "")).distinct()
    old = _stacked(history).where(skip & (F.trim("value") != "")).distinct()
    return new.join(old.select("property").distinct(), "property", "left_semi").join(old, ["property", "value"], "left_anti")


def nearest_keys(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """(value, suggestions): up to three known account keys within three edits of each unseen one.

    Two keys within three edits share one of four consecutive quarters of the shorter key's length
    class, give or take the shift of three, so an equi-join on (piece, place) meets all of them."""
    unseen = unseen_values(incoming, history).where("property = 'account_key'").select("value")
    known = history.where("trim(account_key) <> ''").select(F.col("account_key").alias("known")).distinct()
    piece = lambda c: F.expr(f"transform(sequence(0, 3), k -> struct(k as k, length({c}) as n, substring({c}, int(floor(k * length({c}) / 4)) + 1, int(floor((k + 1) * length({c}) / 4)) - int(floor(k * length({c}) / 4))) as s))")
    known = known.withColumn("low", F.lower("known")).withColumn("p", F.explode(piece("low"))).select("known", "low", "p.k", "p.n", "p.s")
    shifts = F.expr("""flatten(transform(sequence(greatest(0, length(vlow) - 3), length(vlow) + 3), n -> flatten(transform(sequence(0, 3), k -> transform(sequence(-3, 3), d ->
        struct(k as k, n as n, case when int(floor(k * n / 4)) + 1 + d >= 1 then substring(vlow, int(floor(k * n / 4)) + 1 + d, int(floor((k + 1) * n / 4)) - int(floor(k * n / 4)))
        when int(floor((k + 1) * n / 4)) = int(floor(k * n / 4)) then '' end as s))))))""")
    mine = unseen.withColumn("vlow", F.lower("value")).withColumn("p", F.explode(F.array_distinct(shifts))).select("value", "vlow", "p.k", "p.n", "p.s").where("s is not null")
    near = mine.join(known, ["k", "n", "s"]).select("value", "vlow", "known", "low").distinct().withColumn("d", F.levenshtein("vlow", "low")).where(F.col("d") <= MOST_EDITS)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy("d", "known"))).where(F.col("r") <= MOST_SUGGESTIONS)
    return top.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "known"))), lambda x: x["known"]).alias("suggestions"))


def sign_anomalies(incoming: DataFrame, history: DataFrame) -> DataFrame:
    total = F.col("negative_count") + F.col("positive_count")
    pick = lambda df, least, name: sign_profiles(df).where(total >= least).select("account_key", F.col("negative_ratio").alias(name))
    both = pick(history, LEAST_HISTORY, "historical_ratio").join(pick(incoming, LEAST_INCOMING, "incoming_ratio"), "account_key")
    return both.withColumn("shift", F.abs(F.col("historical_ratio") - F.col("incoming_ratio"))).where(F.col("shift") >= SIGN_SHIFT)


def drift_warnings(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """code, severity, property, incoming_value, message, suggestions of all warnings."""
    none = F.expr("cast(array() as array<string>)")
    value = F.concat(F.lit("`"), F.col("incoming_value"), F.lit("`"))
    percent = lambda c: F.format_string("%.2f", F.col(c) * 100)

    def warnings(df: DataFrame, code, severity, prop, message, suggestions) -> DataFrame:
        return df.select(code.alias("code"), severity.alias("severity"), prop.alias("property"), "incoming_value", message.alias("message"), suggestions.alias("suggestions"))

    unseen = unseen_values(incoming, history).withColumnRenamed("value", "incoming_value")
    severity = F.when(F.col("property") == "account_key", "high").otherwise("medium")
    new = warnings(unseen, F.concat("property", F.lit("_unseen")), severity, F.col("property"), F.concat(F.lit("The ledger has no "), F.col("property"), F.lit(" "), value, F.lit(" yet.")), none)
    near = nearest_keys(incoming, history).withColumnRenamed("value", "incoming_value")
    typo = warnings(near, F.lit("account_key_possible_typo"), F.lit("high"), F.lit("account_key"), F.concat(F.lit("The account_key "), value, F.lit(" is close to one that the ledger has.")), F.col("suggestions"))
    shifted = sign_anomalies(incoming, history).withColumnRenamed("account_key", "incoming_value")
    text = F.concat(F.lit("The share of negative amounts of "), value, F.lit(" moves by "), percent("shift"), F.lit(" points, from "), percent("historical_ratio"), F.lit(" to "), percent("incoming_ratio"), F.lit(" percent."))
    signs = warnings(shifted, F.lit("account_sign_profile_anomaly"), F.lit("high"), F.lit("account_key"), text, none)
    return new.unionByName(typo).unionByName(signs)


def order_warnings(df: DataFrame) -> DataFrame:
    return df.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "property", "incoming_value", "code")


def import_accounts(stats: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per import its accounts with their types and counters, in order of their keys."""
    each = stats.join(accounts.select("account_key", "account_type"), "account_key", "left")
    row = F.struct("account_key", "account_type", "rows_read", "inserted", "deduped")
    return each.groupBy("import_id").agg(F.array_sort(F.collect_list(row)).alias("accounts"))
