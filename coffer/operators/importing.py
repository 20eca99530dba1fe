"""Validation and duplicate detection of an import, as sets.

Input rows: row (from 1) and the ten text fields, all nullable strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions.text import account_type, effective_scale, trimmed, valid_amount, valid_date

REQUIRED = ["account_key", "posted_at", "amount", "currency", "description"]
OPTIONAL = ["statement_id", "account_type", "external_id", "merchant", "category"]
FALLBACK = ["account_key", "posted_at", "amount", "currency", "description"]


def _issue(test: Column, field: str, code: str, text: str) -> Column:
    return F.when(test, F.struct(F.col("row"), F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(text).alias("description"), F.col(field).alias("received")))


def checked(raw: DataFrame) -> DataFrame:
    """Typed columns beside an array of issues, in field order."""
    t = raw.select("row", *[trimmed(c).alias(c) for c in REQUIRED + OPTIONAL])
    miss = lambda c: _issue(F.col(c).isNull(), c, "missing_required_field", f"{c} must be present and non-empty.")
    number = F.col("amount").rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") & (F.abs(F.col("amount").try_cast("double")) < float("inf"))
    issues = F.array_compact(F.array(
        miss("account_key"), _issue(F.col("account_type").isNotNull() & account_type("account_type", True).isNull(), "account_type", "invalid_account_type", "account_type is not recognized."),
        miss("posted_at"), _issue(F.col("posted_at").isNotNull() & valid_date("posted_at", True).isNull(), "posted_at", "invalid_date", "posted_at must be a real date, YYYY-MM-DD."),
        miss("amount"), _issue(F.col("amount").isNotNull() & ~F.coalesce(number, F.lit(False)), "amount", "invalid_number", "amount must be numeric."),
        _issue(number & (effective_scale("amount", True) > 2), "amount", "invalid_amount_scale", "amount must use at most 2 decimal places."),
        miss("currency"), miss("description"),
    ))
    return t.withColumn("issues", issues).withColumns({"posted_at": valid_date("posted_at", True), "amount": valid_amount("amount", True), "currency": F.upper("currency"), "account_type": account_type("account_type", True)})


def type_conflicts(clean: DataFrame) -> DataFrame:
    """Rows whose type differs from the first typed row of their account. The firsts are a map-side aggregate."""
    typed = clean.where("account_type is not null")
    first = typed.groupBy("account_key").agg(F.min_by("account_type", "row").alias("first_type"))
    return typed.join(first, "account_key").where("account_type <> first_type")


def ledger_type_conflicts(clean: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.where("trim(account_type) <> ''").select("account_key", F.col("account_type").alias("ledger_type"))
    return clean.where("account_type is not null").join(known, "account_key").where("account_type <> ledger_type")


def statement_reuse(clean: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose (account, statement) the ledger has, with the import of its smallest txn_id."""
    used = ledger.where("statement_id is not null").groupBy("account_key", "statement_id").agg(F.min_by("import_id", "txn_id").alias("used_by"))
    return clean.join(used, ["account_key", "statement_id"])


def validate(raw: DataFrame, import_id: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows with their dedupe scope, issues). Any issue fails an import as a whole."""
    return split_checked(checked(raw), import_id)


def split_checked(t: DataFrame, import_id: str) -> tuple[DataFrame, DataFrame]:
    """The same from checked rows."""
    clean = t.where(F.size("issues") == 0).drop("issues")
    bad = t.select(F.explode("issues").alias("i")).select("i.*")
    conflict = type_conflicts(clean).select("row", F.lit("account_type").alias("field"), F.lit("account_type_conflict_in_import").alias("code"), F.lit("account_type differs from an earlier row of the account.").alias("description"), F.col("account_type").alias("received"))
    scope = F.when(F.col("statement_id").isNotNull(), F.concat_ws("|", F.lit("stmt"), "account_key", "statement_id")).otherwise(F.concat_ws("|", F.lit("gen"), F.lit(import_id), "account_key"))
    return clean.withColumn("dedupe_scope_id", scope), bad.unionByName(conflict)


def dedupe_key() -> Column:
    ext = F.concat_ws("|", F.lit("ext"), "account_key", "external_id")
    return F.when(F.col("external_id").isNotNull(), ext).otherwise(F.concat_ws("|", F.lit("fallback"), *FALLBACK))


def batch_duplicates(rows: DataFrame) -> DataFrame:
    """rows with matched_row: the earlier row that this one repeats within the batch, or null.

    By external id every later row repeats the first. Without one, a row repeats the first row of its five
    fields if that has another scope. Firsts are aggregates, so a hot key is never sorted in one task."""
    ext = rows.where("external_id is not null")
    first = ext.groupBy("account_key", "external_id").agg(F.min("row").alias("first_row"))
    ext = ext.join(first, ["account_key", "external_id"]).withColumn("matched_row", F.when(F.col("row") > F.col("first_row"), F.col("first_row")))
    rest = rows.where("external_id is null")
    first = rest.groupBy(*FALLBACK).agg(F.min("row").alias("first_row"), F.min_by("dedupe_scope_id", "row").alias("first_scope"))
    rest = rest.join(first, FALLBACK).withColumn("matched_row", F.when(F.col("dedupe_scope_id") != F.col("first_scope"), F.col("first_row"))).drop("first_scope")
    return ext.unionByName(rest).drop("first_row")


def ledger_matches(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows with matched_txn_id and matched_import_id: the smallest ledger row each one repeats, or nulls.

    By (account, external id); without one, by the five fields in another scope, whatever the ledger row's external
    id. Per key the ledger gives its smallest row, and the smallest one outside that row's scope, so a key matches at most once."""
    at = F.struct("txn_id", "import_id")
    ext = ledger.where("external_id is not null").groupBy("account_key", "external_id").agg(F.min(at).alias("m"))
    by_ext = rows.where("external_id is not null").join(ext, ["account_key", "external_id"], "left")
    scope = ledger.groupBy(*FALLBACK, F.col("dedupe_scope_id").alias("scope")).agg(F.min(at).alias("m"))
    low = scope.groupBy(*FALLBACK).agg(F.min(F.struct(F.col("m"), F.col("scope"))).alias("one"))
    other = scope.join(low, FALLBACK).where("scope <> one.scope").groupBy(*FALLBACK).agg(F.min("m").alias("two"))
    keyed = low.join(other, FALLBACK, "left")
    pick = F.when(F.col("one.scope") != F.col("dedupe_scope_id"), F.col("one.m")).otherwise(F.col("two"))
    by_fields = rows.where("external_id is null").join(keyed, FALLBACK, "left").withColumn("m", pick).drop("one", "two")
    both = by_ext.unionByName(by_fields)
    return both.withColumns({"matched_txn_id": F.col("m.txn_id"), "matched_import_id": F.col("m.import_id")}).drop("m")


def account_counters(batch: DataFrame, new: DataFrame) -> DataFrame:
    """Per account of an import: rows read, inserted (those in ``new``) and deduped."""
    each = batch.select("row", "account_key").join(new.select("row", F.lit(1).alias("is_new")), "row", "left")
    per = each.groupBy("account_key").agg(F.count("*").alias("rows_read"), F.count("is_new").alias("inserted"))
    return per.withColumn("deduped", F.col("rows_read") - F.col("inserted"))


def upsert_accounts(accounts: DataFrame, clean: DataFrame, stamp: str) -> DataFrame:
    """The accounts after an import: its first type of an account counts where none was known, and touched ones get a new time."""
    new = clean.groupBy("account_key").agg(F.min_by("account_type", F.when(F.col("account_type").isNotNull(), F.col("row"))).alias("new_type"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = accounts.join(new.withColumn("touched", F.lit(True)), "account_key", "full_outer")
    return both.select(
        "account_key", F.coalesce(blank("account_type"), blank("new_type")).alias("account_type"), F.coalesce("created_at", F.lit(stamp)).alias("created_at"),
        F.when(F.col("touched"), F.lit(stamp)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def open_candidates(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Suppressed candidates of committed imports that no ledger row stands for yet."""
    return candidates.where("promoted_txn_id is null").join(runs.where("status = 'committed'").select("import_id"), "import_id", "left_semi")


def accounts_of(ledger: DataFrame, stamp: str) -> DataFrame:
    """An untyped account for each key that a history of transactions names."""
    keys = ledger.where("trim(account_key) <> ''").select("account_key").distinct()
    return keys.select("account_key", F.lit(None).cast("string").alias("account_type"), F.lit(stamp).alias("created_at"), F.lit(stamp).alias("updated_at"))


def history_stats(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counters per import and account from a history: its transactions were inserted, its candidates suppressed."""
    each = ledger.select("import_id", "account_key", F.lit(1).alias("i")).unionByName(candidates.select("import_id", "account_key", F.lit(0).alias("i")))
    per = each.groupBy("import_id", "account_key").agg(F.count("*").alias("rows_read"), F.sum("i").alias("inserted"))
    return per.withColumn("deduped", F.col("rows_read") - F.col("inserted"))


def promotions(removed: DataFrame, candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Suppressed candidates that take the place of removed rows: per key at most as many as were removed, in
    order of creation, row, reason and id, all of one scope that the remaining ledger allows. Keys with an external id
    go first, as a promoted row can bar a candidate without one."""
    quota = removed.groupBy(dedupe_key().alias("dedupe_key")).agg(F.count("*").alias("quota"))
    mine = candidates.where("promoted_txn_id is null").join(quota, "dedupe_key")
    order = [F.col("created_at").try_cast("long"), F.col("source_row_index"), F.col("dedupe_reason"), F.col("candidate_id")]
    rank = F.row_number().over(Window.partitionBy("dedupe_key").orderBy(*order))
    held = ledger.where("external_id is not null").select("account_key", "external_id").distinct()
    # One row may stand for a key with an external id, and only if the ledger has none.
    ext = mine.where("external_id is not null").join(held, ["account_key", "external_id"], "left_anti").withColumn("r", rank).where("r = 1")
    now = ledger.select(*FALLBACK, "dedupe_scope_id").unionByName(ext.select(*FALLBACK, "dedupe_scope_id"))
    scopes = now.groupBy(*FALLBACK).agg(F.min("dedupe_scope_id").alias("lo"), F.max("dedupe_scope_id").alias("hi"))
    rest = mine.where("external_id is null").join(scopes, FALLBACK, "left")
    head = F.first_value("dedupe_scope_id").over(Window.partitionBy("dedupe_key").orderBy(*order))
    rest = rest.withColumn("scope", F.when(F.col("lo").isNull(), head).when(F.col("lo") == F.col("hi"), F.col("lo"))).where(F.col("scope") == F.col("dedupe_scope_id"))
    rest = rest.withColumn("r", rank).where("r <= quota").drop("lo", "hi", "scope")
    return ext.unionByName(rest).drop("r", "quota")
