"""The ledger: versioned Parquet tables, published by one atomic pointer.

Each commit or undo writes what it changes under a new version and then replaces ``CURRENT``, so a failure before
that leaves the old state whole. An import appends: the pointer lists the folders that make up a table, and only the
new rows are written; many small folders are put together now and then. One writer at a time holds a
lock. The root is a folder that driver and executors share, on any Hadoop file system.

The detectors are incremental. ``grouped`` holds the rows of ``transactions`` as the detectors group them, in folders by bucket of
(account, currency, counterparty), and so do the results. A commit appends its rows to their buckets, reads those buckets
alone, and puts their results in the place of the old ones; what it scans and writes follows the counterparties of its rows, not the
ledger. Whether a series is active depends on the latest day of all rows, which is kept per bucket and compared when results are read.

An undo rewrites no transactions: the version names the reverted imports, whose rows all readers leave out (an import
id is never used again). They go when folders are put together, and all of them at ``refresh``, which makes the detectors' tables anew.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.errors import CofferError
from coffer.operators import importing as imp
from coffer.operators import intelligence as intel
from coffer.operators import profile
from coffer.plans.sqlguard import VIEWS, query, resolve_sql, rows
from coffer.plans.storage import Files
from coffer.sources.readers import frame, read_source

TABLES = {
    "transactions": "txn_id string, import_id string, statement_id string, dedupe_scope_id string, account_key string, posted_at date, amount double, currency string, description string, external_id string, merchant string, category string",
    "accounts": "account_key string, account_type string, created_at string, updated_at string",
    "import_runs": "import_id string, status string, created_at string, committed_at string, reverted_at string, rows_read long, rows_valid long, rows_invalid long, inserted long, deduped long, source_kind string, source_ref string",
    "stats": "import_id string, account_key string, rows_read long, inserted long, deduped long",
    "candidates": "candidate_id string, import_id string, dedupe_key string, statement_id string, dedupe_scope_id string, account_key string, posted_at date, amount double, currency string, description string, external_id string, merchant string, category string, source_row_index long, dedupe_reason string, matched_txn_id string, matched_import_id string, matched_batch_row_index long, created_at string, promoted_txn_id string",
    "recurring": "group_key string, account_key string, merchant string, cadence string, typical_amount double, currency string, last_seen_at date, next_expected_at date, occurrence_count long, score double, is_active long",
    "anomalies": "txn_id string, account_key string, posted_at date, merchant string, amount double, currency string, reason_code string, reason string, score double, severity string",
}
#: As stored: whether a series is active is told when it is read.
STORED = TABLES | {
    "recurring": TABLES["recurring"].replace("is_active long", "active_days int"),
    "grouped": "import_id string, txn_id string, account_key string, posted_at date, amount double, currency string, description string, "
    "who struct<key: string, source: string, quality: double, eligible: boolean>, sign string, counterparty string",
}
BUCKETED = ["grouped", "recurring", "anomalies"]
PREVIEW = 50
#: Buckets of a ledger's groups; a ledger keeps its number until ``refresh``.
BUCKETS = 256
#: Folders of a bucket beyond which they are put together.
MOST_OF_BUCKET = 16
#: How long folders stay that no current table names.
RETAIN_SECONDS = 7 * 86_400.0
#: Issues that the error of a rejected import holds.
ISSUES = 1000
#: Folders of a table beyond which they are put together.
MOST_PARTS = 64


class Ledger:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.files, self.buckets = spark, Files(spark, root), buckets

    # Storage

    def _json(self, name: str) -> dict:
        text = self.files.read(name)
        try:
            return {} if text is None else json.loads(text)
        except ValueError as e:
            raise CofferError("ledger_corrupt", f"{name} can't be read.") from e

    def _current(self) -> dict[str, list[str]]:
        return self._json("CURRENT")

    def _state(self, pointer: dict[str, list[str]]) -> dict:
        """buckets: their number; latest: the latest day of each; reverted: imports whose rows folders may still hold. Empty for a
        ledger that was written before there were buckets."""
        return self._json(pointer["state"][0]) if "state" in pointer else {}

    def _read(self, name: str, parts: list[str], reverted: list[str] | None = None) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STORED[name])
        df = self.spark.read.schema(STORED[name]).option("recursiveFileLookup", "true").parquet(*[self.files.path(p) for p in parts])
        mine = F.col("import_id")
        return df.where(mine.isNull() | ~mine.isin(reverted)) if reverted and name in ("transactions", "grouped") else df

    def table(self, name: str) -> DataFrame:
        pointer = self._current()
        state, parts = self._state(pointer), pointer.get(name, [])
        if name != "recurring":
            return self._read(name, parts, state.get("reverted"))
        if parts and not state:
            return self.spark.read.schema(TABLES[name]).parquet(*[self.files.path(p) for p in parts])
        latest = F.lit(max(state.get("latest", {}).values(), default=None)).cast("date")
        return self._read(name, parts).select("*", intel.is_active(latest).alias("is_active")).drop("active_days")

    def _publish(
        self, owner: str, new: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None, reverted: tuple[str, DataFrame] | None = None, anew: bool = False
    ) -> None:
        """Writes the new rows and the changed tables, then both detectors over the buckets of rows that came or went (or over all
        transactions, if ``anew``), then the pointer. ``reverted``: an import and its rows."""
        version, pointer = f"v{time.time_ns()}", self._current()
        state = self._state(pointer)
        gone, came, touched = list(state.get("reverted", [])), None, set()
        if not state or anew:
            anew, state = True, {"buckets": self.buckets, "latest": {}}

        def stored(name: str, df: DataFrame, *more: str) -> DataFrame:
            return df.select(*[c.split(":")[0].split()[0] for c in re.split(r", (?![^<]*>)", STORED[name])], *more)

        def write(name: str, df: DataFrame, folder: str | None = None) -> str:
            stored(name, df).write.parquet(self.files.path(f"{version}/{folder or name}"))
            return f"{version}/{folder or name}"

        def write_buckets(name: str, df: DataFrame, folder: str | None = None) -> list[str]:
            """Rows dealt to their buckets; the exchange splits a hot bucket over tasks and puts small ones together."""
            place = f"{version}/{folder or name}"
            dealt = df.withColumn("bucket", intel.bucket(state["buckets"], "counterparty" if name == "grouped" else "merchant"))
            stored(name, dealt, "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.files.path(place))
            return [f"{place}/{b}" for b in self.files.names(place) if b.startswith("bucket=")]

        if reverted:
            touched |= {str(r[0]) for r in intel.grouped(reverted[1]).select(intel.bucket(state["buckets"])).distinct().collect()}
            gone.append(reverted[0])
        for name, df in (changed or {}).items():
            pointer[name] = [write(name, df)]
        for name, df in (new or {}).items():
            part = write(name, df)
            parts = [*pointer.get(name, []), part]
            pointer[name] = parts if len(parts) <= MOST_PARTS else [write(name, self._read(name, parts, gone), f"{name}-whole")]
            came = self._read(name, [part]) if name == "transactions" else came
        if anew:
            came, pointer = self._read("transactions", pointer.get("transactions", []), gone), pointer | {t: [] for t in BUCKETED}
            if gone:
                pointer["transactions"] = [write("transactions", came, "transactions-whole")]
                came, gone = self._read("transactions", pointer["transactions"]), []
        if came is not None:
            parts = write_buckets("grouped", intel.grouped(came, "import_id"))
            touched |= {bucket_of(p) for p in parts}
            pointer["grouped"] = pointer["grouped"] + parts
        if touched:
            mine = [p for p in pointer["grouped"] if bucket_of(p) in touched]
            rows_ = self._read("grouped", mine, gone)
            crowded = [b for b, n in Counter(map(bucket_of, mine)).items() if n > MOST_OF_BUCKET]
            if crowded:
                whole = write_buckets("grouped", self._read("grouped", [p for p in mine if bucket_of(p) in crowded], gone), "grouped-whole")
                pointer["grouped"] = [p for p in pointer["grouped"] if bucket_of(p) not in crowded] + whole
            for name, found in (("recurring", intel.recurring(rows_)), ("anomalies", intel.anomalies(rows_))):
                pointer[name] = [p for p in pointer[name] if bucket_of(p) not in touched] + write_buckets(name, found)
            days = rows_.groupBy(intel.bucket(state["buckets"]).alias("b")).agg(F.max("posted_at").cast("string")).collect()  # a row per bucket
            state["latest"] = {b: d for b, d in state["latest"].items() if b not in touched} | {str(b): d for b, d in days}
        self.files.create(f"{version}/state", json.dumps(state | {"reverted": gone}))
        pointer["state"] = [f"{version}/state"]
        self.files.check(owner)
        self.files.replace("CURRENT", json.dumps(pointer))

    def vacuum(self, retain_seconds: float = RETAIN_SECONDS) -> dict:
        """Deletes table folders that the current state doesn't name, and staging that a dead writer left, if they were written longer ago
        than ``retain_seconds``: readers of an older state may run that long. Returns the number of folders and bytes."""
        limit, gone, size = time.time_ns() - int(retain_seconds * 10**9), 0, 0
        with self.files.lock() as owner:
            used = {part for parts in self._current().values() for part in parts}
            partly = {part.rsplit("/", 1)[0] for part in used if "/bucket=" in part}
            old = [f"{v}/{name}" for v in self.files.names("") if re.fullmatch("v[0-9]+", v) and int(v[1:]) < limit for name in self.files.names(v)]
            buckets = [f"{x}/{b}" for x in old if x in partly for b in self.files.names(x) if b.startswith("bucket=")]
            dead = [f"staging/{x}" for x in self.files.names("staging") if re.fullmatch("imp_[0-9]+", x) and int(x[4:]) < limit]
            for folder in [x for x in old + buckets if x not in used and x not in partly] + dead:
                self.files.check(owner)
                size += self.files.size(folder)
                self.files.delete(folder)
                gone += 1
            for version in {x.split("/")[0] for x in old}:
                if not self.files.names(version):
                    self.files.delete(version)
        return {"folders": gone, "bytes": size}

    def backfill(self) -> dict:
        """Accounts and per-import counters of a ledger that has transactions and candidates but not those, from its history."""
        stamp = str(time.time_ns() // 10**9)
        with self.files.lock() as owner:
            ledger, candidates = self.table("transactions"), self.table("candidates")
            held = self.table("accounts")
            accounts = held.unionByName(imp.accounts_of(ledger, stamp).join(held.select("account_key"), "account_key", "left_anti"))
            stats = imp.history_stats(ledger, candidates)
            kept = self.table("stats").join(stats, ["import_id", "account_key"], "left_anti")
            self._publish(owner, changed={"accounts": accounts, "stats": kept.unionByName(stats)})
        return {"accounts": self.table("accounts").count(), "stats": self.table("stats").count()}

    # Import

    def create(self, path: str | None = None, stdin: str | None = None, df: DataFrame | None = None, dry_run: bool = False, source: tuple[str, str | None] = ("dataframe", None)) -> dict:
        """``source``: kind and reference that the run record gets for rows that are in Spark."""
        now = time.time_ns()
        import_id, stamp = f"imp_{now:020d}", str(now // 10**9)
        try:
            staged = lambda rows, name: self._staged(rows, import_id, name)
            raw, kind, ref = (frame(df), *source) if df is not None else read_source(self.spark, path, stdin, staged)
            with self.files.lock() as owner:
                return self._import(owner, raw, import_id, stamp, dry_run, kind, ref)
        finally:
            self.files.delete(f"staging/{import_id}")

    def _staged(self, df: DataFrame, import_id: str, name: str) -> DataFrame:
        """The rows written and read again, so that the source is parsed and the expressions run once."""
        path = self.files.path(f"staging/{import_id}/{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _import(self, owner: str, raw: DataFrame, import_id: str, stamp: str, dry_run: bool, kind: str, ref: str | None) -> dict:
        ledger, accounts = self.table("transactions"), self.table("accounts")
        clean, issues = imp.split_checked(self._staged(imp.checked(raw), import_id, "checked"), import_id)
        self._reject(issues, import_id)
        for check, code in ((imp.statement_reuse(clean, ledger), "statement_id_reused"), (imp.ledger_type_conflicts(clean, accounts), "account_type_conflict_with_ledger")):
            self._reject(check.select("row", F.lit(code).alias("code")), import_id)
        batch = imp.batch_duplicates(clean.withColumn("dedupe_key", imp.dedupe_key()))
        matched = imp.ledger_matches(batch.where("matched_row is null"), ledger)
        every = self._staged(matched.unionByName(batch.where("matched_row is not null"), allowMissingColumns=True), import_id, "matched")
        new, repeated = every.where("matched_row is null and matched_txn_id is null"), every.where("matched_row is not null or matched_txn_id is not null")
        n_read, n_new = every.count(), new.count()
        result = {"import_id": import_id, "dry_run": dry_run, "rows_read": n_read, "rows_valid": n_read, "rows_invalid": 0, "inserted": n_new, "deduped": n_read - n_new}
        repeats = self._duplicates(repeated, import_id, stamp)
        preview = repeats.orderBy("source_row_index", "dedupe_reason", "candidate_id").limit(PREVIEW + 1).collect()
        result |= {"duplicates": [r.asDict() for r in preview[:PREVIEW]], "duplicates_truncated": len(preview) > PREVIEW}
        if dry_run:
            history = profile.transactions_view(ledger, accounts)
            each = lambda df: [r.asDict() for r in df.collect()]
            warnings = each(profile.order_warnings(profile.drift_warnings(new, history)))
            profiles = each(profile.sign_profiles(history).orderBy("account_key"))
            return result | {"import_id": None, "warnings": warnings, "inventory": each(profile.key_counts(history)), "sign_profiles": profiles}
        txn = F.concat(F.lit(f"txn_{import_id.removeprefix('imp_')}_"), F.lpad(F.col("row").cast("string"), 12, "0"))
        rows_ = new.withColumns({"txn_id": txn, "import_id": F.lit(import_id)})
        stats = imp.account_counters(every, new).withColumn("import_id", F.lit(import_id))
        run = self.spark.createDataFrame([(import_id, "committed", stamp, stamp, None, n_read, n_read, 0, n_new, n_read - n_new, kind, ref)], TABLES["import_runs"])
        self._publish(
            owner, {"transactions": rows_.select(*ledger.columns), "stats": stats, "import_runs": run, "candidates": repeats}, {"accounts": imp.upsert_accounts(accounts, every, stamp)}
        )
        return result | {"ledger_accounts": self.accounts()}

    def _reject(self, issues: DataFrame, import_id: str) -> None:
        """Raises if there are issues. All of them stay in a table of the rejected import; the error holds counts and the first ones, so that
        its size does not grow with the import."""
        kept = f"rejected/{import_id}"
        issues.write.mode("overwrite").parquet(self.files.path(kept))
        issues = self.spark.read.schema(issues.schema).parquet(self.files.path(kept))
        order = [c for c in ("row", "field", "code") if c in issues.columns]
        first = [r.asDict() for r in issues.orderBy(*order).limit(ISSUES + 1).collect()]
        if not first:
            self.files.delete(kept)
            return
        total = issues.agg(F.count("*").alias("issues_total"), F.count_distinct("row").alias("rows_invalid")).first().asDict()
        by_code = {r["code"]: r["count"] for r in issues.groupBy("code").count().orderBy("code").collect()}
        raise CofferError(
            "import_validation_failed", "No rows were imported.", {"issues": first[:ISSUES], "issues_truncated": len(first) > ISSUES, "issues_by_code": by_code, "rejected_import": import_id} | total
        )

    def issues(self, rejected_import: str) -> DataFrame:
        """All issues of a rejected import."""
        if not re.fullmatch("imp_[0-9]+", rejected_import) or not self.files.exists(f"rejected/{rejected_import}"):
            raise CofferError("invalid_argument", f"No rejected import {rejected_import} is known.")
        return self.spark.read.parquet(self.files.path(f"rejected/{rejected_import}"))

    def forget_issues(self, older_than_seconds: float = 30 * 86_400) -> int:
        """Deletes the issues of imports that were rejected so long ago; returns how many."""
        limit, gone = time.time_ns() - int(older_than_seconds * 10**9), 0
        for name in self.files.names("rejected"):
            if name.startswith("imp_") and int(name.removeprefix("imp_")) < limit:
                self.files.delete(f"rejected/{name}")
                gone += 1
        return gone

    @staticmethod
    def _duplicates(repeated: DataFrame, import_id: str, stamp: str) -> DataFrame:
        """Candidates of rows that repeat an earlier row of the batch (matched_row) or of the ledger."""
        fields = ["dedupe_key", "statement_id", "dedupe_scope_id", "account_key", "posted_at", "amount", "currency", "description", "external_id", "merchant", "category"]
        reason = F.when(F.col("matched_row").isNotNull(), "batch").otherwise("existing_ledger")
        return repeated.select(
            F.concat(F.lit(f"dup_{import_id}_"), F.lpad(F.col("row").cast("string"), 12, "0")).alias("candidate_id"), F.lit(import_id).alias("import_id"), *fields,
            F.col("row").alias("source_row_index"), reason.alias("dedupe_reason"), "matched_txn_id", "matched_import_id", F.col("matched_row").alias("matched_batch_row_index"),
            F.lit(stamp).alias("created_at"), F.lit(None).cast("string").alias("promoted_txn_id"),
        )

    def undo(self, import_id: str) -> dict:
        now = time.time_ns()
        with self.files.lock() as owner:
            runs = self.table("import_runs")
            status = [r["status"] for r in runs.where(F.col("import_id") == import_id).collect()]
            if not status:
                raise CofferError("import_id_not_found", import_id)
            if status[0] != "committed":
                raise CofferError("import_already_reverted", import_id)
            ledger, candidates, accounts = self.table("transactions"), self.table("candidates"), self.table("accounts")
            mine = F.col("import_id") == import_id
            removed, rest = ledger.where(mine), ledger.where(~mine)
            runs = runs.withColumn("status", F.when(mine, "reverted").otherwise(F.col("status"))).withColumn("reverted_at", F.when(mine, F.lit(str(now // 10**9))).otherwise(F.col("reverted_at")))
            dead = candidates.withColumn("promoted_txn_id", F.when(mine & F.col("promoted_txn_id").isNull(), "__invalid__").otherwise(F.col("promoted_txn_id")))
            chosen = imp.promotions(removed, imp.open_candidates(dead, runs), rest)
            chosen = chosen.withColumn("txn_id", F.concat(F.lit(f"txn_{now:020d}_"), "candidate_id"))
            promoted = chosen.select(*ledger.columns)
            after = rest.unionByName(promoted)
            dead = dead.join(chosen.select("candidate_id", F.col("txn_id").alias("new_txn")), "candidate_id", "left").withColumn("promoted_txn_id", F.coalesce("new_txn", "promoted_txn_id"))
            touched = self.table("stats").where(mine).select("account_key").distinct()
            gone = touched.join(after.select("account_key"), "account_key", "left_anti")
            counts = {"rows_reverted": removed.count(), "rows_promoted": chosen.count()}
            changed = {"import_runs": runs, "candidates": dead, "accounts": accounts.join(gone, "account_key", "left_anti")}
            self._publish(owner, {"transactions": promoted}, changed, (import_id, removed))
        return {"import_id": import_id, **counts, "intelligence_refreshed": True}

    def refresh(self) -> dict:
        """Makes the detectors' tables anew from all transactions, with the number of buckets that this ledger was opened with."""
        with self.files.lock() as owner:
            self._publish(owner, anew=True)
        return {"recurring": self.table("recurring").count(), "anomalies": self.table("anomalies").count()}

    # Reads

    def imports(self) -> DataFrame:
        per = profile.import_accounts(self.table("stats"), self.table("accounts"))
        return self.table("import_runs").join(per, "import_id", "left").orderBy(F.col("created_at").try_cast("long").desc(), F.desc("import_id"))

    def duplicates(self, import_id: str) -> DataFrame:
        if self.table("import_runs").where(F.col("import_id") == import_id).isEmpty():
            raise CofferError("import_id_not_found", import_id)
        return live_pointers(self.table("candidates").where(F.col("import_id") == import_id), self.table("transactions")).orderBy("source_row_index", "dedupe_reason", "candidate_id")

    def views(self) -> dict[str, DataFrame]:
        t = profile.transactions_view(self.table("transactions"), self.table("accounts"))
        frames = [t, profile.account_rollup(t), self.table("import_runs"), self.table("recurring"), self.table("anomalies")]
        return dict(zip(VIEWS, frames, strict=True))

    def accounts(self) -> dict:
        view = self.views()["v1_transactions"]
        return {"summary": profile.account_summary(view).first().asDict(), "rows": [r.asDict() for r in profile.account_rollup(view).orderBy("account_key", "currency").collect()]}

    def keys(self, name: str | None = None) -> DataFrame:
        view = self.views()["v1_transactions"]
        if name is not None and name not in profile.PROPERTIES:
            raise CofferError("invalid_argument", f"Unknown property {name}.")
        out = profile.key_inventory(view)
        return (out.where(F.col("property") == name) if name else out).orderBy("property", "value")

    def recurring(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        df = intel.between_dates(self.table("recurring"), "last_seen_at", date_from, date_to)
        return intel.order_recurring(df.withColumn("is_active", F.col("is_active") == 1))

    def anomalies(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        return intel.order_anomalies(intel.between_dates(self.table("anomalies"), "posted_at", date_from, date_to))

    def sql(self, text: str | None = None, limit: int | None = None, file: str | None = None, stdin: str | None = None) -> dict:
        """The rows of one SELECT from exactly one source."""
        sql, source = resolve_sql(text, file, stdin)
        return rows(query(self.spark, self.views(), sql), limit) | {"source": source, "source_ref": file if source == "file" else None}

    def schema(self, view: str | None = None) -> dict:
        """The public views with their columns, and where the ledger is; or the columns of one view."""
        views = self.views()
        if view is not None and view not in views:
            raise CofferError("unknown_view", f"There is no view {view}; the views are {', '.join(VIEWS)}.")
        columns = lambda df: [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]
        if view is not None:
            return {"view_name": view, "columns": columns(views[view])}
        return {"ledger_path": self.files.root, "public_views": [{"name": n, "columns": columns(df)} for n, df in views.items()]}


def bucket_of(part: str) -> str:
    return part.rsplit("/bucket=", 1)[1]


def live_pointers(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each candidate with the ledger row that stands for it now: promoted, else the one met at import, else any it matches."""
    ids = ledger.select("txn_id", "import_id")
    side = lambda k: ids.select(F.col("txn_id").alias(f"{k}_txn"), F.col("import_id").alias(f"{k}_import"))
    c = candidates.withColumnsRenamed({"matched_txn_id": "matched_txn_id_at_dedupe", "matched_import_id": "matched_import_id_at_dedupe"})
    c = imp.ledger_matches(c, ledger).withColumnsRenamed({"matched_txn_id": "any_txn", "matched_import_id": "any_import"})
    c = c.join(side("p"), F.col("promoted_txn_id") == F.col("p_txn"), "left").join(side("d"), F.col("matched_txn_id_at_dedupe") == F.col("d_txn"), "left")
    old = F.col("dedupe_reason") == "existing_ledger"
    now = lambda k: F.coalesce(f"p_{k}", f"d_{k}", F.when(old, F.col(f"any_{k}")))
    return c.withColumns({"matched_txn_id": now("txn"), "matched_import_id": now("import")}).drop("any_txn", "any_import", "p_txn", "p_import", "d_txn", "d_import")
