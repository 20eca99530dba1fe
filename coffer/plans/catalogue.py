"""Ledger queries over the test tables, each with the SQL that gives the same rows.

Projections of the test tables to ledger rows are SQL that both engines read; what is under test, the operators, is built
from DataFrames here and written by hand in SQL there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions.text import NOISE, account_type, amount_at_scale, counterparty, effective_scale, fingerprint, normal_text, round_to, trimmed, valid_date
from coffer.operators import importing as imp
from coffer.operators import intelligence as intel
from coffer.operators import profile
from coffer.plans import sqlguard
from coffer.plans.ledger import live_pointers

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

EVENTS = "select 'txn_' || lpad(cast(event_id as string), 12, '0') as txn_id, cast(user_id as string) as account_key, cast(ts as date) as posted_at, value as amount, 'usd' as currency, event_type as merchant, event_type as description from events"
_CENTS = "cast(sum(cast(round({0} * 100, 0) as bigint)) as double) / count(*)"


def _rollup(table: str, key: str, date: str, value: str, period: str) -> str:
    start = f"cast(date_trunc('{period}', {date}) as date)" if period != "fortnight" else f"cast('1990-01-01' as date) + cast(floor(datediff(cast({date} as date), cast('1990-01-01' as date)) / 14) * 14 as int)"
    return f"select {key} || '@' || cast({start} as string) as txn_id, 'main' as account_key, {start} as posted_at, round({_CENTS.format(value)}, 0) / 100 as amount, 'USD' as currency, {key} as merchant, {key} as description from {table} group by {key}, {start}"


ROLLUPS = {
    "recurring_orders_monthly": _rollup("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "month"),
    "recurring_lineitem_weekly": _rollup("lineitem", "l_linestatus || l_returnflag", "l_shipdate", "l_extendedprice", "week"),
    "recurring_events_weekly": _rollup("events", "event_type", "ts", "value", "week"),
    "recurring_biweekly_rollup": _rollup("lineitem", "l_linestatus || l_returnflag", "l_shipdate", "l_extendedprice", "fortnight"),
}

TX = """select 'txn_' || lpad(cast(l_orderkey as string), 12, '0') || '_' || cast(l_linenumber as string) || '_' || cast(l_partkey as string) || '_' || cast(l_suppkey as string) as txn_id, (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey as row, 'imp_' || cast(l_orderkey % 3 as string) as import_id,
    case when l_orderkey % 5 > 0 then 's' || cast(l_orderkey % 7 as string) end as statement_id,
    case when l_orderkey % 5 > 0 then 'stmt|acct-' || cast(l_suppkey % 20 as string) || '|s' || cast(l_orderkey % 7 as string) else 'gen|imp_' || cast(l_orderkey % 3 as string) || '|acct-' || cast(l_suppkey % 20 as string) end as dedupe_scope_id,
    case when l_orderkey % 1000 = 7 then 'acct-0' || cast(l_suppkey % 20 as string) else 'acct-' || cast(l_suppkey % 20 as string) end as account_key, cast(l_shipdate as date) as posted_at,
    case when l_returnflag = 'R' or (l_orderkey % 2 = 1 and l_suppkey % 20 < 3) then -l_quantity else l_quantity end as amount, case when l_orderkey % 501 = 2 then 'EUR' else 'USD' end as currency,
    l_linestatus || ' ' || l_returnflag as description, case when l_linenumber = 1 then 'x' || cast(l_partkey % 500 as string) end as external_id,
    case when l_linenumber % 2 = 0 then l_returnflag || ' store' when l_orderkey % 301 = 5 then 'new shop' end as merchant, case when l_linenumber = 3 then ' ' when l_linenumber = 4 then 'food' end as category,
    case when l_suppkey % 3 = 0 then 'checking' when l_suppkey % 3 = 1 and l_linenumber % 2 = 0 then 'savings' when l_suppkey % 7 = 1 then 'loan' end as account_type,
    l_orderkey % 2 as half from lineitem"""
ACCOUNTS = "select 'acct-' || cast(s_nationkey as string) as account_key, min(case when s_nationkey % 2 = 0 then 'checking' end) as account_type from supplier group by s_nationkey"


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[..., DataFrame], sources: list[str], sql: str, prefix: dict[str, str] | None = None) -> None:
    """A query that applies ``run`` to the loaded sources; ``sql`` reads them by the names in ``prefix``."""
    _QUERIES[name] = lambda spark, sf_dir: run(*[load(spark, sf_dir, s) for s in sources])
    ctes = ", ".join(f"{k} as ({v})" for k, v in (prefix or {}).items())
    _SQL[name] = (f"with {ctes}, " if sql.startswith("with!") else f"with {ctes} " if ctes else "") + sql.removeprefix("with!")


# Detectors

_NORM = "nullif(upper(trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))), '')"
_PRINT = "nullif(array_to_string([t for t in string_split({0}, ' ') if not list_contains([" + ", ".join(f"'{x}'" for x in NOISE) + "], t) and not regexp_full_match(t, '[0-9]+')][1:4], ' '), '')"
_GROUPED = f"""n as (select *, upper(trim(currency)) as cur, {_NORM.format("merchant")} as m, {_PRINT.format(_NORM.format("description"))} as f from tx where amount <> 0 and posted_at is not null),
    g as (select txn_id, account_key, posted_at, amount, cur as currency, case when amount < 0 then 'debit' else 'credit' end as sign, coalesce(m, f) as cp, description,
          case when m is not null then 1.0 else case len(string_split(f, ' ')) when 1 then 0.55 when 2 then 0.8 when 3 then 0.85 else 0.9 end end::double as q, m is not null or len(string_split(f, ' ')) >= 2 as eligible from n where coalesce(m, f) is not null)"""
_MAD = """a as (select account_key, currency, sign, cp, count(*) as n, median(abs(amount)) as med from g group by all),
    b as (select account_key, currency, sign, cp, median(abs(abs(amount) - med)) as mad from g join a using (account_key, currency, sign, cp) group by all)"""
_ANOMALY = f"""with!{_GROUPED}, {_MAD}, c as (select g.*, med, greatest(15.0, 0.45 * med, 3.0 * mad) as tol, abs(amount) - med as delta, abs(amount) / med as ratio from g join a using (account_key, currency, sign, cp) join b using (account_key, currency, sign, cp) where n >= 6 and med > 2.220446049250313e-16),
    s as (select *, round((0.6 * least(delta / (2.5 * tol), 1.0) + 0.3 * least((ratio - 2.2) / 2.0, 1.0) + 0.1 * q) * 10000, 0) / 10000 as score from c where delta > tol and ratio >= 2.2),
    z as (select txn_id, account_key, posted_at, cp as merchant, round(amount * 100, 0) / 100 as amount, currency, 'amount_spike' as reason_code, printf('Amount is unusually high for this merchant (%.2fx typical).', round(ratio * 100, 0) / 100) as reason, score,
          case when score >= 0.92 then 'high' when score >= 0.86 then 'medium' else 'low' end as severity from s)"""
_EV = {"tx": EVENTS}
_add("anomalies_events", intel.anomalies, [EVENTS], _ANOMALY + " select * from z where score >= 0.82", _EV)
_add("anomaly_scores_all", intel.anomaly_scores, [EVENTS], _ANOMALY + " select * from z", _EV)
_add("anomaly_severity_counts", lambda t: intel.anomalies(t).groupBy("severity").agg(F.count("*").alias("n"), F.max("score").alias("top")), [EVENTS], _ANOMALY + " select severity, count(*) as n, max(score) as top from z where score >= 0.82 group by severity", _EV)
_add("anomalies_between", lambda t: intel.order_anomalies(intel.between_dates(intel.anomalies(t), "posted_at", "2024-01-05", "2024-01-20")), [EVENTS], _ANOMALY + " select * from z where score >= 0.82 and posted_at between date '2024-01-05' and date '2024-01-20'", _EV)
_add("median_mad_by_group", lambda t: intel.median_mad(intel.grouped(t)).select("account_key", "currency", "sign", "counterparty", "n", round_to("med", 4).alias("med"), round_to("mad", 4).alias("mad")), [EVENTS], f"with!{_GROUPED}, {_MAD} select account_key, currency, sign, cp as counterparty, n, round(med * 10000, 0) / 10000 as med, round(mad * 10000, 0) / 10000 as mad from a join b using (account_key, currency, sign, cp)", _EV)

_STEP = "case when day(prev) > day(last_day(prev + interval 1 month)) then last_day(prev + interval 1 month) else cast(prev + interval 1 month as date) end"
_RECUR = f"""with!{_GROUPED}, p as (select *, lag(posted_at) over (partition by account_key, currency, sign, cp order by posted_at, txn_id) as prev from g),
    e as (select *, abs(abs(posted_at - prev) - 7) as e7, abs(abs(posted_at - prev) - 14) as e14, abs(posted_at - {_STEP}) as em from p),
    k as (select account_key, currency, sign, cp, count(*) as n, min(posted_at) as first_seen_at, max(posted_at) as last_seen_at, arg_min(q, (posted_at, txn_id)) as q, arg_min(eligible, (posted_at, txn_id)) as eligible, arg_min(description, (posted_at, amount, description)) as sample_description,
          count(*) filter (where e7 <= 1) as i7, count(*) filter (where e14 <= 2) as i14, count(*) filter (where em <= 3) as im, floor(median(e7)) as m7, floor(median(e14)) as m14, floor(median(em)) as mm, median(abs(amount)) as am, median(amount) as sm, min(amount) as amount_min, max(amount) as amount_max from e group by all),
    o as (select *, 'weekly' as cadence, 4 as least, 1 as priority, 28 as active, i7 / (n - 1) as fit, m7 as err from k where n >= 3 and eligible union all by name select *, 'biweekly' as cadence, 4 as least, 2 as priority, 56 as active, i14 / (n - 1) as fit, m14 as err from k where n >= 3 and eligible
          union all by name select *, 'monthly' as cadence, 3 as least, 3 as priority, 124 as active, im / (n - 1) as fit, mm as err from k where n >= 3 and eligible),
    af as (select account_key, currency, sign, cp, count(*) filter (where abs(abs(amount) - am) <= greatest(0.15 * am, 1.0)) / count(*) as afit from g join k using (account_key, currency, sign, cp) group by all),
    sc as (select *, 0.65 * fit + 0.25 * afit + 0.10 * q as raw from o join af using (account_key, currency, sign, cp) where n >= least and fit >= 0.75 and afit >= 0.75),
    best as (select *, row_number() over (partition by account_key, currency, sign, cp order by fit desc, err, n desc, priority desc) as rk from sc where raw >= 0.78),
    z as (select account_key || '|' || currency || '|' || sign || '|' || cp as group_key, account_key, cp as merchant, cadence, round(sm * 100, 0) / 100 as typical_amount, currency, last_seen_at,
          case cadence when 'weekly' then last_seen_at + 7 when 'biweekly' then last_seen_at + 14 else cast(last_seen_at + interval 1 month as date) end as next_expected_at, n as occurrence_count, round(raw * 10000, 0) / 10000 as score,
          cast(((select max(posted_at) from g) - last_seen_at) <= active as bigint) as is_active from best where rk = 1)"""
for _name, _sql in ROLLUPS.items():
    _duck = re.sub(r"datediff\((cast\(\w+ as date\)), (cast\('1990-01-01' as date\))\)", r"datediff('day', \2, \1)", _sql)
    _add(_name, lambda t: intel.order_recurring(intel.recurring(t).select(*intel.RECURRING_COLUMNS)), [_sql], _RECUR + " select * from z", {"tx": _duck})
_W = ROLLUPS["recurring_lineitem_weekly"]
_add("recurring_is_active", lambda t: intel.recurring(t).groupBy("is_active", "cadence").agg(F.count("*").alias("n")), [_W], _RECUR + " select is_active, cadence, count(*) as n from z group by all", {"tx": _W})
_add("cadence_interval_errors", lambda t: intel.interval_errors(intel.grouped(t)).where("prev is not null").select("txn_id", "prev", "err_weekly", "err_biweekly", "err_monthly"), [_W], _RECUR + " select txn_id, prev, cast(e7 as integer) as err_weekly, cast(e14 as integer) as err_biweekly, cast(em as integer) as err_monthly from e where prev is not null", {"tx": _W})
_add("cadence_best_candidate", lambda t: intel.cadence_candidates(intel.grouped(t)).select("counterparty", "cadence", "n", round_to("cadence_fit", 6).alias("fit"), F.col("median_error").cast("long").alias("err")), [_W], _RECUR + " select cp as counterparty, cadence, n, round(fit * 1000000, 0) / 1000000 as fit, cast(err as bigint) as err from o where n >= least", {"tx": _W})
_add("amount_stats_by_group", lambda t: intel.amount_stats(intel.grouped(t)).select("account_key", "counterparty", "sign", "n", *[round_to(c, 4).alias(c) for c in ("abs_median", "tolerance", "signed_median", "amount_min", "amount_max", "amount_fit")]), [EVENTS],
     _RECUR + " select account_key, cp as counterparty, sign, n, round(am * 10000, 0) / 10000 as abs_median, round(greatest(0.15 * am, 1.0) * 10000, 0) / 10000 as tolerance, round(sm * 10000, 0) / 10000 as signed_median, round(amount_min * 10000, 0) / 10000 as amount_min, round(amount_max * 10000, 0) / 10000 as amount_max, round(afit * 10000, 0) / 10000 as amount_fit from k join af using (account_key, currency, sign, cp)", _EV)

# Expressions

_TEXT = "select p_partkey as id, case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then ' - ' else p_brand || '  &' || p_type end as merchant, 'POS card ' || cast(p_size as string) || ' ' || p_name || '-' || p_brand as description from part"
_add("counterparty_normalize", lambda t: t.select("id", normal_text("merchant").alias("merchant_key"), normal_text("description").alias("description_key")), [_TEXT], f"select id, {_NORM.format('merchant')} as merchant_key, {_NORM.format('description')} as description_key from t", {"t": _TEXT})
_add("description_fingerprint", lambda t: t.select("id", fingerprint("description").alias("print")), [_TEXT], f"select id, {_PRINT.format(_NORM.format('description'))} as print from t", {"t": _TEXT})
_add("counterparty_quality", lambda t: t.select("id", counterparty("merchant", "description").alias("w")).select("id", "w.key", "w.source", "w.quality", "w.eligible"), [_TEXT],
     f"with!n as (select id, {_NORM.format('merchant')} as m, {_PRINT.format(_NORM.format('description'))} as f from t) select id, coalesce(m, f) as key, case when m is not null then 'merchant' when f is not null then 'description' end as source, cast(case when m is not null then 1.0 else case len(string_split(f, ' ')) when 1 then 0.55 when 2 then 0.8 when 3 then 0.85 when 4 then 0.9 end end as double) as quality, m is not null or len(string_split(f, ' ')) >= 2 as eligible from n", {"t": _TEXT})
_TYPES = "select c_custkey as id, case c_custkey % 12 when 0 then 'Credit-Card' when 1 then 'retirement_401k' when 2 then 'investment taxable' when 3 then ' HSA ' when 4 then 'my auto thing' when 5 then 'joint checking & savings' when 6 then 'Roth' when 7 then c_mktsegment when 8 then '__' when 9 then 'other loan' when 10 then 'card' else null end as t from customer"
_add("account_type_canonical", lambda t: t.select("id", account_type("t").alias("account_type")), [_TYPES],
     "select id, case c % 12 when 0 then 'credit_card' when 1 then 'retirement' when 2 then 'brokerage' when 3 then 'hsa' when 4 then 'loan' when 5 then 'checking' when 6 then 'retirement' when 9 then 'loan' when 10 then 'credit_card' end as account_type from (select c_custkey as id, c_custkey as c from customer)")
_AMOUNTS = "select l_orderkey * 10 + l_linenumber as id, case l_orderkey % 8 when 0 then cast(cast(l_quantity as int) as string) || '.5' when 1 then '-' || cast(cast(l_quantity as int) as string) || '.125' when 2 then cast(cast(l_quantity as int) as string) || '.5e1' when 3 then '1d' when 4 then '.25' when 5 then ' +7. ' when 6 then '12e-3' else 'n/a' end as t from lineitem"
def _scales(t: DataFrame) -> DataFrame:
    """Each text is trimmed and its scale told once."""
    once = t.select("id", trimmed("t").alias("t")).select("id", "t", effective_scale("t", True).alias("scale"))
    return once.select("id", "scale", amount_at_scale("t", "scale").alias("amount"))


_add("amount_scale_check", _scales, [_AMOUNTS],
     "with!p as (select id, trim(t) as t from a), q as (select id, t, regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') as ok, len(regexp_extract(t, '\\.([0-9]*)', 1)) - coalesce(try_cast(nullif(regexp_extract(t, '[eE]([+-]?[0-9]+)$', 1), '') as int), 0) as s from p) select id, cast(case when ok then greatest(0, s) end as integer) as scale, case when ok and greatest(0, s) <= 2 then try_cast(t as double) end as amount from q", {"a": _AMOUNTS})
_DATES = "select o_orderkey as id, case o_orderkey % 5 when 0 then cast(cast(o_orderdate as date) as string) when 1 then '2024-02-30' when 2 then '24-1-1' when 3 then '2024-13-01' else ' 2024-02-29 ' end as t from orders"
_add("date_check", lambda t: t.select("id", valid_date("t").alias("d")), [_DATES], "select id, case when regexp_full_match(trim(t), '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(trim(t) as date) end as d from d", {"d": _DATES})
_RAW = "select o_orderkey as row, case when o_orderkey % 11 = 0 then '  ' else 'a' || cast(o_custkey % 9 as string) end as account_key, case when o_orderkey % 7 = 0 then '2024-02-31' else '2024-01-02' end as posted_at, case when o_orderkey % 5 = 0 then '1.234' when o_orderkey % 13 = 0 then 'abc' else '10.5' end as amount, 'usd' as currency, case when o_orderkey % 17 = 0 then null else o_orderpriority end as description, cast(null as string) as statement_id, case when o_orderkey % 3 = 0 then 'zzz' when o_custkey % 2 = 0 then 'savings' else 'loan' end as account_type, cast(null as string) as external_id, cast(null as string) as merchant, cast(null as string) as category from orders"
_add("issues_exploded", lambda t: imp.checked(t).select(F.explode("issues").alias("i")).select("i.row", "i.field", "i.code"), [_RAW],
     """select row, 'account_key' as field, 'missing_required_field' as code from r where trim(account_key) = '' union all select row, 'account_type', 'invalid_account_type' from r where account_type = 'zzz' union all select row, 'posted_at', 'invalid_date' from r where posted_at = '2024-02-31'
     union all select row, 'amount', case when amount = 'abc' then 'invalid_number' else 'invalid_amount_scale' end from r where amount <> '10.5' union all select row, 'description', 'missing_required_field' from r where description is null""", {"r": _RAW})  # fmt: skip

# Import

_FIRST = TX + " where l_orderkey % 2 = 1"
_OLD = TX + " where l_orderkey % 2 = 0"
_BOTH = {"i": _FIRST, "l": _OLD}
_add("batch_dedupe_external", lambda t: imp.batch_duplicates(t).where("external_id is not null and matched_row is not null").select("row", "matched_row"), [TX], "select row, f as matched_row from (select row, min(row) over (partition by account_key, external_id) as f from tx where external_id is not null) where row > f", {"tx": TX})
_K = "account_key, posted_at, amount, currency, description"
_add("batch_dedupe_fallback", lambda t: imp.batch_duplicates(t).where("external_id is null and matched_row is not null").select("row", "matched_row"), [TX], f"select row, fr as matched_row from (select row, dedupe_scope_id as s, first_value(row) over w as fr, first_value(dedupe_scope_id) over w as fs from tx where external_id is null window w as (partition by {_K} order by row)) where s <> fs", {"tx": TX})
_match = lambda cond: lambda i, l: imp.ledger_matches(i, l).where(cond).where("matched_txn_id is not null").select("row", "matched_txn_id", "matched_import_id")
_add("ledger_dedupe_external", _match("external_id is not null"), [_FIRST, _OLD], "select i.row, min(l.txn_id) as matched_txn_id, arg_min(l.import_id, l.txn_id) as matched_import_id from i join l using (account_key, external_id) group by i.row", _BOTH)
_add("ledger_dedupe_fallback", _match("external_id is null"), [_FIRST, _OLD], f"select i.row, min(l.txn_id) as matched_txn_id, arg_min(l.import_id, l.txn_id) as matched_import_id from i join l using ({_K}) where i.external_id is null and i.dedupe_scope_id <> l.dedupe_scope_id group by i.row", _BOTH)
_add("type_conflict_in_batch", lambda t: imp.type_conflicts(t).select("row", "account_type", "first_type"), [TX], "select row, account_type, ft as first_type from (select row, account_type, first_value(account_type) over (partition by account_key order by row) as ft from tx where account_type is not null) where account_type <> ft", {"tx": TX})
_add("type_conflict_ledger", lambda t, a: imp.ledger_type_conflicts(t, a).select("row", "account_type", "ledger_type"), [TX, ACCOUNTS], "select row, tx.account_type, a.account_type as ledger_type from tx join a using (account_key) where tx.account_type <> a.account_type", {"tx": TX, "a": ACCOUNTS})
_add("statement_reuse", lambda i, l: imp.statement_reuse(i, l).select("row", "used_by"), [_FIRST, _OLD], "select i.row, min(u) as used_by from i join (select account_key, statement_id, arg_min(import_id, txn_id) as u from l where statement_id is not null group by all) x using (account_key, statement_id) group by i.row", _BOTH)
_CAND = f"""select 'dup_' || txn_id as candidate_id, 'imp_9' as import_id, statement_id, dedupe_scope_id, account_key, posted_at, amount, currency, description, external_id, merchant, category, row as source_row_index, row,
    case when row % 4 = 0 then 'batch' else 'existing_ledger' end as dedupe_reason, case when row % 3 = 0 then 'txn_gone' end as matched_txn_id, case when row % 3 = 0 then 'imp_gone' end as matched_import_id, cast(row as string) as created_at,
    case when row % 10 = 1 then txn_id end as promoted_txn_id from ({_FIRST})"""
_CAND2 = _CAND + " c"
_add("duplicates_live_pointer", lambda c, l: live_pointers(c, l).select("candidate_id", "matched_txn_id", "matched_import_id", "matched_txn_id_at_dedupe"), [_CAND2, _OLD],
     f"""with!x as (select candidate_id, min(l.txn_id) as t, arg_min(l.import_id, l.txn_id) as m from c join l using (account_key, external_id) where c.external_id is not null group by 1 union all
     select candidate_id, min(l.txn_id), arg_min(l.import_id, l.txn_id) from c join l using ({_K}) where c.external_id is null and c.dedupe_scope_id <> l.dedupe_scope_id group by 1)
     select c.candidate_id, coalesce(p.txn_id, d.txn_id, case when dedupe_reason = 'existing_ledger' then x.t end) as matched_txn_id, coalesce(p.import_id, d.import_id, case when dedupe_reason = 'existing_ledger' then x.m end) as matched_import_id, c.matched_txn_id as matched_txn_id_at_dedupe
     from c left join l p on p.txn_id = c.promoted_txn_id left join l d on d.txn_id = c.matched_txn_id left join x using (candidate_id)""", {"c": _CAND2, "l": _OLD})  # fmt: skip
_REMOVED = TX + " where l_orderkey % 4 = 0"
_REST = TX + " where l_orderkey % 4 = 2"
_POOL = _CAND.replace("case when row % 10 = 1 then txn_id end", "cast(null as string)") + " c"
_KEY = "case when external_id is not null then 'ext|' || account_key || '|' || external_id else 'f|' || account_key || '|' || cast(posted_at as string) || '|' || cast(amount as string) || '|' || currency || '|' || description end"
_add("undo_promotion", lambda r, c, l: imp.promotions(r, c.withColumn("dedupe_key", imp.dedupe_key()), l).select("candidate_id"), [_REMOVED, _POOL, _REST],
     f"""with!q as (select {_KEY} as key, count(*) as quota from r group by 1), m as (select c.*, {_KEY} as key from c), mine as (select m.*, quota from m join q using (key)),
     e as (select *, row_number() over (partition by key order by cast(created_at as bigint), source_row_index, dedupe_reason, candidate_id) as k from mine where external_id is not null and (account_key, external_id) not in (select (account_key, external_id) from l where external_id is not null)),
     e1 as (select * from e where k = 1), now as (select {_K}, dedupe_scope_id from l union all select {_K}, dedupe_scope_id from e1), s as (select {_K}, min(dedupe_scope_id) as lo, max(dedupe_scope_id) as hi from now group by all),
     f as (select mine.*, lo, hi, first_value(dedupe_scope_id) over (partition by key order by cast(created_at as bigint), source_row_index, dedupe_reason, candidate_id) as head from mine left join s using ({_K}) where external_id is null),
     g as (select *, row_number() over (partition by key order by cast(created_at as bigint), source_row_index, dedupe_reason, candidate_id) as k from f where dedupe_scope_id = case when lo is null then head when lo = hi then lo end)
     select candidate_id from e1 union all select candidate_id from g where k <= quota""", {"r": _REMOVED, "c": _POOL, "l": _REST})  # fmt: skip

# Profiles and drift

_VIEW = "tx0 as (select * exclude (account_type) from t0), v as (select tx0.*, a.account_type from tx0 left join a using (account_key))"
_P2 = {"t0": TX, "a": ACCOUNTS}
_view = lambda t, a: profile.transactions_view(t.drop("account_type"), a)
_add("transactions_view", lambda t, a: _view(t, a).select("txn_id", "account_key", "account_type", "posted_at", "amount"), [TX, ACCOUNTS], f"with!{_VIEW} select txn_id, account_key, account_type, posted_at, amount from v", _P2)
_add("account_rollup", lambda t, a: profile.account_rollup(_view(t, a)).orderBy("account_key", "currency"), [TX, ACCOUNTS], f"with!{_VIEW} select account_key, account_type, currency, min(posted_at) as first_posted_at, max(posted_at) as last_posted_at, count(*) as txn_count, cast(sum(cast(amount as decimal(38,2))) as double) as net_amount from v group by all", _P2)
_add("account_summary", lambda t, a: profile.account_summary(_view(t, a)), [TX, ACCOUNTS], f"with!{_VIEW} select count(distinct account_key) as account_count, count(*) as transaction_count, count(distinct currency) as currency_count, count(distinct case when trim(account_type) <> '' then account_key end) as typed_account_count, min(posted_at) as earliest, max(posted_at) as latest, cast(sum(cast(amount as decimal(38,2))) as double) as net_amount, count(distinct account_key) - count(distinct case when trim(account_type) <> '' then account_key end) as untyped_account_count from v", _P2)
_add("data_range", profile.data_range, [TX], "select min(posted_at) as earliest, max(posted_at) as latest from tx", {"tx": TX})
_STACK = " union all ".join(f"select '{p}' as property, {p} as value from v" for p in profile.PROPERTIES)
_add("key_inventory", lambda t, a: profile.key_inventory(_view(t, a)), [TX, ACCOUNTS], f"with!{_VIEW} select property, value, count(*) as count from ({_STACK}) where trim(value) <> '' group by all", _P2)
_add("key_null_counts", lambda t, a: profile.key_counts(_view(t, a)), [TX, ACCOUNTS], f"with!{_VIEW} select property, count(*) filter (where coalesce(trim(value), '') = '') as null_count, count(*) as total_count, count(distinct case when trim(value) <> '' then value end) as unique_count from ({_STACK}) group by property", _P2)
_SIGN = "select account_key, count(*) filter (where amount < 0) as negative_count, count(*) filter (where amount > 0) as positive_count, coalesce(count(*) filter (where amount < 0) / nullif(count(*) filter (where amount <> 0), 0), 0.0) as negative_ratio, coalesce(count(*) filter (where amount > 0) / nullif(count(*) filter (where amount <> 0), 0), 0.0) as positive_ratio from {0} group by account_key"
_add("sign_profiles", profile.sign_profiles, [TX], _SIGN.format("tx"), {"tx": TX})
_UNSEEN = " union ".join(f"select '{p}' as property, {p} as value from i where trim({p}) <> '' and {p} not in (select {p} from l where trim({p}) <> '') and exists (select 1 from l where trim({p}) <> '')" for p in profile.PROPERTIES if p != "account_type")
_add("drift_unseen", lambda i, l: profile.unseen_values(i, l), [_FIRST, _OLD], _UNSEEN, _BOTH)
_add("drift_typo_levenshtein", lambda i, l: profile.nearest_keys(i, l).select("value", F.array_join("suggestions", ",").alias("suggestions")), [_FIRST, _OLD],
     "with!u as (select distinct account_key as value from i where account_key not in (select account_key from l)), k as (select distinct account_key as known from l), d as (select value, known, levenshtein(lower(value), lower(known)) as d from u, k), t as (select *, row_number() over (partition by value order by d, known) as r from d where d <= 3) select value, string_agg(known, ',' order by r) as suggestions from t where r <= 3 group by value", _BOTH)
_add("drift_sign_anomaly", lambda i, l: profile.sign_anomalies(i, l).select("account_key", round_to("shift", 6).alias("shift")), [_FIRST, _OLD],
     f"with!h as ({_SIGN.format('l')}), n as ({_SIGN.format('i')}) select account_key, round(abs(h.negative_ratio - n.negative_ratio) * 1000000, 0) / 1000000 as shift from h join n using (account_key) where h.negative_count + h.positive_count >= 20 and n.negative_count + n.positive_count >= 5 and abs(h.negative_ratio - n.negative_ratio) >= 0.40", _BOTH)

# SQL through the guard: the same text in both engines

_V1 = {
    "v1_transactions": f"select txn_id, import_id, account_key, posted_at, amount, currency, description, merchant, category from ({TX}) t",
    "v1_accounts": f"select account_key, account_type from ({ACCOUNTS}) a",
    "v1_imports": "select 'imp_' || cast(k * k as string) as import_id, case when k = 1 then 'reverted' else 'committed' end as status from (select distinct l_orderkey % 4 as k from lineitem) x",
}
_GUARDED = {
    "sql_join_inner": "select t.txn_id, i.status from v1_transactions t join v1_imports i on t.import_id = i.import_id",
    "sql_join_left": "select t.txn_id, i.status from v1_transactions t left join v1_imports i on t.import_id = i.import_id",
    "sql_join_right": "select i.import_id, i.status, count(t.txn_id) as n from v1_transactions t right join v1_imports i on t.import_id = i.import_id group by i.import_id, i.status",
    "sql_join_full": "select a.account_key as a, t.account_key as b, count(*) as n from v1_accounts a full join v1_transactions t on a.account_key = t.account_key group by a.account_key, t.account_key",
    "sql_join_cross": "select a.account_key, i.import_id from v1_accounts a cross join v1_imports i",
    "sql_join_using": "select account_key, count(*) as n from v1_transactions join v1_accounts using (account_key) group by account_key",
    "sql_join_theta": "select i.import_id as a, j.import_id as b from v1_imports i join v1_imports j on i.import_id < j.import_id",
    "sql_join_semi": "select account_key, account_type from v1_accounts where account_key in (select account_key from v1_transactions where amount < 0)",
    "sql_join_anti": "select account_key from v1_accounts a where not exists (select 1 from v1_transactions t where t.account_key = a.account_key)",
    "sql_exists": "select import_id from v1_imports i where exists (select 1 from v1_transactions t where t.import_id = i.import_id and t.amount > 49)",
    "sql_setop_union": "select account_key as k from v1_accounts union select account_key from v1_transactions",
    "sql_setop_union_all": "select import_id as k from v1_imports union all select import_id from v1_transactions",
    "sql_setop_intersect": "select account_key as k from v1_accounts intersect select account_key from v1_transactions",
    "sql_setop_except": "select account_key as k from v1_accounts except select account_key from v1_transactions",
    "sql_cte": "with s as (select account_key, sum(cast(amount as decimal(18,2))) as total from v1_transactions group by account_key) select account_key, cast(total as double) as total from s where total > 0",
    "sql_having": "select account_key, count(*) as n from v1_transactions group by account_key having count(*) > 100",
    "sql_distinct": "select distinct account_key, currency from v1_transactions",
    "sql_topk": "select txn_id, amount from v1_transactions order by amount desc, txn_id limit 10 offset 3",
    "sql_agg_over": "select txn_id, count(*) over (partition by account_key) as n, max(amount) over (partition by account_key) as top from v1_transactions",
    "sql_scalar_subquery": "select import_id, (select count(*) from v1_transactions t where t.import_id = i.import_id) as n from v1_imports i",
    "sql_case_functions": "select txn_id, abs(amount) as a, coalesce(merchant, 'none') as m, ifnull(category, '-') as c, nullif(currency, 'USD') as x, length(description) as n, lower(description) as l, substr(description, 1, 2) as s, round(amount, 0) as r, case when amount between 0 and 10 then 'low' else 'high' end as band from v1_transactions",
    "sql_aggregates": "select count(*) as n, min(posted_at) as lo, max(posted_at) as hi, cast(sum(cast(amount as decimal(18,2))) as double) as total, round(avg(amount), 6) as mean from v1_transactions",
}


def _guarded(sql: str) -> Query:
    return lambda spark, sf_dir: sqlguard.query(spark, {k: load(spark, sf_dir, v) for k, v in _V1.items()}, sql)


def _sql_over_views(sql: str) -> str:
    ctes = ", ".join(f"{k} as ({v})" for k, v in _V1.items())
    return f"with {ctes}, {sql.removeprefix('with ')}" if sql.startswith("with ") else f"with {ctes} {sql}"


for _name, _sql in _GUARDED.items():
    _QUERIES[_name], _SQL[_name] = _guarded(_sql), _sql_over_views(_sql)


def queries() -> dict[str, Query]:
    from coffer.plans import catalogue_import  # noqa: F401  (adds its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from coffer.plans import catalogue_import  # noqa: F401

    return dict(_SQL)
