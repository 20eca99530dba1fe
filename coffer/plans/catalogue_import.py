"""Further queries over the import's operators and the SQL surface, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions.text import round_to, trimmed
from coffer.operators import importing as imp
from coffer.operators import intelligence as intel
from coffer.operators import profile
from coffer.plans.catalogue import _BOTH, _CAND2, _FIRST, _K, _OLD, _RAW, _RECUR, _QUERIES, _SQL, _W, ACCOUNTS, TX, _add, _guarded, _sql_over_views
from coffer.plans.ledger import PREVIEW

# Validation

_SPACED = "select p_partkey as id, case p_partkey % 4 when 0 then '  ' || p_name || chr(9) when 1 then chr(10) || ' ' when 2 then p_name else null end as t from part"
_add("trim_optional", lambda t: t.select("id", trimmed("t").alias("t")), [_SPACED], r"select id, nullif(regexp_replace(t, '^\s+|\s+$', '', 'g'), '') as t from t", {"t": _SPACED})
_add("currency_upper", lambda t: imp.checked(t).select("row", "currency"), [_RAW], "select row, upper(trim(currency)) as currency from r", {"r": _RAW})
_CLEAN = """ok as (select * from r where trim(account_key) <> '' and posted_at <> '2024-02-31' and amount = '10.5' and description is not null and coalesce(account_type, '') <> 'zzz')"""
_add(
    "dedupe_scope", lambda t: imp.validate(t, "imp_x")[0].select("row", "dedupe_scope_id"), [_RAW],
    f"with!{_CLEAN} select row, case when statement_id is not null then 'stmt|' || trim(account_key) || '|' || statement_id else 'gen|imp_x|' || trim(account_key) end as dedupe_scope_id from ok", {"r": _RAW},
)
_add("rejected_rows", lambda t: imp.checked(t).select("row", F.explode("issues")).agg(F.count_distinct("row").alias("rows_invalid")), [_RAW], f"with!{_CLEAN} select (select count(*) from r) - (select count(*) from ok) as rows_invalid", {"r": _RAW})


# Import

def _stages(i: DataFrame, l: DataFrame) -> DataFrame:  # noqa: E741
    batch = imp.batch_duplicates(i)
    matched = imp.ledger_matches(batch.where("matched_row is null"), l)
    stage = F.when(F.col("matched_txn_id").isNull(), "accepted").otherwise("existing_ledger")
    return batch.where("matched_row is not null").select("row", F.lit("batch").alias("stage")).unionByName(matched.select("row", stage.alias("stage")))


_DUPLICATE = f"""b as (select row, min(row) over (partition by account_key, external_id) <> row as dup from i where external_id is not null
      union all select row, dedupe_scope_id <> first_value(dedupe_scope_id) over (partition by {_K} order by row) from i where external_id is null),
    m as (select distinct i.row from i join l using (account_key, external_id) where i.external_id is not null
      union select i.row from i join l using ({_K}) where i.external_id is null and i.dedupe_scope_id <> l.dedupe_scope_id),
    st as (select row, case when dup then 'batch' when row in (select row from m) then 'existing_ledger' else 'accepted' end as stage from b)"""
_add("stage_split", _stages, [_FIRST, _OLD], f"with!{_DUPLICATE} select row, stage from st", _BOTH)
_add(
    "duplicates_preview", lambda i, l: _stages(i, l).where("stage <> 'accepted'").orderBy("row").limit(PREVIEW), [_FIRST, _OLD],
    f"with!{_DUPLICATE} select row, stage from st where stage <> 'accepted' order by row limit {PREVIEW}", _BOTH,
)


def _counters(i: DataFrame, l: DataFrame) -> DataFrame:  # noqa: E741
    accepted = _stages(i, l).where("stage = 'accepted'")
    return imp.account_counters(i, i.join(accepted.select("row"), "row", "left_semi"))


_add(
    "import_account_counters", _counters, [_FIRST, _OLD],
    f"""with!{_DUPLICATE} select account_key, count(*) as rows_read, count(*) filter (where stage = 'accepted') as inserted, count(*) filter (where stage <> 'accepted') as deduped
    from i join st using (row) group by account_key""", _BOTH,
)
_HISTORY = """h as (select import_id, account_key, count(*) as rows_read, cast(sum(i) as bigint) as inserted, cast(count(*) - sum(i) as bigint) as deduped
    from (select import_id, account_key, 1 as i from l union all select import_id, account_key, 0 from c) group by 1, 2)"""
_C = {"c": _CAND2, "l": _OLD}
_add("history_stats", lambda c, l: imp.history_stats(l, c), [_CAND2, _OLD], f"with!{_HISTORY} select * from h", _C)
_add("history_accounts", lambda l: imp.accounts_of(l, "7"), [_OLD], "select distinct account_key, cast(null as varchar) as account_type, '7' as created_at, '7' as updated_at from l where trim(account_key) <> ''", {"l": _OLD})
_add(
    "import_account_stats", lambda c, l, a: profile.import_accounts(imp.history_stats(l, c), a).select("import_id", F.explode("accounts").alias("x")).select("import_id", "x.*"), [_CAND2, _OLD, ACCOUNTS],
    f"with!{_HISTORY} select import_id, account_key, account_type, rows_read, inserted, deduped from h left join a using (account_key)", _C | {"a": ACCOUNTS},
)
_HELD = "select account_key, case when account_key = 'acct-3' then ' ' else account_type end as account_type, '1' as created_at, '2' as updated_at from (" + ACCOUNTS + ") x"
_add(
    "accounts_upsert", lambda h, i: imp.upsert_accounts(h, i, "9"), [_HELD, _FIRST],
    """with!n as (select account_key, arg_min(account_type, row) filter (where account_type is not null) as t from i group by 1)
    select account_key, coalesce(nullif(trim(account_type), ''), t) as account_type, coalesce(created_at, '9') as created_at, case when n.account_key is not null then '9' else updated_at end as updated_at
    from h full join n using (account_key)""".replace("n.account_key is not null", "account_key in (select account_key from n)"), {"h": _HELD, "i": _FIRST},
)
_RUNS = "select 'imp_' || cast(k as string) as import_id, case when k % 3 = 0 then 'committed' else 'reverted' end as status, cast(k * 7 % 5 as string) as created_at from (select distinct l_orderkey % 12 as k from lineitem) x"
_add(
    "candidates_committed", lambda c, r: imp.open_candidates(c, r).select("candidate_id"), [_CAND2, _RUNS],
    "select candidate_id from c where promoted_txn_id is null and import_id in (select import_id from r where status = 'committed')", {"c": _CAND2, "r": _RUNS},
)
_add("imports_newest", lambda r: r.orderBy(F.col("created_at").try_cast("long").desc(), F.desc("import_id")).limit(5), [_RUNS], "select * from r order by cast(created_at as bigint) desc, import_id desc limit 5", {"r": _RUNS})


def _warnings(i: DataFrame, l: DataFrame) -> DataFrame:  # noqa: E741
    found = profile.drift_warnings(i, l)
    rank = F.when(F.col("severity") == "high", 0).otherwise(1).alias("rank")
    return profile.order_warnings(found).select(rank, "code", "severity", "property", "incoming_value", "message", F.array_join("suggestions", ",").alias("suggestions"))


_UNSEEN = " union ".join(
    f"select '{p}' as property, {p} as value from i where trim({p}) <> '' and {p} not in (select {p} from l where trim({p}) <> '') and exists (select 1 from l where trim({p}) <> '')"
    for p in ("account_key", "currency", "merchant", "category")
)
_RATIO = "select account_key, count(*) filter (where amount < 0) / nullif(count(*) filter (where amount <> 0), 0) as x, count(*) filter (where amount <> 0) as n from {0} group by 1"
_add(
    "drift_warnings", _warnings, [_FIRST, _OLD],
    f"""with!u as ({_UNSEEN}), a as (select distinct account_key as value from i where account_key not in (select account_key from l)),
    d as (select value, known, levenshtein(lower(value), lower(known)) as d from a, (select distinct account_key as known from l)),
    t as (select *, row_number() over (partition by value order by d, known) as r from d where d <= 3),
    s as (select account_key, h.x as old, j.x as new, abs(h.x - j.x) as shift from ({_RATIO.format("l")}) h join ({_RATIO.format("i")}) j using (account_key) where h.n >= 20 and j.n >= 5 and abs(h.x - j.x) >= 0.40)
    select cast(case when property = 'account_key' then 0 else 1 end as integer) as rank, property || '_unseen' as code, case when property = 'account_key' then 'high' else 'medium' end as severity, property, value as incoming_value,
           'The ledger has no ' || property || ' `' || value || '` yet.' as message, '' as suggestions from u
    union all select 0, 'account_key_possible_typo', 'high', 'account_key', value, 'The account_key `' || value || '` is close to one that the ledger has.', string_agg(known, ',' order by r) from t where r <= 3 group by value
    union all select 0, 'account_sign_profile_anomaly', 'high', 'account_key', account_key, printf('The share of negative amounts of `%s` moves by %.2f points, from %.2f to %.2f percent.', account_key, shift * 100, old * 100, new * 100), '' from s""", _BOTH,
)
_add(
    "recurring_between", lambda t: intel.between_dates(intel.recurring(t).select(*intel.RECURRING_COLUMNS), "last_seen_at", "1998-06-01", None).select("group_key", "last_seen_at", round_to("score", 4).alias("score")), [_W],
    _RECUR + " select group_key, last_seen_at, score from z where last_seen_at >= date '1998-06-01'", {"tx": _W},
)

# Functions of the SQL surface, and what the same rows are in the other engine's words

_DIALECT = {
    "sql_join_natural": ("select account_key, account_type, count(*) as n from v1_transactions natural join v1_accounts group by account_key, account_type",) * 2,
    "sql_date_functions": (
        """select txn_id, date(posted_at) as d, date(posted_at, '+1 month') as next_month, date(posted_at, 'start of month', '+1 month', '-1 day') as month_end, datetime(posted_at, '+90 minutes') as later,
           strftime('%Y-%m', posted_at) as month, strftime('%j/%w', posted_at) as day_of, date(posted_at, 'weekday 0') as sunday from v1_transactions""",
        """select txn_id, strftime(posted_at, '%Y-%m-%d') as d, strftime(cast(date_trunc('month', posted_at) as date) + interval 1 month + to_days(cast(day(posted_at) - 1 as integer)), '%Y-%m-%d') as next_month,
           strftime(last_day(posted_at), '%Y-%m-%d') as month_end, strftime(cast(posted_at as timestamp) + interval 90 minute, '%Y-%m-%d %H:%M:%S') as later, strftime(posted_at, '%Y-%m') as month,
           strftime(posted_at, '%j') || '/' || cast(dayofweek(posted_at) as varchar) as day_of, strftime(posted_at + to_days(cast((7 - dayofweek(posted_at)) % 7 as integer)), '%Y-%m-%d') as sunday from v1_transactions""",
    ),
    "sql_scalar_functions": (
        """select txn_id, min(amount, 10) as lo, max(amount, 0, 5) as hi, max(merchant, 'm') as word, substr(description, 0, 2) as a, substr(description, -1) as b, substr(description, 3, -2) as c, substr(description, 2) as e,
           printf('%05d|%.2f|%s', amount, amount, merchant) as p, round(amount / 3.0, 2) as r, "account_key" as k, 'it''s' as q from v1_transactions""",
        """select txn_id, least(amount, 10) as lo, greatest(amount, 0, 5) as hi, case when merchant is null then null else greatest(merchant, 'm') end as word, substr(description, 1, 1) as a, right(description, 1) as b, substr(description, 1, 2) as c,
           substr(description, 2) as e, printf('%05d|%.2f|%s', cast(amount as bigint), amount, coalesce(merchant, '')) as p, round(amount / 3.0 * 100, 0) / 100 as r, account_key as k, 'it''s' as q from v1_transactions""",
    ),
    "sql_integer_division": (
        "select account_key, count(*)/2 as half, -count(*)/7 as below, count(*) % 10 as rest, count(*)/3/2 as twice, count(*)/(5/2) as nested, count(*)/2.0 as exact from v1_transactions group by account_key having count(*)/4 > 1",
        """select account_key, count(*) // 2 as half, -(count(*) // 7) as below, count(*) % 10 as rest, count(*) // 3 // 2 as twice, count(*) // 2 as nested, cast(count(*) as double) / 2 as exact
           from v1_transactions group by account_key having count(*) // 4 > 1""",
    ),
    "sql_null_arithmetic": (
        "select txn_id, amount/0 as a, length(description) % 0 as b, coalesce(length(description)/(length(account_key) - length(account_key)), -1) as c, amount/nullif(amount, amount) as d, abs(amount/2) as e from v1_transactions",
        "select txn_id, cast(null as double) as a, cast(null as integer) as b, cast(-1 as bigint) as c, cast(null as double) as d, abs(amount / 2) as e from v1_transactions",
    ),
    "sql_affinity": (
        """select txn_id, cast(amount as integer) as whole, cast(amount as integer)/2 as half, cast('12abc' as integer) + length(account_key) as n, cast(length(description) as real)/2 as x, cast(length(account_key) as text) || '!' as t
           from v1_transactions where merchant is not 'none' and not (posted_at isnull)""",
        """select txn_id, cast(trunc(amount) as bigint) as whole, cast(trunc(amount) as bigint) // 2 as half, cast(12 + length(account_key) as bigint) as n, cast(length(description) as double) / 2 as x, cast(length(account_key) as varchar) || '!' as t
           from v1_transactions where merchant is distinct from 'none' and posted_at is not null""",
    ),
}
for _name, (_text, _other) in _DIALECT.items():
    _QUERIES[_name] = _guarded(_text)
    _SQL[_name] = _sql_over_views(_other)
