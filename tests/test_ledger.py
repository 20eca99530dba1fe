import json

import pytest
from pyspark.sql import functions as F

from coffer.errors import CofferError
from coffer.functions.text import account_type, counterparty, effective_scale, fingerprint, normal_text, round_to, trimmed, valid_amount, valid_date
from coffer.operators import intelligence as intel
from coffer.plans import sqlguard
from coffer.plans.api import call, text_table
from coffer.plans.ledger import Ledger
from coffer.sources.readers import detect, parse, resolve, scalar_text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize("text,key", [(" café #12 ", "CAF 12"), ("--", None), ("a  b\tc", "A B C"), (None, None)])
def test_normal_text(spark, text, key):
    assert one(spark, text, normal_text) == key


@pytest.mark.parametrize("text,key", [("POS DEBIT 123 Blue Cafe 9 north side store", "BLUE CAFE NORTH SIDE"), ("ACH 44", None), ("VISA x1", "X1")])
def test_fingerprint(spark, text, key):
    assert one(spark, text, fingerprint) == key


@pytest.mark.parametrize("text,kind", [("Credit-Card", "credit_card"), ("my credit union card", "credit_card"), ("401k_retirement", "retirement"), ("credit union", None), ("auto-checking", "checking"), ("  ", None), ("studentloan x", "loan"), ("OTHER thing", "other")])
def test_account_type(spark, text, kind):
    assert one(spark, text, account_type) == kind


@pytest.mark.parametrize("text,amount,scale", [("-42.15", -42.15, 2), ("1.255", None, 3), ("12.5e1", 125.0, 0), (".5", 0.5, 1), ("1e-3", None, 3), ("1d", None, None), ("nan", None, None), ("1e999", None, 0), (" 7. ", 7.0, 0), ("1.", 1.0, 0), ("42.150", None, 3)])
def test_amount(spark, text, amount, scale):
    assert one(spark, text, valid_amount) == amount
    assert one(spark, text, effective_scale) == scale


@pytest.mark.parametrize("text,day", [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-1-02", None), ("2024-13-01", None), ("", None)])
def test_date(spark, text, day):
    assert str(one(spark, text, valid_date)) == str(day)


def test_trim_and_round(spark):
    assert one(spark, " \t a  ", trimmed) == "a"
    assert spark.range(1).select(round_to(F.lit(1.005), 2)).first()[0] == 1.0
    assert spark.createDataFrame([(None, "POS pay")], "m string, d string").select(counterparty("m", "d")["quality"]).first()[0] == 0.55


TX = "txn_id string, account_key string, posted_at string, amount double, currency string, merchant string, description string"


def tx(spark, rows):
    return spark.createDataFrame(rows, TX).withColumn("posted_at", F.col("posted_at").cast("date"))


def series(days, amount=-10.0, merchant="Shop", description="x", start=0, account="a"):
    return [(f"t{start + k:03d}", account, d, amount if not isinstance(amount, list) else amount[k], "usd", merchant, description) for k, d in enumerate(days)]


MONTHS = ["2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29"]


CASES = [
    (series(MONTHS), "monthly"), (series(["2024-01-01", "2024-01-08", "2024-01-16", "2024-01-22"]), "weekly"), (series(["2024-01-01", "2024-01-15", "2024-01-30", "2024-02-12"]), "biweekly"),
    (series(MONTHS, merchant=None, description="blue cafe"), "monthly"), (series(MONTHS, merchant=None, description="cafe"), None), (series(MONTHS[:2]), None),
    (series(MONTHS, amount=[-10.0, -90.0, -300.0, -10.0]), None), (series(["2024-01-01", "2024-01-03", "2024-02-19", "2024-02-20"]), None),
]


def test_recurring(spark):
    """Each case in an account of its own; the order of rows does not matter."""
    rows = [(f"{k}{r[0]}", f"case {k}", *r[2:]) for k, (case, _) in enumerate(CASES) for r in case]
    got = {r["account_key"]: r["cadence"] for r in intel.recurring(tx(spark, rows[::-1]).repartition(3)).collect()}
    assert got == {f"case {k}": found for k, (_, found) in enumerate(CASES) if found}


def test_recurring_separates_signs_and_currencies(spark):
    rows = series(MONTHS) + series(MONTHS, amount=10.0, start=10) + [(*r[:4], "eur", *r[5:]) for r in series(MONTHS, start=20)]
    assert intel.recurring(tx(spark, rows)).count() == 3
    assert intel.recurring(tx(spark, [])).count() == 0


def test_anomalies(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 8)]
    rows = series(days, amount=[-20.0, -21.0, -19.0, -20.0, -22.0, -20.0, -200.0]) + series(days[:5], amount=[-1.0, -1.0, -1.0, -1.0, -900.0], merchant="Few", start=50)
    got = intel.anomalies(tx(spark, rows)).collect()
    assert [(r["txn_id"], r["severity"], r["reason_code"]) for r in got] == [("t006", "high", "amount_spike")]
    assert intel.between_dates(intel.anomalies(tx(spark, rows)), "posted_at", None, "2024-01-06").count() == 0
    for bounds in (("2024-02-01", "2024-01-01"), ("2024-02-30", None), (None, "20240101")):
        with pytest.raises(CofferError):
            intel.between_dates(tx(spark, rows), "posted_at", *bounds)


@pytest.mark.parametrize("text,kind", [('[{"a":1}]', "json"), ("a,b\n1,2", "csv"), ("", None), ('{"a":1}\n{"b":2}', None), ("5", None)])
def test_detect(text, kind):
    if kind:
        assert detect(text) == kind
    else:
        with pytest.raises(CofferError):
            detect(text)


def test_sources(tmp_path):
    assert [scalar_text(x) for x in (None, "a", 42.150, 3, True, [1])] == [None, "a", "42.15", "3", "true", "[1]"]
    with pytest.raises(CofferError) as e:
        parse("account_key,zz\n1,2")
    assert e.value.code == "import_schema_mismatch" and e.value.data["unknown"] == ["zz"]
    (tmp_path / "f").write_text("x")
    with pytest.raises(CofferError):
        resolve(str(tmp_path / "f"), "also stdin")
    assert resolve("-", "body")[1] == "stdin"


def row(day, amount, description="coffee", **more):
    return {"account_key": "acct", "posted_at": day, "amount": amount, "currency": "usd", "description": description} | more


def test_import_dedupe_undo(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    a = ledger.create(stdin=json.dumps([row("2024-01-01", -5, external_id="e1", account_type="Checking"), row("2024-01-02", -6), row("2024-01-02", -6)]))
    assert (a["inserted"], a["deduped"]) == (3, 0)
    dry = ledger.create(stdin=json.dumps([row("2024-01-09", -5, account_key="acctt")]), dry_run=True)
    assert {w["code"] for w in dry["warnings"]} == {"account_key_unseen", "account_key_possible_typo"} and all("`acctt`" in w["message"] for w in dry["warnings"])
    b = ledger.create(stdin=json.dumps([row("2024-01-05", -5, external_id="e1"), row("2024-01-02", -6), row("2024-01-03", -7)]))
    assert (b["inserted"], b["deduped"]) == (1, 2)
    assert ledger.duplicates(b["import_id"]).count() == 2
    undo = ledger.undo(a["import_id"])
    assert (undo["rows_reverted"], undo["rows_promoted"]) == (3, 2)
    assert ledger.table("transactions").count() == 3
    now = ledger.duplicates(b["import_id"]).collect()
    assert all(r["matched_import_id"] == b["import_id"] and r["matched_txn_id"] != r["matched_txn_id_at_dedupe"] for r in now)
    with pytest.raises(CofferError) as e:
        ledger.undo(a["import_id"])
    assert e.value.code == "import_already_reverted"
    assert ledger.accounts()["summary"]["transaction_count"] == 3
    assert ledger.imports().count() == 2
    out = ledger.sql("select account_key, count(*) as n from v1_transactions group by account_key", 1)
    assert out["rows"] == [["acct", 3]] and not out["truncated"] and out["source"] == "inline"
    assert b["ledger_accounts"]["summary"]["transaction_count"] == 4
    assert set(ledger.schema()) == {"ledger_path", "public_views"} and ledger.schema("v1_accounts")["view_name"] == "v1_accounts"


def test_commands(spark, tmp_path):
    from coffer.plans.commands import COMMANDS, run

    ledger = Ledger(spark, str(tmp_path / "l"))
    assert run(ledger, "import list")[1].startswith("0 imports found.")
    body = json.dumps([row("2024-01-01", -5), row("2024-01-02", -6, account_type="loan")])
    assert "No rows were written" in run(ledger, "import create", stdin=body, dry_run=True)[1]
    code, out = run(ledger, "import create", as_json=True, stdin=body)
    made = json.loads(out)
    assert code == 0 and made["ok"] and made["data"]["inserted"] == 2 and made["data"]["ledger_accounts"]["rows"][0]["account_key"] == "acct"
    given = {"import duplicates": {"import_id": made["data"]["import_id"]}, "db sql": {"query": "select posted_at from v1_transactions order by 1"}}
    for name in COMMANDS:
        if name not in ("import create", "import undo"):
            code, out = run(ledger, name, as_json=name.startswith("import"), **given.get(name, {}))
            assert code == 0 and out and (not name.startswith("import") or json.loads(out) is not None)
    assert json.loads(run(ledger, "db sql", as_json=True, **given["db sql"])[1])["rows"] == [["2024-01-01"], ["2024-01-02"]]
    assert run(ledger, "import undo", import_id="nope")[0] == 1 and "import_id_not_found" in run(ledger, "import undo", as_json=True, import_id="nope")[1]
    assert run(ledger, "import undo", import_id=made["data"]["import_id"])[1].startswith("Import reverted.")
    assert run(ledger, "recurring")[1].startswith("0 recurring series found.") and run(ledger, "nope")[0] == 1


def test_validation_is_all_or_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with pytest.raises(CofferError) as e:
        ledger.create(stdin=json.dumps([row("2024-02-30", 1), row("2024-01-01", "1.234"), row("2024-01-01", 1, account_type="zz"), row("2024-01-01", 2)]))
    assert [(i["row"], i["code"]) for i in e.value.data["issues"]] == [(1, "invalid_date"), (2, "invalid_amount_scale"), (3, "invalid_account_type")]
    assert ledger.table("transactions").count() == 0 and not (tmp_path / "l" / "LOCK").exists()
    ledger.create(stdin=json.dumps([row("2024-01-01", 1, statement_id="s")]))
    assert call(ledger.create, stdin=json.dumps([row("2024-01-04", 1, statement_id="s")]))["error"]["data"]["issues"] == [{"row": 1, "code": "statement_id_reused"}]


def test_failed_publish_changes_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.create(stdin=json.dumps([row("2024-01-01", 1)]))
    monkeypatch.setattr(intel, "anomalies", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.create(stdin=json.dumps([row("2024-01-02", 1)]))
    monkeypatch.undo()
    assert ledger.table("transactions").count() == 1
    assert ledger.refresh() == {"recurring": 0, "anomalies": 0}


@pytest.mark.parametrize("sql", ["select 1", "select count(*) from v1_accounts", "with a as (select * from v1_imports) select * from a", "select * from v1_transactions where description like 'a%'"])
def test_guard_allows(spark, sql):
    sqlguard.guard(spark, sql)


def test_imports_append_and_parts_are_put_together(spark, tmp_path, monkeypatch):
    from coffer.plans import ledger as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    ledger = Ledger(spark, str(tmp_path / "l"))
    sizes = []
    for k in range(4):
        ledger.create(stdin=json.dumps([row(f"2024-01-0{k + 1}", k + 1)]))
        sizes.append(len(json.loads((tmp_path / "l" / "CURRENT").read_text())["transactions"]))
    assert sizes == [1, 2, 1, 2] and ledger.table("transactions").count() == 4 and ledger.imports().count() == 4


def test_lock_is_respected_and_taken_over_when_stale(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with ledger.files.lock() as owner:
        with pytest.raises(CofferError) as e:
            ledger.refresh()
        assert e.value.code == "ledger_locked"
        ledger.files.replace("LOCK", json.dumps({"owner": "gone", "time": 0}))
        with pytest.raises(CofferError):
            ledger.files.check(owner)
    assert ledger.refresh()["anomalies"] == 0 and not (tmp_path / "l" / "LOCK").exists()
    (tmp_path / "l" / "CURRENT").write_text("{")
    with pytest.raises(CofferError) as e:
        ledger.table("accounts")
    assert e.value.code == "ledger_corrupt"


def test_backfill_from_history(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    a = ledger.create(stdin=json.dumps([row("2024-01-01", 1, external_id="x", account_type="loan"), row("2024-01-02", 2, account_key="other")]))
    ledger.create(stdin=json.dumps([row("2024-01-01", 1, external_id="x"), row("2024-01-03", 3)]))
    before = [sorted(map(tuple, ledger.table(t).collect())) for t in ("accounts", "stats")]
    pointer = json.loads((tmp_path / "l" / "CURRENT").read_text())
    (tmp_path / "l" / ".CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "l" / "CURRENT").write_text(json.dumps({k: v for k, v in pointer.items() if k not in ("accounts", "stats")}))
    assert ledger.backfill() == {"accounts": 2, "stats": 3}
    assert sorted(map(tuple, ledger.table("stats").collect())) == before[1]
    assert sorted(r["account_key"] for r in ledger.table("accounts").collect()) == ["acct", "other"] and a["inserted"] == 2


def run_sql(spark, text):
    views = {"v1_accounts": spark.createDataFrame([("a", 1.5, True), ("b", None, False)], "account_key string, amount double, flag boolean")}
    return sqlguard.rows(sqlguard.query(spark, views, text))


def test_sql_sources(tmp_path):
    (tmp_path / "q.sql").write_text("select 1 as one")
    assert sqlguard.resolve_sql(file=str(tmp_path / "q.sql")) == ("select 1 as one", "file")
    assert sqlguard.resolve_sql(file="-", stdin="select 2") == ("select 2", "stdin") and sqlguard.resolve_sql("x") == ("x", "inline")
    for given in ({}, {"text": "select 1", "file": "q.sql"}, {"file": str(tmp_path / "none.sql")}):
        with pytest.raises(CofferError) as e:
            sqlguard.resolve_sql(**given)
        assert e.value.code == "invalid_argument"


@pytest.mark.parametrize("sql,part", [("select nope from v1_accounts", "could not be executed"), ("select 1; select 2;", "single statement"), ("update x set a = 1", ""), ("select 1 / account_key from v1_accounts", "could not be executed"),
                                      ("select sqlite_version()", ""), ("select load_extension('x')", ""), ("select ?1", ""), ("selec 1", ""), ("select date(account_key, '+1 eon') from v1_accounts", "modifier")])
def test_sql_errors_are_invalid_argument(spark, sql, part):
    with pytest.raises(CofferError) as e:
        run_sql(spark, sql)
    assert e.value.code == "invalid_argument" and part in e.value.message


def test_sql_columns_follow_the_values(spark):
    out = run_sql(spark, "select account_key, amount, null as nothing, flag, count(*) over () as n from v1_accounts;")
    assert [(c["type"], c["nullable"]) for c in out["columns"]] == [("text", False), ("real", True), ("null", True), ("integer", False), ("integer", False)]
    assert run_sql(spark, "select account_key from v1_accounts where account_key = 'z'")["columns"] == [{"name": "account_key", "type": "unknown", "nullable": False}]
    with pytest.raises(CofferError):
        sqlguard.rows(spark.range(1), 0)
    assert "v1_accounts" not in [t.name for t in spark.catalog.listTables()]


SCALARS = [
    ("substr('hello', 0, 3)", "he"), ("substr('hello', -3, 2)", "ll"), ("substr('hello', 4, -2)", "el"), ("substr('hello', -9, 6)", "he"), ("substr('hello', 9)", ""), ("min(3, 1, 2)", 1), ("max('a', null)", None), ("round(1.005, 2)", 1.01),
    ("round(-2.5)", -3.0), ("lower('ÀBC')", "Àbc"), ("date('2024-01-31', '+1 month')", "2024-03-02"), ("date('2024-02-29', '-1 year')", "2023-03-01"), ("datetime('2024-01-01 10:00', '-1 day', '+30 seconds')", "2023-12-31 10:00:30"),
    ("strftime('%Y/%m/%d %H:%M:%S %j %w %%', '2024-02-01 03:04:05')", "2024/02/01 03:04:05 032 4 %"), ("strftime('%s', '1970-01-02')", "86400"), ("date('nonsense')", None), ("date(0, 'unixepoch')", "1970-01-01"), ("date('2024-05-15', 'weekday 1')", "2024-05-20"),
    ("printf('%-4s|%4d|%.1f|%x', 'ab', 7, 2.25, 255)", "ab  |   7|2.3|ff"), ("printf('%s%d', null, null)", "0"), ("'it''s \n'", "it's \n"), ("length(12345)", 5), ('"account_key"', "a"), ("ifnull(null, 'x') || nullif('y', 'z')", "xy"), ("date(2451545.0)", "2000-01-01"),
]


def test_sql_scalars(spark):
    out = run_sql(spark, "select " + ", ".join(f"{x} as c{k}" for k, (x, _) in enumerate(SCALARS)) + " from v1_accounts where account_key = 'a' -- a remark; with 'signs'")
    assert out["rows"] == [[v for _, v in SCALARS]]


@pytest.mark.parametrize("sql", ["", "select to_date('2024-01-01')", "select greatest(1, 2)", "select current_date", "select position('a' in 'b')", "select date_format('x', 'y')", "select coffer_lower('A')", "select * from internal_x", "select * from parquet.`/x`", "drop view v1_accounts", "show tables", "explain select 1", "select 1; select 2", "select upper('a')", "select ?", "insert into v1_accounts values (1)",
                                 "select * from v1_accounts where account_key in (select a from other)", "select rank() over (order by 1) from v1_accounts", "select * from range(5)"])
def test_guard_denies(spark, sql):
    with pytest.raises(CofferError):
        sqlguard.guard(spark, sql)


def test_stream_ingest(spark, tmp_path):
    from coffer.sources.readers import SCHEMA, parse
    from coffer.streaming.ingest import start

    rows = parse(json.dumps([row("2024-01-01", 1, external_id="e"), row("2024-01-02", 2)]))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "l"))
    start(ledger, str(tmp_path / "in"), str(tmp_path / "c")).awaitTermination()
    assert ledger.table("transactions").count() == 2
    (tmp_path / "c" / "commits" / "0").unlink()  # as if the stream had died before it noted the batch
    (tmp_path / "c" / "commits" / ".0.crc").unlink(missing_ok=True)
    start(ledger, str(tmp_path / "in"), str(tmp_path / "c")).awaitTermination()
    assert ledger.table("transactions").count() == 2 and ledger.imports().count() == 1


def test_text_table():
    assert text_table(["a", "b"], [[1, None]]) == "a  b\n1"
    assert "a: 1" in text_table(["a", "b"], [[1, "x" * 200]])
