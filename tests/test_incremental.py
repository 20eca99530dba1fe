"""Detectors of touched buckets and undo without rewriting, against detectors over the whole ledger."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coffer.operators import intelligence as intel
from coffer.plans import ledger as module
from coffer.plans.ledger import TABLES, Ledger


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Plans over a few rows take longer to compile than to run."""
    conf = {"spark.sql.codegen.wholeStage": ("false", "true"), "spark.sql.codegen.factoryMode": ("NO_CODEGEN", "FALLBACK")}
    for k, (v, _) in conf.items():
        spark.conf.set(k, v)
    yield
    for k, (_, v) in conf.items():
        spark.conf.set(k, v)


def rows_of(df, name):
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    return sorted(map(str, df.select(*columns).collect()))


def agree(ledger):
    """The stored results are those of a full run over the transactions."""
    t = ledger.table("transactions")
    for name, detect in (("recurring", intel.recurring), ("anomalies", intel.anomalies)):
        assert rows_of(ledger.table(name), name) == rows_of(detect(t), name), name


def some_rows(rng, who):
    """A series of a merchant, now and then with a spike, and rows that the detectors leave out."""
    start, gap = rng.randrange(1, 20), rng.choice([7, 14])
    out = []
    for k in range(rng.randrange(2, 9)):
        month, day = divmod(start + gap * k, 28)
        amount = -rng.choice([20, 21, 20.5]) * (9 if rng.random() < 0.15 else 1)
        out.append({"account_key": f"a{who % 3}", "posted_at": f"2024-{month % 12 + 1:02d}-{day + 1:02d}", "amount": amount, "currency": "USD", "description": f"Shop number{chr(97 + who)}", "merchant": f"Shop {chr(97 + who)}"})
    return out + [{"account_key": "zero", "posted_at": "2030-01-01", "amount": 0, "currency": "USD", "description": f"nothing {rng.random()}"}]


def parts(root, name):
    return json.loads((root / "CURRENT").read_text())[name]


def test_random_imports_and_undos_equal_full_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_OF_BUCKET", 2)
    monkeypatch.setattr(module, "MOST_PARTS", 4)
    rng, root = random.Random(1), tmp_path / "l"
    ledger = Ledger(spark, str(root), buckets=4)
    live, held = [], {}
    for _ in range(12):
        if live and rng.random() < 0.35:
            x = live.pop(rng.randrange(len(live)))
            ledger.undo(x)
        else:
            rows = [r for _ in range(2) for r in some_rows(rng, rng.randrange(6))]
            if held and rng.random() < 0.5:  # repeats another import, so that an undo of that promotes rows
                rows += rng.choice(list(held.values()))
            x = ledger.create(stdin=json.dumps(rows))["import_id"]
            held[x] = rows
            live.append(x)
        agree(ledger)
    assert ledger.table("recurring").count() + ledger.table("anomalies").count() > 0
    before = {t: sorted(map(str, ledger.table(t).collect())) for t in TABLES}
    ledger.vacuum(0)
    assert {t: sorted(map(str, ledger.table(t).collect())) for t in TABLES} == before
    ledger.refresh()
    assert {t: sorted(map(str, ledger.table(t).collect())) for t in TABLES} == before
    assert json.loads((root / parts(root, "state")[0]).read_text())["reverted"] == []


def test_a_commit_touches_the_buckets_of_its_rows(spark, tmp_path):
    rng, root = random.Random(3), tmp_path / "l"
    ledger = Ledger(spark, str(root))
    ledger.create(stdin=json.dumps([r for who in range(20) for r in some_rows(rng, who)]))
    agree(ledger)
    before = {name: set(parts(root, name)) for name in module.BUCKETED}
    ledger.create(stdin=json.dumps(some_rows(rng, 5)[:-1]))
    agree(ledger)
    came = set(parts(root, "grouped")) - before["grouped"]
    assert len(came) == 1 and before["grouped"] < set(parts(root, "grouped"))
    touched = {module.bucket_of(p) for p in came}
    for name in ("recurring", "anomalies"):
        assert {module.bucket_of(p) for p in before[name] ^ set(parts(root, name))} <= touched


def test_undo_writes_only_promoted_transactions(spark, tmp_path):
    rng, root = random.Random(4), tmp_path / "l"
    ledger = Ledger(spark, str(root), buckets=8)
    rows = some_rows(rng, 1)
    first = ledger.create(stdin=json.dumps([r for who in range(12) for r in some_rows(rng, who)] + rows))["import_id"]
    ledger.create(stdin=json.dumps(some_rows(rng, 2) + rows[:3]))
    size = lambda: sum(f.stat().st_size for p in parts(root, "transactions") for f in Path(root / p).glob("*.parquet"))
    old, n, bytes_ = parts(root, "transactions"), ledger.table("transactions").count(), size()
    got = ledger.undo(first)
    assert parts(root, "transactions")[:-1] == old and got["rows_reverted"] > 30 and 0 < got["rows_promoted"] <= 3
    assert size() - bytes_ < bytes_ and ledger.table("transactions").count() == n - got["rows_reverted"] + got["rows_promoted"]
    assert spark.read.parquet(str(root / parts(root, "transactions")[-1])).count() == got["rows_promoted"]
    assert ledger.table("transactions").where(F.col("import_id") == first).isEmpty()
    agree(ledger)


def test_a_ledger_without_buckets_gets_them_at_its_next_commit(spark, tmp_path):
    """As an earlier version left it: results in one folder each, with is_active, and no state."""
    rng, root = random.Random(5), tmp_path / "l"
    ledger = Ledger(spark, str(root), buckets=8)
    ledger.create(stdin=json.dumps([r for who in range(6) for r in some_rows(rng, who)]))
    pointer = json.loads((root / "CURRENT").read_text())
    for name in ("recurring", "anomalies"):
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        ledger.table(name).select(*columns).write.parquet(str(root / "v1" / name))
        pointer[name] = [f"v1/{name}"]
    ledger.files.replace("CURRENT", json.dumps({k: v for k, v in pointer.items() if k not in ("state", "grouped")}))
    agree(ledger)
    ledger.create(stdin=json.dumps(some_rows(rng, 1)))
    agree(ledger)
    assert all("/bucket=" in p for name in module.BUCKETED for p in parts(root, name))
