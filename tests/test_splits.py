"""The scan of import files in byte ranges against the parse in one piece."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest

from coffer.errors import CofferError
from coffer.plans.ledger import Ledger
from coffer.sources import splits
from coffer.sources.contract import FIELDS
from coffer.sources.readers import parse

HEAD = "account_key,posted_at,amount,currency,description"


def outcome(read):
    try:
        return sorted(tuple(r) for r in read())
    except CofferError as e:
        return e.code, e.message


def scanned_by_hand(content: str, cuts: list[int]):
    """``splits`` without Spark: pieces dealt to the ranges that begin at the given bytes."""
    raw = content.encode()
    head = content.lstrip()[:200]
    kind = splits.detect_head(head)
    parse_one, base = splits._parse_json, 1
    if kind == "csv":
        headers = splits._first_header(head)
        parse_one, base = splits._parse_csv(headers), 0
    blocks, at = {}, 0
    pieces = raw.split(splits.END[kind].encode())
    for piece in pieces[:-1] + [pieces[-1]] * bool(pieces[-1]):
        blocks.setdefault(max(c for c in cuts if c <= at), []).append(piece)
        at += len(piece) + 1
    table = lambda rows, names: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    summaries = []
    for block, rows in blocks.items():
        for b in splits._summaries(kind)(iter([table([(block, p) for p in rows], ["block", "piece"])])):
            summaries += [tuple(r.values()) for r in b.to_pylist()]
    states, total = splits.compose(kind, summaries)
    names, out = [x.split()[0] for x in splits._STATES.split(", ")], []
    for state in states:
        rows = [(state[0], p, *state[1:]) for p in blocks[state[0]]]
        for b in splits._records(kind, base, total, parse_one)(iter([table(rows, ["block", "piece", *names[1:]])])):
            out += b.to_pylist()
    parts = {}
    for r in sorted((r for r in out if r["part"] is not None), key=lambda r: r["block"]):
        parts[r["row"]] = parts.get(r["row"], "") + r["part"]
    out = [r for r in out if r["part"] is None]
    joined = table(list(parts.items()), ["row", "text"]) if parts else None
    for b in splits._joined(base, total, parse_one)(iter([joined] if parts else [])):
        out += b.to_pylist()
    bad = min(((r["rank"], r["row"], r["problem"]) for r in out if r["rank"] is not None), default=None)
    if kind == "json" and splits.ends_with_piece(summaries, raw[-1:], "}"):
        raise CofferError("invalid_argument", splits._NO_JSON[2])
    if bad:
        raise CofferError("invalid_argument", bad[2])
    return [(r["row"], *[r[c] for c in FIELDS]) for r in out]


def cuts_of(rng, content):
    size = len(content.encode())
    return sorted({0, *(rng.randrange(size) for _ in range(rng.randrange(1, 12)))})


def random_csv(rng):
    text = io.StringIO()
    pieces = ["a", "é日", '"', ",", "\n", "\r\n", " ", '""', "x" * 20, ""]
    for _ in range(rng.randrange(0, 8)):
        fields = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 5))) for _ in range(5)]
        csv.writer(text, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])).writerow(fields)
        text.write(rng.choice(["", "", "\n", "\r\n"]))
    return rng.choice(["", "\n \n", "  "]) + HEAD + "\n" + text.getvalue() + rng.choice(["", "\n \n\t\n"])


def random_json(rng):
    def value(depth):
        kinds = ["s", "n", "t", "f", "0"] + ["o", "l"] * (depth < 3)
        k = rng.choice(kinds)
        if k == "s":
            return "".join(rng.choice(['"', "}", "{", "]", "[", "\\", ",", "é", "\n", "a"]) for _ in range(rng.randrange(0, 6)))
        if k in "ol":
            items = [value(depth + 1) for _ in range(rng.randrange(0, 3))]
            return items if k == "l" else {f"k{j}}}": x for j, x in enumerate(items)}
        return {"n": rng.random() * 100, "t": True, "f": None, "0": rng.randrange(10**6)}[k]

    items = [{c: value(0) for c in rng.sample(FIELDS, 5)} for _ in range(rng.randrange(0, 6))]
    return rng.choice(["", " \n"]) + json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"])


def damaged(rng, content):
    at = rng.randrange(len(content))
    return content[:at] + rng.choice(["", '"', "}", "{", "]", ",", "\\", "\n", "x", ",5"]) + content[at + rng.randrange(0, 2) :]


@pytest.mark.parametrize("make", [random_csv, random_json])
def test_ranges_equal_one_piece(make):
    rng = random.Random(11)
    for _ in range(1500):
        content = make(rng)
        assert outcome(lambda c=content: scanned_by_hand(c, cuts_of(rng, c))) == outcome(lambda c=content: parse(c)), content


@pytest.mark.parametrize("make", [random_csv, random_json])
def test_damaged_files_fail_alike(make):
    """A damaged file fails in both ways or in none, with the same message."""
    rng, failed = random.Random(12), 0
    for _ in range(3000):
        content = damaged(rng, make(rng))
        if not content.strip() or not content.lstrip().startswith(("[", HEAD + "\n")):
            continue
        want = outcome(lambda c=content: parse(c))
        assert outcome(lambda c=content: scanned_by_hand(c, cuts_of(rng, c))) == want, content
        failed += bool(want) and want[0] == "invalid_argument"
    assert failed > 300


def quoted_rows(n):
    text = io.StringIO()
    text.write("\n" + HEAD + ",external_id\n")
    out = csv.writer(text)
    for k in range(n):
        out.writerow(["acct", "2024-01-%02d" % (1 + k % 28), f"{k}.25", "USD", f'a "quoted"\nline {k}, é' + "x" * (k % 90), f"e{k}"])
    return text.getvalue()


@pytest.fixture
def narrow(spark):
    """Ranges of some hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "701b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def scan(spark, tmp_path, content, name="in"):
    place = tmp_path / name
    place.write_bytes(content if isinstance(content, bytes) else content.encode())

    def stage(df, label):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{label}"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / f"{name}-{label}"))

    return outcome(lambda: splits.scan(spark, place.as_uri(), stage).collect())


def test_scan_by_spark(narrow, tmp_path):
    for k, content in enumerate([
        quoted_rows(25), json.dumps([{"account_key": "a{}", "amount": j / 4, "description": '}"\\' * (j % 5), "currency": {"x": [{}]}} for j in range(40)]), "[]", " [ ] \n", HEAD + "\n",
        HEAD + ',zz\n"' + "x" * 300, HEAD + ",zz\n1,2,3,4,5,6\n", quoted_rows(9) + "short,row\n", "[1, 2]", "[] }", "[] } \n", '[{"account_key": "a"}', '[{"a": 1}, 5]', '{"a": 1,\n"b": 2}', '{"a": 1}\n{"a": 2}\n', "x\ny\n", " \n" * 70000,
    ]):
        assert scan(narrow, tmp_path, content, f"in{k}") == outcome(lambda c=content: parse(c)), content[:80]
    code, message = scan(narrow, tmp_path, HEAD.encode() + b"\na,b,c,d,\xff\n", "bytes")
    assert code == "invalid_argument" and "not UTF-8" in message


def test_import_of_a_file_in_ranges(narrow, tmp_path):
    place = tmp_path / "big.csv"
    place.write_text(quoted_rows(30))
    ledger = Ledger(narrow, f"file://{tmp_path}/ledger")
    got = ledger.create(path=place.as_uri())
    assert (got["rows_read"], got["inserted"]) == (30, 30)
    run = ledger.table("import_runs").first()
    assert (run["source_kind"], run["source_ref"]) == ("file", place.as_uri()) and not (tmp_path / "ledger" / "staging" / got["import_id"]).exists()
    txn = {r["external_id"]: r["description"] for r in ledger.table("transactions").collect()}
    assert len(txn) == 30 and '"quoted"' in txn["e7"] and "line 7, é" in txn["e7"]
    with pytest.raises(CofferError, match="no such file"):
        ledger.create(path=f"file://{tmp_path}/absent.csv")


def test_issues_of_a_large_rejected_import_stay_in_a_table(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    columns = "'acct' as account_key, '2024-02-30' as posted_at, '1.234' as amount, 'USD' as currency, 'x' as description"
    with pytest.raises(CofferError) as e:
        ledger.create(df=spark.range(1, 3001).selectExpr("id as row", *columns.split(", ")))
    data = e.value.data
    assert (data["issues_total"], data["rows_invalid"], data["issues_by_code"]) == (6000, 3000, {"invalid_amount_scale": 3000, "invalid_date": 3000})
    assert len(data["issues"]) == 1000 and data["issues_truncated"] and data["issues"] == sorted(data["issues"], key=lambda r: (r["row"], r["field"]))
    kept = ledger.issues(data["rejected_import"])
    assert kept.count() == 6000 and kept.where("row = 3000").count() == 2
    assert ledger.forget_issues(3600) == 0 and ledger.forget_issues(0) == 1
    with pytest.raises(CofferError, match="No rejected import"):
        ledger.issues(data["rejected_import"])
    assert ledger.table("transactions").count() == 0 and not (tmp_path / "ledger" / "staging").exists() or not list((tmp_path / "ledger" / "staging").iterdir())


def test_vacuum_keeps_what_the_current_state_names(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    row = lambda k: {"account_key": "a", "posted_at": f"2024-01-0{k}", "amount": k, "currency": "USD", "description": f"d{k}"}
    first = ledger.create(stdin=json.dumps([row(1), row(2)]))
    ledger.create(stdin=json.dumps([row(2), row(3)]))
    ledger.undo(first["import_id"])
    (tmp_path / "ledger" / "staging" / "imp_00000000000000000001").mkdir(parents=True)
    tables = ["transactions", "accounts", "import_runs", "stats", "candidates", "recurring", "anomalies"]
    state = lambda: {t: sorted(map(str, ledger.table(t).collect())) for t in tables}
    before = state()
    assert ledger.vacuum() == {"folders": 1, "bytes": 0}  # only the dead writer's is that old
    gone = ledger.vacuum(0)
    assert gone["folders"] >= 6 and gone["bytes"] > 0 and state() == before and ledger.vacuum(0) == {"folders": 0, "bytes": 0}
    named = {part.split("/")[0] for parts in json.loads((tmp_path / "ledger" / "CURRENT").read_text()).values() for part in parts}
    assert {p.name for p in (tmp_path / "ledger").glob("v*")} == named
    assert ledger.create(stdin=json.dumps([row(4)]))["inserted"] == 1
