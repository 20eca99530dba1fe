"""The commands at the edge: each runs against a ledger and gives JSON or text, and an exit code.

A command is a function to its data, the shape of its JSON, and its text as sections. A section is a heading over
a table, over named values, or over nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime

from coffer.errors import CofferError
from coffer.operators import profile
from coffer.plans.api import failure, success, text_table
from coffer.plans.ledger import Ledger

#: Errors of the caller end with 1, others with 2.
USER_ERRORS = {"invalid_argument", "import_schema_mismatch", "import_validation_failed", "import_id_not_found", "import_already_reverted", "unknown_view"}
POLICIES = {"recurring": "recurring/v1", "anomalies": "anomalies/v1"}


@dataclass(frozen=True)
class Command:
    data: Callable[..., object]
    text: Callable[[object], list[tuple]]
    envelope: bool = False  # of commands that change the ledger


def plain(value):
    """As JSON has it."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, date) else value


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _table(rows: list[dict], *columns: str) -> tuple[list[str], list[list]]:
    names = columns or tuple(dict.fromkeys(k for r in rows for k in r))
    return list(names), [[r.get(c) for c in names] for r in rows]


def _imports(ledger: Ledger) -> list[dict]:
    rows = _rows(ledger.imports())
    for r in rows:
        for key in ("created_at", "committed_at", "reverted_at"):
            if (r[key] or "").isdigit():
                r[f"{key}_utc"] = datetime.fromtimestamp(int(r[key]), UTC).isoformat()
    return rows


def _detected(ledger: Ledger, kind: str, date_from: str | None, date_to: str | None) -> dict:
    covers = profile.data_range(ledger.views()["v1_transactions"]).first()
    rows = _rows(getattr(ledger, kind)(date_from, date_to))
    return {"policy_version": POLICIES[kind], "from": date_from, "to": date_to, "data_covers": {"from": covers["earliest"], "to": covers["latest"]}, "rows": rows}


def _counted(n: int, one: str, several: str) -> str:
    return f"{n} {one if n == 1 else several} found."


def _create_text(d: dict) -> list[tuple]:
    out = [("Dry run: the import is valid. No rows were written." if d["dry_run"] else "Import committed.",), ("Summary", {k: d[k] for k in ("import_id", "rows_read", "rows_valid", "rows_invalid", "inserted", "deduped")})]
    out.append(("Duplicates", _table(d["duplicates"], "source_row_index", "dedupe_reason", "account_key", "posted_at", "amount", "description")))
    if d["dry_run"]:
        return [*out, ("Existing values", _table(d["inventory"])), ("Sign profile by account", _table(d["sign_profiles"])), ("Drift warnings", _table(d["warnings"], "severity", "code", "incoming_value", "message", "suggestions"))]
    return [*out, ("Ledger now", d["ledger_accounts"]["summary"]), ("Accounts", _table(d["ledger_accounts"]["rows"]))]


def _detected_text(nouns: tuple[str, str], *columns: str) -> Callable[[dict], list[tuple]]:
    def text(d: dict) -> list[tuple]:
        bounds = {k: v for k, v in (("from", d["from"]), ("to", d["to"])) if v}
        return [(_counted(len(d["rows"]), *nouns),), *([("Dates", bounds)] if bounds else []), ("Findings", _table(d["rows"], *columns)), ("Ledger covers", d["data_covers"])]

    return text


def _schema_text(d: dict) -> list[tuple]:
    if "view_name" in d:
        return [(f"View {d['view_name']}", _table(d["columns"], "name", "type", "nullable"))]
    return [(f"Ledger at {d['ledger_path']}",), *[(v["name"], _table(v["columns"], "name", "type", "nullable")) for v in d["public_views"]]]


COMMANDS = {
    "account list": Command(lambda l: l.accounts(), lambda d: [("Summary", d["summary"]), ("Accounts", _table(d["rows"]))]),
    "db schema": Command(lambda l, view=None: l.schema(view), _schema_text),
    "db sql": Command(
        lambda l, query=None, file=None, stdin=None, max_rows=None: l.sql(query, max_rows, file, stdin),
        lambda d: [("Rows", ([c["name"] for c in d["columns"]], d["rows"])), (f"{d['row_count']} rows{', cut off' if d['truncated'] else ''}.",)],
    ),
    "import create": Command(lambda l, path=None, stdin=None, dry_run=False: l.create(path, stdin, dry_run=dry_run), _create_text, True),
    "import list": Command(_imports, lambda d: [(_counted(len(d), "import", "imports"),), ("Imports", _table(d, "import_id", "status", "created_at_utc", "rows_read", "inserted", "deduped"))]),
    "import duplicates": Command(
        lambda l, import_id: {"import_id": import_id, "rows": _rows(l.duplicates(import_id))},
        lambda d: [(_counted(len(d["rows"]), "duplicate", "duplicates"),), ("Duplicates", _table(d["rows"], "source_row_index", "dedupe_reason", "account_key", "posted_at", "amount", "description", "matched_txn_id", "matched_import_id"))],
    ),
    "import keys uniq": Command(lambda l, name=None: {"property": name, "rows": _rows(l.keys(name))}, lambda d: [("Values", _table(d["rows"]))]),
    "import undo": Command(lambda l, import_id: l.undo(import_id), lambda d: [("Import reverted.",), ("Summary", d)], True),
    "intelligence refresh": Command(lambda l: l.refresh(), lambda d: [("Detectors refreshed.",), ("Summary", d)], True),
    "recurring": Command(lambda l, date_from=None, date_to=None: _detected(l, "recurring", date_from, date_to), _detected_text(("recurring series",) * 2, "merchant", "cadence", "typical_amount", "currency", "last_seen_at", "next_expected_at", "score", "is_active")),
    "anomalies": Command(lambda l, date_from=None, date_to=None: _detected(l, "anomalies", date_from, date_to), _detected_text(("anomaly", "anomalies"), "posted_at", "merchant", "amount", "severity", "reason")),
}


def sections(parts: list[tuple], width: int = 100) -> str:
    out = []
    for heading, *body in parts:
        lines = [heading if not body else f"{heading}:"]
        if body and isinstance(body[0], dict):
            size = max((len(k) for k in body[0]), default=0) + 1
            lines += [f"  {k + ':':<{size}} {'' if v is None else v}" for k, v in body[0].items()]
        elif body:
            columns, rows = body[0]
            lines.append(text_table(columns, [[", ".join(map(str, v)) if isinstance(v, list) else v for v in r] for r in rows], width) if rows else "  none")
        out.append("\n".join(lines))
    return "\n\n".join(out)


def run(ledger: Ledger, name: str, as_json: bool = False, width: int = 100, **options) -> tuple[int, str]:
    """(exit code, output) of a command."""
    try:
        if name not in COMMANDS:
            raise CofferError("invalid_argument", f"There is no command {name}.")
        data = COMMANDS[name].data(ledger, **options)
    except CofferError as e:
        code = 1 if e.code in USER_ERRORS else 2
        return code, json.dumps({"error": plain(failure(e)["error"])}, indent=2) if as_json else f"Error {e.code}: {e.message}"
    if as_json:
        return 0, json.dumps(plain(success(data) if COMMANDS[name].envelope else data), indent=2)
    return 0, sections(COMMANDS[name].text(plain(data)), width)
