"""What an import file may hold: its fields, formats and scalar texts, for the parse in one piece and the one in ranges."""

from __future__ import annotations

import json

from coffer.errors import CofferError
from coffer.operators.importing import OPTIONAL, REQUIRED

FIELDS = REQUIRED + OPTIONAL
SCHEMA = "row long, " + ", ".join(f"{c} string" for c in FIELDS)


def is_json(text: str, kind: type | None = None) -> bool:
    try:
        value = json.loads(text)
    except ValueError:
        return False
    return kind is None or isinstance(value, kind)


def detect_head(head: str) -> str:
    """``json`` or ``csv`` by the beginning of a text that is no NDJSON."""
    if not head:
        raise CofferError("invalid_argument", "Import source is empty.")
    if head.startswith("["):
        return "json"
    if "," in next(x for x in head.splitlines() if x.strip()):
        return "csv"
    known = "json_non_array" if is_json(head) else "unknown"
    raise CofferError("invalid_argument", "Provide a top-level JSON array of objects, or CSV with headers.", {"format": known})


def scalar_text(value: object) -> str | None:
    """Null stays missing, text stays, a number becomes its shortest text as a double, the rest JSON text."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool) or not isinstance(value, int | float):
        return json.dumps(value, separators=(",", ":"))
    x = float(value)
    if x == int(x) if abs(x) < 1e16 else False:
        return str(int(x)) if x or str(x)[0] != "-" else "-0"
    return format(x, "f") if 1e-5 > abs(x) and len(format(x, "f")) < 12 and float(format(x, "f")) == x else repr(x)


def check_headers(headers: list[str]) -> None:
    missing = [c for c in REQUIRED if c not in headers]
    unknown = [c for c in headers if c not in FIELDS]
    if missing or unknown:
        raise CofferError("import_schema_mismatch", "CSV headers do not match the import contract.", {"missing": missing, "unknown": unknown})
