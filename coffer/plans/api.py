"""Envelopes and plain text for results at the edge."""

from __future__ import annotations

from coffer.errors import CofferError

VERSION = "v1"


def success(data: dict) -> dict:
    return {"ok": True, "version": VERSION, "data": data}


def failure(error: CofferError) -> dict:
    return {"ok": False, "error": {"code": error.code, "message": error.message, "data": error.data}}


def call(run, *args, **named) -> dict:
    try:
        return success(run(*args, **named))
    except CofferError as e:
        return failure(e)


def text_table(columns: list[str], rows: list[list], width: int = 100) -> str:
    """Aligned columns, or one block per row where they don't fit the width."""
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    sizes = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    if sum(sizes) + 2 * (len(sizes) - 1) <= width:
        return "\n".join("  ".join(v.ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip() for r in [columns, *cells])
    return "\n\n".join("\n".join(f"{c}: {v}" for c, v in zip(columns, r, strict=True)) for r in cells)
