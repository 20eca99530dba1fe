"""Import sources: one JSON array or one CSV text, as rows of nullable strings with their number.

A large file, and any that is named with its file system, is scanned in ranges by Spark (``splits``). A local file of up to
``ONE_PIECE`` bytes and stdin are parsed on the driver, with the same rows and errors. ``frame`` takes rows that are in Spark already.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from coffer.errors import CofferError
from coffer.sources import splits
from coffer.sources.contract import FIELDS, SCHEMA, check_headers, detect_head, is_json, scalar_text

ONE_PIECE = 8 << 20


def resolve(path: str | None = None, stdin: str | None = None) -> tuple[str, str, str | None]:
    """(content, kind, reference) of exactly one source; ``-`` means stdin."""
    has_stdin = bool(stdin and stdin.strip())
    if path == "-":
        if not has_stdin:
            raise CofferError("invalid_argument", "Path `-` means stdin input, but stdin was empty.")
        return stdin, "stdin", None
    if path is not None:
        try:
            body = Path(path).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError) as e:
            raise CofferError("invalid_argument", f"Could not read import file `{path}`: {e}") from e
        if has_stdin:
            raise CofferError("invalid_argument", "A file and stdin were both given; give one of them.")
        return body, "file", path
    if has_stdin:
        return stdin, "stdin", None
    raise CofferError("invalid_argument", "No import source was provided.")


def detect(content: str) -> str:
    """``json`` or ``csv``; other inputs are errors."""
    text = content.strip()
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) >= 2 and all(is_json(x, dict) for x in lines):
        raise CofferError("invalid_argument", "NDJSON is not supported. Provide a JSON array or CSV.", {"format": "ndjson"})
    return detect_head(text)


def parse(content: str) -> list[tuple]:
    text = content.strip()
    if detect(content) == "json":
        try:
            items = json.loads(text)
        except ValueError as e:
            raise CofferError("invalid_argument", "Invalid JSON input. Provide a valid JSON array.") from e
        if not all(isinstance(x, dict) for x in items):
            raise CofferError("invalid_argument", "Each item of the array must be an object.")
        return [(k, *[scalar_text(x.get(c)) for c in FIELDS]) for k, x in enumerate(items, 1)]
    try:
        rows = [r for r in csv.reader(io.StringIO(text), strict=True) if r]
    except csv.Error as e:
        raise CofferError("invalid_argument", f"Invalid CSV input: {e}.") from e
    headers = [h.strip() for h in rows[0]]
    check_headers(headers)
    for r in rows[1:]:
        if len(r) != len(headers):
            raise CofferError("invalid_argument", "A CSV row has another number of fields than the header.")
    return [(k, *[(r[headers.index(c)] if c in headers else None) for c in FIELDS]) for k, r in enumerate(rows[1:], 1)]


def in_ranges(path: str | None) -> str | None:
    """The path as Spark reads it if the file is to be scanned in ranges, else null."""
    if path is None or path == "-":
        return None
    if re.match("[A-Za-z][A-Za-z0-9+.-]*://?", path):
        return path
    local = Path(path)
    return local.absolute().as_uri() if local.is_file() and local.stat().st_size > ONE_PIECE else None


def read_source(spark: SparkSession, path: str | None = None, stdin: str | None = None, stage: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, str, str | None]:
    """Rows, kind and reference of the source. ``stage`` writes and rereads what a scan in ranges has parsed."""
    if stage is not None and (place := in_ranges(path)):
        if stdin and stdin.strip():
            raise CofferError("invalid_argument", "A file and stdin were both given; give one of them.")
        return splits.scan(spark, place, stage), "file", path
    content, kind, ref = resolve(path, stdin)
    return spark.createDataFrame(parse(content), SCHEMA), kind, ref


def frame(df: DataFrame) -> DataFrame:
    """Rows that are in Spark: a row column and any of the fields, the others null."""
    from pyspark.sql import functions as F

    if "row" not in df.columns:
        raise CofferError("invalid_argument", "Rows need their number in a row column.")
    return df.select(F.col("row").cast("long").alias("row"), *[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
