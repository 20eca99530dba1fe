"""Scan of one large JSON array or CSV file in byte ranges, with rows, numbers and errors as of a parse in one piece.

The file is read as pieces that end at a line feed (CSV) or a closing brace (JSON), which Spark's text source deals in byte
ranges. Whether a piece begins inside a quoted text depends on all that stands before it. So:

1. Each range is followed twice, as if it began outside and inside quotes. It gives one summary row: where each of both ends, how many
   records end in it, for JSON by nesting depth, and its first and last piece that isn't blank.
2. The summaries, one small row a range, are composed in file order on the driver: a prefix pass, which tells each range's
   true state, its nesting depth and the number of its first record.
3. Each range is read again from its true state. Records that lie in it are parsed there; the first and last part of records that
   cross its borders are joined by record number and parsed after that.

Only the head of the file (64 KB), the summaries and the first error come to the driver. Blank lines have no number, as in one piece; white space
around the content is dropped. An error is the one that a parse in one piece meets first.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.errors import CofferError
from coffer.sources.contract import FIELDS, SCHEMA, check_headers, detect_head, is_json, scalar_text

HEAD_BYTES = 65_536
#: What ends a piece.
END = {"csv": "\n", "json": "}"}
#: Kinds of problems, the one that is reported first before the others: bytes that are no text, broken syntax, a record of another shape.
UNREADABLE, SYNTAX, SHAPE = 0, 1, 2
_PARSED = f"{SCHEMA}, block long, part string, rank int, problem string"
_OUT = pa.schema([("row", pa.int64()), *[(c, pa.string()) for c in FIELDS], ("block", pa.int64()), ("part", pa.string()), ("rank", pa.int32()), ("problem", pa.string())])
_SUMMARY = "block long, pieces long, first long, last long, lead long, outside string, inside string"
_STATES = "block long, inside boolean, depth long, ended long, first long, last long, is_last boolean, opens boolean"
_BATCH = 10_000

# A quoted field and what follows it up to the next comma; possessive, so that a long text is read once.
_FIELDS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?,)*+')
_CLOSED = re.compile(r'"[^"]*+(?:""[^"]*+)*+"')
_QUOTED_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+')
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_STRING_REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+', re.S)


def line_ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted CSV field is open after ``line``."""
    if '"' not in line:
        return inside
    if inside:
        at = _QUOTED_REST.match(line).end()
        if at == len(line):
            return True
        comma = line.find(",", at)
        return comma >= 0 and line_ends_inside(line[comma + 1 :], False)
    rest = line[_FIELDS.match(line).end() :]
    return rest.startswith('"') and not _CLOSED.match(rest)


def piece_nesting(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a JSON string is open after ``piece``, and by how much the nesting depth changes in it."""
    if inside:
        at = _STRING_REST.match(piece).end()
        if at >= len(piece) or piece[at] != '"':
            return True, 0
        piece = piece[at + 1 :]
    plain = _STRING.sub("", piece)
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    return opened >= 0, plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")


class _Course:
    """One way through a range: its state, and how many records end in it, for JSON by the depth that they end at."""

    def __init__(self, kind: str, inside: bool, depth: int = 0):
        self.csv, self.inside, self.depth, self.ended = kind == "csv", inside, depth, Counter()

    def take(self, piece: str) -> int | None:
        """Follows a piece. Returns the depth at which a record may end there, else null."""
        if self.csv:
            if not self.inside and not piece.strip("\r"):
                return None
            self.inside = line_ends_inside(piece, self.inside)
            return None if self.inside else 1
        self.inside, change = piece_nesting(piece, self.inside)
        self.depth += change
        if self.inside:
            return None
        self.depth -= 1  # for the brace that ends the piece
        return self.depth

    def summary(self) -> str:
        return json.dumps([self.inside, self.depth, list(self.ended.items())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, text, other columns) of each row; text is null if the bytes are no UTF-8."""
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[2:]]
        for k, (block, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = None
            yield block, text, [c[k] for c in others]


def _summaries(kind: str) -> Callable:
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SUMMARY.split(", ")]
        now, out = None, []

        def close() -> None:
            if now is not None:
                out.append([now, n, first, last, lead, courses[0].summary(), courses[1].summary()])

        for block, text, _ in _pieces(batches):
            if block != now:
                close()
                now, n, first, last, lead, courses = block, 0, -1, -1, 0, (_Course(kind, False), _Course(kind, True))
            text = "�" if text is None else text
            if text.strip():
                first, last = (n if first < 0 else first), n
            for c in courses:
                end = c.take(text)
                if end is not None:
                    c.ended[end] += 1
                    lead += c is courses[0] and first < 0
            n += 1
        close()
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return summarise


def compose(kind: str, summaries: list[tuple]) -> tuple[list[tuple], int]:
    """The true state at the beginning of each range, in file order, and the number of records that end in the file."""
    filled = [s for s in sorted(summaries) if s[3] >= 0]
    if not filled:
        return [], 0
    states, inside, depth, ended = [], False, 0, 0
    for s in sorted(summaries):
        block, _, first, last, lead = s[:5]
        begun, done = block >= filled[0][0], block > filled[-1][0]
        opens, closes = block == filled[0][0], block == filled[-1][0]
        if begun and not done:
            states.append((block, inside, depth, ended, first if opens else 0, last if closes else None, closes, opens))
        after, change, counts = json.loads(s[6 if inside else 5])
        at = 1 if kind == "csv" else 1 - depth
        ended += dict(counts).get(at, 0) - (lead if opens else 0) if begun else 0
        inside, depth = after, depth + change
    return states, ended


def _parse_csv(headers: list[str]) -> Callable[[str, int, int], tuple]:
    place = [headers.index(c) if c in headers else None for c in FIELDS]

    def parse(text: str, number: int, total: int) -> tuple:
        try:
            found = [r for r in csv.reader(io.StringIO(text), strict=True) if r]
        except csv.Error as e:
            return None, SYNTAX, f"Invalid CSV input: {e}."
        if len(found) != 1 or len(found[0]) != len(headers):
            return None, SHAPE, "A CSV row has another number of fields than the header."
        return [None if k is None else found[0][k] for k in place], None, None

    return parse


_NO_JSON = (None, SYNTAX, "Invalid JSON input. Provide a valid JSON array.")
_NO_OBJECT = (None, SHAPE, "Each item of the array must be an object.")


def _parse_json(text: str, number: int, total: int) -> tuple:
    """An item with the bracket or comma before it; what follows the last item has a number of its own."""
    text = text.strip()
    if not text or text[0] != ("[" if number == 1 else "," if number <= total or text[0] != "]" else "]"):
        return _NO_JSON
    if number > total:
        if number > 1 and text == "]":
            return None, None, None
        whole = "[" + text[1:]
    else:
        whole = "[" + text[1:] + "]"
    try:
        items = json.loads(whole)
    except (ValueError, RecursionError):
        return _NO_JSON
    if number > total:
        return _NO_OBJECT if items else (None, None, None) if number == 1 else _NO_JSON
    if len(items) != 1 or not isinstance(items[0], dict):
        return _NO_OBJECT
    return [scalar_text(items[0].get(c)) for c in FIELDS], None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _row(number: int, base: int, parsed: tuple) -> tuple | None:
    """A parsed record as a row of the output; the header and what follows the last item are none."""
    values, rank, problem = parsed
    if rank is None and (values is None or number < 1):
        return None
    return (number, *(values or [None] * len(FIELDS)), None, None, rank, problem)


def _records(kind: str, base: int, total: int, parse: Callable) -> Callable:
    """Pieces with their range's state to rows, and to the parts of records that cross its borders."""
    end = END[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], []

        def part() -> tuple:
            return (ended + base, *[None] * len(FIELDS), now, "".join(held), None, None)

        for block, text, (inside, depth, before, first, last, is_last, opens) in _pieces(batches):
            if block != now:
                if held:
                    rows.append(part())
                # A record is whole if it begins here: after the first one that ends here, or at the file's beginning.
                now, n, held, ended, whole, course = block, -1, [], before, opens or (kind == "csv" and not inside), _Course(kind, inside, depth)
            n += 1
            if n < first or (last is not None and n > last):
                continue
            if text is None:
                rows.append((ended + base, *[None] * len(FIELDS), None, None, UNREADABLE, "The file is not UTF-8 text."))
                continue
            if opens and n == first:
                text = text.lstrip()
            final = is_last and n == last
            if final:
                text = text.rstrip()
            if kind == "csv" and not course.inside and not text.strip("\r"):
                continue
            closed = course.take(text) == 1
            held.append(text if final else text + end)
            if final and (kind == "json" or not closed):
                rows.append(part())
                held = []
            elif closed:
                if whole:
                    if (r := _row(ended + base, base, parse("".join(held), ended + base, total))) is not None:
                        rows.append(r)
                else:
                    rows.append(part())
                ended, held, whole = ended + 1, [], True
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
        if held:
            rows.append(part())
        yield _batch(rows)

    return read


def _joined(base: int, total: int, parse: Callable) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(n, base, parse(t, n, total)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield _batch([r for r in rows if r is not None])

    return read


def _ndjson(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [x for x in batch.column(0).to_pylist() if x and x.strip()]
        yield pa.RecordBatch.from_arrays([pa.array([len(lines)]), pa.array([sum(not is_json(x, dict) for x in lines)])], names=["lines", "others"])


def _head(spark: SparkSession, path: str) -> str:
    """The file's beginning without leading white space, at least its first character that is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise CofferError("invalid_argument", f"Could not read import file `{path}`: there is no such file.")
    stream = fs.open(place)
    try:
        while raw := bytes(stream.readNBytes(HEAD_BYTES)):
            if text := raw.decode(errors="ignore").lstrip():
                return text
    finally:
        stream.close()
    return ""


def ends_with_piece(summaries: list[tuple], last_byte: bytes, end: str) -> bool:
    """Whether ``end`` closes the last piece that isn't blank, which the pieces alone don't tell at the end of a file."""
    pieces = [(s[0], s[1], s[3]) for s in sorted(summaries)]
    if not pieces or pieces[-1][2] < pieces[-1][1] - 1:
        return True
    return last_byte == end.encode()


def _last_byte(spark: SparkSession, path: str) -> bytes:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(place)
    try:
        stream.seek(max(0, fs.getFileStatus(place).getLen() - 1))
        return bytes(stream.readNBytes(1))
    finally:
        stream.close()


def _first_header(head: str) -> list[str]:
    try:
        return [h.strip() for h in next(r for r in csv.reader(io.StringIO(head), strict=True) if r)]
    except csv.Error as e:
        raise CofferError("invalid_argument", f"Invalid CSV input: {e}.") from e


def scan(spark: SparkSession, path: str, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of the file. ``stage`` writes a DataFrame under a name and reads it again, so that the file is read
    twice and parsed once. Raises the error that a parse in one piece would meet first."""
    head = _head(spark, path)
    pieces = lambda end: spark.read.option("lineSep", end).text(path)
    if head.startswith("{"):
        found = pieces("\n").select("value").mapInArrow(_ndjson, "lines long, others long").agg(F.sum("lines").alias("lines"), F.sum("others").alias("others")).first()
        if found["lines"] >= 2 and found["others"] == 0:
            raise CofferError("invalid_argument", "NDJSON is not supported. Provide a JSON array or CSV.", {"format": "ndjson"})
    kind = detect_head(head)
    shape: CofferError | None = None
    parse, base = _parse_json, 1
    if kind == "csv":
        headers = _first_header(head)
        parse, base = _parse_csv(headers), 0
        try:
            check_headers(headers)
        except CofferError as e:
            shape = e
    raw = pieces(END[kind]).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    summaries = [tuple(r) for r in raw.mapInArrow(_summaries(kind), _SUMMARY).collect()]
    states, total = compose(kind, summaries)
    # One small row a range; the join keeps the pieces where and as they are.
    known = F.broadcast(spark.createDataFrame(states, _STATES))
    out = stage(raw.join(known, "block").mapInArrow(_records(kind, base, total, parse), _PARSED), "records")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "")
    crossing = out.where("part is not null").groupBy("row").agg(texts.alias("text")).mapInArrow(_joined(base, total, parse), _PARSED)
    rows = stage(out.where("part is null").unionByName(crossing).drop("block", "part"), "rows")
    bad = rows.where("rank is not null").agg(F.min(F.struct("rank", "row", "problem")).alias("x")).first()["x"]
    if bad and bad["rank"] < SHAPE:
        message = bad["problem"] if bad["rank"] == SYNTAX else f"Could not read import file `{path}`: {bad['problem']}"
        raise CofferError("invalid_argument", message)
    if kind == "json" and ends_with_piece(summaries, _last_byte(spark, path), END[kind]):  # and no bracket
        raise CofferError("invalid_argument", _NO_JSON[2])
    if shape:
        raise shape
    if bad:
        raise CofferError("invalid_argument", bad["problem"])
    return rows.drop("rank", "problem")
