"""One read-only SELECT over the public views, checked on the parsed plan before anything runs."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from decimal import Decimal
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from coffer.errors import CofferError
from coffer.plans import dialect

VIEWS = ["v1_transactions", "v1_accounts", "v1_imports", "v1_recurring", "v1_anomalies"]
# The functions that a query may call, and the limits on its text and result.
FUNCTIONS = ["abs", "avg", "coalesce", "count", "date", "datetime", "ifnull", "length", "lower", "max", "min", "nullif", "printf", "round", "strftime", "substr", "sum"]
MOST_BYTES, DEFAULT_ROWS, MOST_ROWS = 65_536, 1000, 10_000
#: Operators that Spark's parser spells as calls, which are no calls in SQL.
_OPERATORS = {"between"}
#: Names without parentheses that Spark reads as calls.
_BARE_CALLS = {"current_catalog", "current_database", "current_date", "current_schema", "current_time", "current_timestamp", "current_timezone", "current_user", "localtime", "localtimestamp", "now", "session_user", "user"}
_EXPRESSION_OK = {
    "Add", "Alias", "And", "AttributeReference", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "CaseWhen", "Cast", "Concat", "CurrentRow$", "Divide", "EqualNullSafe", "EqualTo", "Exists", "GreaterThan", "GreaterThanOrEqual", "In", "InSubquery",
    "IsNotNull", "IsNull", "LessThan", "LessThanOrEqual", "Like", "ListQuery", "Literal", "Multiply", "Not", "Or", "Remainder", "ScalarSubquery", "ShiftLeft", "ShiftRight", "SortOrder", "SpecifiedWindowFrame", "Subtract", "UnaryMinus", "UnaryPositive",
    "UnboundedFollowing$", "UnboundedPreceding$", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedFunction", "UnresolvedOrdinal", "UnresolvedStar", "UnresolvedWindowExpression", "UnspecifiedFrame$", "WindowExpression", "WindowSpecDefinition",
}
_PLAN_OK = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union", "Intersect", "Except", "SetOperation",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedWith", "OneRowRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "WithWindowDefinition", "LocalRelation",
}


def check_text(sql: str) -> None:
    if not sql or not sql.strip() or "\0" in sql:
        raise CofferError("invalid_argument", "SQL must not be blank or hold NUL.")
    if len(sql.encode()) > MOST_BYTES:
        raise CofferError("invalid_argument", f"SQL must not exceed {MOST_BYTES} characters.")
    if not dialect.one_statement(sql):
        raise CofferError("invalid_argument", "SQL must be a single statement.")


def resolve_sql(text: str | None = None, file: str | None = None, stdin: str | None = None) -> tuple[str, str]:
    """(SQL, where it came from) of exactly one source: inline text, a file, or stdin where the file is ``-``."""
    if (text is None) == (file is None):
        raise CofferError("invalid_argument", "Give exactly one SQL source: inline text, a file, or the file - for stdin.")
    if text is not None:
        return text, "inline"
    if file == "-":
        return (sys.stdin.read() if stdin is None else stdin), "stdin"
    try:
        return Path(file).read_text(encoding="utf-8"), "file"
    except (OSError, UnicodeDecodeError) as e:
        raise CofferError("invalid_argument", f"The SQL file {file} can't be read: {e}") from e


@contextmanager
def mapped() -> Iterator[None]:
    """Errors of analysis and of a running query as ``invalid_argument``."""
    try:
        yield
    except (PySparkException, Py4JError) as e:
        first = next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)
        raise CofferError("invalid_argument", f"The SQL query could not be executed: {first}") from e


def _items(seq):
    return [seq.apply(k) for k in range(seq.size())]


def _walk(plan, names: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in _PLAN_OK:
        raise CofferError("invalid_argument", f"SQL is restricted to one read-only SELECT over the public v1_* views ({kind}).")
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise CofferError("invalid_argument", f"Only the public v1_* views can be read, not {'.'.join(parts)}.")
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            raise CofferError("invalid_argument", "Recursive queries are not allowed.")
        names = set(names)
        for cte in _items(plan.cteRelations()):
            _walk(cte._2(), names)
            names.add(cte._1().lower())
    for e in _items(plan.expressions()):
        _walk_expression(e, names)
    for child in _items(plan.children()):
        _walk(child, names)


def _walk_expression(e, names: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if "Parameter" in kind:
        raise CofferError("invalid_argument", "Parameters are not supported.")
    if kind not in _EXPRESSION_OK:
        raise CofferError("invalid_argument", f"This expression is not allowed ({kind}).")
    name = ".".join(_items(e.nameParts())).lower() if kind in ("UnresolvedFunction", "UnresolvedAttribute") else ""
    if (kind == "UnresolvedFunction" and name not in FUNCTIONS and name not in _OPERATORS) or (kind == "UnresolvedAttribute" and name in _BARE_CALLS):
        raise CofferError("invalid_argument", f"The function {name} is not allowed.")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery"):
        plan = e.query().plan() if kind == "InSubquery" else e.plan()
        _walk(plan, names)
    for child in _items(e.children()):
        _walk_expression(child, names)


def guard(spark: SparkSession, sql: str) -> None:
    """Raises unless the text is one SELECT over the public views with allowed functions."""
    check_text(sql)
    with mapped():
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect.quoted(sql))
    _walk(plan, set(VIEWS))


def query(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """The lazy result over the given views, in a session of its own that knows nothing else."""
    guard(spark, sql)
    child = dialect.session(spark)
    for name, df in views.items():
        plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(child._jsparkSession, df._jdf.logicalPlan())
        type(df)(plan, child).createOrReplaceTempView(name)
    with mapped():
        return child.sql(dialect.divide(child, dialect.to_spark(sql)))


def _kind(values: list) -> dict:
    """A column's type and nullability, as told by the values that came back."""
    names = {"integer" if isinstance(v, int) else "real" if isinstance(v, float) else "text" for v in values if v is not None}
    kind = "unknown" if not values else "null" if not names else names.pop() if len(names) == 1 else "mixed"
    return {"type": kind, "nullable": any(v is None for v in values)}


def _cell(v):
    """A value as the result shows it: integers for truth values, text for dates, lower-case hex for bytes."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bytes | bytearray):
        return v.hex()
    return v.isoformat() if isinstance(v, date) else v


def rows(df: DataFrame, limit: int | None = DEFAULT_ROWS) -> dict:
    """columns, rows and whether more were cut off."""
    n = DEFAULT_ROWS if limit is None else limit
    if not 1 <= n <= MOST_ROWS:
        raise CofferError("invalid_argument", f"The number of rows must be between 1 and {MOST_ROWS}.")
    with mapped():
        got = df.limit(n + 1).collect()
    cells = [[_cell(v) for v in r] for r in got[:n]]
    columns = [{"name": f.name, **_kind([r[k] for r in cells])} for k, f in enumerate(df.schema)]
    return {"columns": columns, "rows": cells, "row_count": len(cells), "max_rows": n, "truncated": len(got) > n}
