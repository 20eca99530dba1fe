"""The SQL surface's functions and quoting, rewritten to Spark SQL before a query runs.

The text is cut into tokens; literals, names and operators are respelled, and calls of functions that Spark lacks or
defines otherwise become built-in expressions or the SQL functions below, which the analyzer inlines. Each call is rendered once, from its
rendered arguments. What ``/`` and ``%`` mean depends on the types of their operands: Spark's parser says where each stands and its
analyzer what its operands are, innermost first. Nothing runs in Python per row. Modifiers of dates and formats must be literals. Times are in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import SparkSession

from coffer.errors import CofferError

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|\[[^\]]*\]|0[xX][0-9A-Fa-f]+|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|\s+|.""", re.S)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SQL functions of the session that a query runs in.
HELPERS = [
    f"coffer_lower(x STRING) RETURNS STRING RETURN translate(x, '{_UPPER}', '{_LOWER}')",
    # By the shortest decimal text of x, half away from zero.
    "coffer_round(x DOUBLE, n INT) RETURNS DOUBLE RETURN if(abs(x) >= 1e15D OR n > 15 OR isnan(x), x, cast(sign(x) AS DOUBLE) * cast(floor(cast(abs(x) AS DECIMAL(33, 17)) * cast(power(10D, greatest(n, 0)) AS DECIMAL(16, 0)) + 0.5BD) AS DOUBLE) / power(10D, greatest(n, 0)))",
    # The leading whole number of a text, or a number cut to one; given as JSON, which tells texts from numbers.
    """coffer_whole(j STRING) RETURNS BIGINT RETURN CASE WHEN j = '{}' THEN NULL
        WHEN j LIKE '{"x":"%' THEN coalesce(try_cast(regexp_extract(get_json_object(j, '$.x'), '^\\\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0L)
        WHEN j LIKE '{"x":t%' THEN 1L WHEN j LIKE '{"x":f%' THEN 0L
        ELSE coalesce(try_cast(get_json_object(j, '$.x') AS BIGINT), cast(greatest(least(cast(get_json_object(j, '$.x') AS DOUBLE), 9.2233720368547748e18D), -9.2233720368547748e18D) AS BIGINT)) END""",
    """coffer_real(j STRING) RETURNS DOUBLE RETURN CASE WHEN j = '{}' THEN NULL WHEN j LIKE '{"x":t%' THEN 1D WHEN j LIKE '{"x":f%' THEN 0D
        ELSE coalesce(try_cast(regexp_extract(get_json_object(j, '$.x'), '^\\\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0D) END""",
    # Characters from .. to before .. of a text, counted from 1, cut to those that are there.
    "coffer_between(x STRING, lo BIGINT, hi BIGINT) RETURNS STRING RETURN substring(x, cast(greatest(lo, 1) AS INT), cast(greatest(least(hi, length(x) + 1) - greatest(lo, 1), 0) AS INT))",
    "coffer_start(x STRING, s BIGINT) RETURNS BIGINT RETURN if(s < 0, length(x) + 1 + s, s)",
    "coffer_substr(x STRING, s BIGINT, n BIGINT) RETURNS STRING RETURN coffer_between(x, coffer_start(x, s) + least(n, 0), coffer_start(x, s) + greatest(n, 0))",
    """coffer_time(x STRING) RETURNS TIMESTAMP_NTZ RETURN CASE
        WHEN x RLIKE '^[0-9]{4}-[0-9]{2}-(0[1-9]|[12][0-9]|3[01])([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$'
            THEN timestampadd(DAY, cast(substring(x, 9, 2) AS INT) - 1, try_cast(concat(substring(x, 1, 8), '01', substring(x, 11)) AS TIMESTAMP_NTZ))
        WHEN x RLIKE '^[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$' THEN try_cast(concat('2000-01-01 ', x) AS TIMESTAMP_NTZ)
        WHEN x RLIKE '^[0-9]+([.][0-9]+)?$' THEN timestampadd(MICROSECOND, cast(round((cast(x AS DOUBLE) - 2440587.5D) * 86400000D) * 1000 AS BIGINT), TIMESTAMP_NTZ'1970-01-01')
        WHEN coffer_lower(x) = 'now' THEN cast(current_timestamp() AS TIMESTAMP_NTZ) END""",
    # A day that the month lacks stands as it is until a modifier moves it.
    """coffer_date(x STRING) RETURNS STRING RETURN CASE WHEN x RLIKE '^[0-9]{4}-(0[1-9]|1[0-2])-[0-9]{2}' AND coffer_time(x) IS NOT NULL THEN substring(x, 1, 10)
        ELSE date_format(coffer_time(x), 'yyyy-MM-dd') END""",
    "coffer_datetime(x STRING) RETURNS STRING RETURN concat(coffer_date(x), date_format(coffer_time(x), ' HH:mm:ss'))",
    "coffer_moment(x STRING) RETURNS STRUCT<d: STRING, t: TIMESTAMP_NTZ> RETURN named_struct('d', coffer_date(x), 't', coffer_time(x))",
    "coffer_epoch(x STRING) RETURNS TIMESTAMP_NTZ RETURN timestampadd(MICROSECOND, cast(try_cast(x AS DOUBLE) * 1000000 AS BIGINT), TIMESTAMP_NTZ'1970-01-01')",
    # A day that the month lacks runs over into the next one.
    "coffer_months(t TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN timestampadd(DAY, day(t) - 1, timestampadd(MONTH, n, timestampadd(DAY, 1 - day(t), t)))",
    "coffer_weekday(t TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN timestampadd(DAY, cast(pmod(n + 1 - dayofweek(t), 7) AS INT), t)",
]
#: Places in a date's text.
_DATE_PARTS = {"Y": (1, 4), "m": (6, 2), "d": (9, 2), "F": (1, 10)}
#: Words before a parenthesis that call nothing.
_KEYWORDS = {"and", "as", "between", "by", "case", "distinct", "else", "except", "exists", "from", "having", "in", "intersect", "is", "join", "like", "limit", "not", "offset", "on", "or", "over", "select", "then", "union", "all", "using", "values", "when", "where", "with"}
_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
_CODES = {
    "d": "dd", "e": "d", "f": "ss.SSS", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "Y": "yyyy",
}


def _bad(message: str) -> CofferError:
    return CofferError("invalid_argument", message)


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


# Names of types, by what a cast to them makes.
_TYPES = {"text": "STRING", "varchar": "STRING", "char": "STRING", "integer": "BIGINT", "int": "BIGINT", "bigint": "BIGINT", "real": "DOUBLE", "double": "DOUBLE", "float": "DOUBLE"}


def _respelled(parts: list[str]) -> list[str]:
    """Tokens of the same statement in forms that Spark's grammar knows; literals and quoted names are still as given."""
    out: list[str] = []
    solid = [k for k, t in enumerate(parts) if not _blank(t)]
    after = dict(zip(solid, solid[1:], strict=False))
    word = lambda k: parts[k].lower() if k is not None else ""
    skip = -1
    for k, t in enumerate(parts):
        if k <= skip:
            continue
        low, nxt = t.lower(), after.get(k)
        if t.startswith(("--", "/*")):
            out.append(" ")
        elif t[0] == "[" and len(t) > 1:
            out.append('"' + t[1:-1].replace('"', '""') + '"')
        elif low[:2] == "0x" and len(t) > 2:
            out.append(str(int(t, 16)))
        elif (t[0].isdigit() or t[0] == "." and len(t) > 1) and any(c in low for c in ".e"):
            out.append(f"{t}D" if "." not in t or t[-1] != "." else f"{t}0D")
        elif low in ("isnull", "notnull"):
            out.append("IS NULL" if low == "isnull" else "IS NOT NULL")
        elif low == "is" and word(nxt) not in ("null", "true", "false", "unknown", "distinct", "not"):
            out.append("IS NOT DISTINCT FROM")
        elif low == "is" and word(nxt) == "not" and word(after.get(nxt)) not in ("null", "true", "false", "unknown", "distinct"):
            out.append("IS DISTINCT FROM")
            skip = nxt
        elif low == "limit" and nxt is not None and word(after.get(nxt)) == "," and (last := after.get(after[nxt])) is not None:
            out.append(f"LIMIT {parts[last]} OFFSET {parts[nxt]}")
            skip = last
        else:
            out.append(t)
    return out


def _blank(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def one_statement(sql: str) -> bool:
    """Whether nothing but white space and comments follows the first semicolon."""
    parts = tokens(sql)
    return ";" not in parts or all(_blank(t) or t == ";" for t in parts[parts.index(";") :])


def _text(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _quoted(parts: list[str]) -> str:
    """Tokens with literals and double-quoted names as Spark spells them."""
    name = lambda t: "`" + t[1:-1].replace('""', '"').replace("`", "``") + "`"
    spell = lambda t: _literal(_text(t)) if t[0] == "'" else name(t) if t[0] == '"' and len(t) > 1 else t
    return "".join(spell(t) for t in parts)


def quoted(sql: str) -> str:
    """The statement in Spark's spelling, its calls as they are, for the check of what it reads and calls."""
    parts, out = _respelled(tokens(sql)), []
    for k, t in enumerate(parts):  # types of casts
        before = next((x.lower() for x in reversed(parts[:k]) if not _blank(x)), "")
        out.append(_TYPES[t.lower()] if before == "as" and t.lower() in _TYPES and next((x for x in parts[k + 1 :] if not _blank(x)), "") in (")", "(") else t)
    return _quoted(out)


def _arguments(parts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in parts:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out if any(not _blank(t) for t in parts) else []


def _constant(argument: list[str]) -> str | None:
    """The text of a string literal, else null."""
    solid = [t for t in argument if not _blank(t)]
    return _text(solid[0]) if len(solid) == 1 and solid[0][0] == "'" else None


def _moment(arguments: list[list[str]], given: list[str]) -> str:
    """A point in time: a value, rendered, and its modifiers."""
    if not arguments:
        return "coffer_time('now')"
    modifiers = [_constant(a) for a in arguments[1:]]
    base = f"cast({given[0]} AS STRING)"
    if modifiers and (modifiers[0] or "").strip().lower() == "unixepoch":
        at, modifiers = f"coffer_epoch({base})", modifiers[1:]
    else:
        at = f"coffer_time({base})"
    for m in modifiers:
        m = None if m is None else re.sub(r"\s+", " ", m.strip().lower())
        if m is None:
            raise _bad("A date modifier must be a text literal.")
        if x := re.fullmatch(r"([+-]?[0-9]+(?:\.[0-9]+)?) (day|hour|minute|second)s?", m):
            at = f"timestampadd(MICROSECOND, {round(float(x[1]) * _UNITS[x[2]])}L, {at})"
        elif x := re.fullmatch(r"([+-]?[0-9]+) (month|year)s?", m):
            at = f"coffer_months({at}, {int(x[1]) * (12 if x[2] == 'year' else 1)})"
        elif x := re.fullmatch(r"start of (day|month|year)", m):
            day = f"cast({at} AS DATE)"
            at = f"cast({day if x[1] == 'day' else f'''trunc({day}, '{x[1]}')'''} AS TIMESTAMP_NTZ)"
        elif x := re.fullmatch(r"weekday ([0-6])", m):
            at = f"coffer_weekday({at}, {x[1]})"
        elif m not in ("utc", "localtime"):
            raise _bad(f"The date modifier {m!r} is not supported.")
    return at


def _formatted(at: str, pattern: str) -> str:
    return f"date_format({at}, {_literal(pattern)})"


def _strftime(arguments: list[list[str]], given: list[str]) -> str:
    pattern = _constant(arguments[0]) if arguments else None
    if pattern is None:
        raise _bad("strftime needs its format as a text literal.")
    plain, out = len(arguments) == 2, []
    for piece in re.findall(r"%.?|[^%]+", pattern, re.S):
        code = piece[1:] if piece[0] == "%" else None
        if code is None or code == "%":
            out.append(_literal(piece if code is None else "%"))
        elif plain and code in _DATE_PARTS:
            out.append(f"substring(p.d, {_DATE_PARTS[code][0]}, {_DATE_PARTS[code][1]})")
        elif code == "s":
            out.append("cast(unix_seconds(cast(p.t AS TIMESTAMP)) AS STRING)")
        elif code in ("w", "u"):
            out.append(f"cast({'dayofweek(p.t) - 1' if code == 'w' else 'weekday(p.t) + 1'} AS STRING)")
        elif code in _CODES:
            out.append(_formatted("p.t", _CODES[code]))
        else:
            raise _bad(f"The format code {piece} is not supported.")
    if not out:
        return "''"
    # Bound once, however many codes read it; a time that is null gives null.
    moment = f"coffer_moment(cast({given[1]} AS STRING))" if plain else f"named_struct('t', {_moment(arguments[1:], given[1:])})"
    return f"element_at(transform(array({moment}), p -> if(p.t IS NULL, NULL, concat({', '.join(out)}))), 1)"


def _printf(arguments: list[list[str]], given: list[str]) -> str:
    pattern = _constant(arguments[0]) if arguments else None
    if pattern is None:
        raise _bad("printf needs its format as a text literal.")
    values, at, out = given[1:], 0, []
    for piece in re.findall(r"%[-+ 0,#]*[0-9]*(?:\.[0-9]+)?(?:l{1,2})?[A-Za-z%]|%|[^%]+", pattern, re.S):
        kind = piece[-1] if piece[0] == "%" and len(piece) > 1 else None
        if kind in (None, "%"):
            out.append(_literal(piece if kind is None else "%"))
            continue
        value = f"({values[at]})" if at < len(values) else "NULL"
        at += 1
        spec = piece[:-1].replace("l", "")
        if kind in "diuxXo":
            out.append(f"format_string({_literal(spec + ('d' if kind in 'iu' else kind))}, coalesce(cast({value} AS BIGINT), 0L))")
        elif kind in "feEgG":
            out.append(f"format_string({_literal(spec + kind)}, coalesce(cast({value} AS DOUBLE), 0D))")
        elif kind in "sc":
            text = f"coalesce(cast({value} AS STRING), '')"
            flags = re.sub("[+ 0,#]", "", re.match("%[-+ 0,#]*", spec)[0])  # only the sign of alignment matters to a text
            out.append(f"format_string({_literal(flags + re.sub('^%[-+ 0,#]*', '', spec) + 's')}, {text if kind == 's' else f'left({text}, 1)'})")
        else:
            raise _bad(f"The format {piece} is not supported.")
    return f"concat({', '.join(out)})" if out else "''"


def _cast(parts: list[str]) -> str | None:
    """A cast to one of the surface's types."""
    depth, at = 0, None
    for k, t in enumerate(parts):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == "as":
            at = k
    kind = _TYPES.get(next((t.lower() for t in parts[at + 1 :] if not _blank(t)), "")) if at is not None else None
    if kind is None:
        return None
    value = render(parts[:at])
    if kind == "STRING":
        return f"cast({value} AS STRING)"
    return f"coffer_{'whole' if kind == 'BIGINT' else 'real'}(to_json(named_struct('x', {value})))"


def _call(name: str, parts: list[str]) -> str:
    """The rewritten call of an allowed function; Spark's own, from its rendered arguments, where that does."""
    if name == "cast" and (cast := _cast(parts)) is not None:
        return cast
    arguments = _arguments(parts)
    given = [render(a) for a in arguments]
    n = len(given)
    if name in ("min", "max") and n > 1:
        return f"CASE WHEN {' OR '.join(f'({g}) IS NULL' for g in given)} THEN NULL ELSE {'least' if name == 'min' else 'greatest'}({', '.join(given)}) END"
    if name in ("date", "datetime") and n == 1:
        return f"coffer_{name}(cast({given[0]} AS STRING))"
    if name == "date":
        return _formatted(_moment(arguments, given), "yyyy-MM-dd")
    if name == "datetime":
        return _formatted(_moment(arguments, given), "yyyy-MM-dd HH:mm:ss")
    if name == "strftime":
        return _strftime(arguments, given)
    if name == "printf":
        return _printf(arguments, given)
    if name == "lower" and n == 1:
        return f"coffer_lower(cast({given[0]} AS STRING))"
    if name == "length" and n == 1:
        return f"length(cast({given[0]} AS STRING))"
    if name == "round" and n in (1, 2):
        return f"coffer_round(cast({given[0]} AS DOUBLE), cast({given[1] if n == 2 else 0} AS INT))"
    if name == "substr" and n in (2, 3):
        return f"coffer_substr(cast({given[0]} AS STRING), cast({given[1]} AS BIGINT), cast({given[2] if n == 3 else 2**31 - 1} AS BIGINT))"
    return f"{name}({','.join(given)})"


def render(parts: list[str]) -> str:
    """Tokens as Spark SQL, with all calls rewritten."""
    out, k = [], 0
    while k < len(parts):
        t, following = parts[k], k + 1
        while following < len(parts) and _blank(parts[following]):
            following += 1
        if t[0].isalpha() and following < len(parts) and parts[following] == "(":
            depth, end = 1, following + 1
            while end < len(parts) and depth:
                depth += (parts[end] == "(") - (parts[end] == ")")
                end += 1
            inner = parts[following + 1 : end - 1]
            out.append(_call(t.lower(), inner) if t.lower() not in _KEYWORDS else f"{t} ({render(inner)})")
            k = end
            continue
        out.append(_quoted([t]))
        k += 1
    return "".join(out)


def to_spark(sql: str) -> str:
    return render(_respelled(tokens(sql)))


_DIVISIONS = {"Divide": "/", "Remainder": "%"}
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _span(node, sql: str) -> tuple[int, int] | None:
    """Where a node stands in the text, if it was parsed from it."""
    o = node.origin()
    if not (o.startIndex().isDefined() and o.stopIndex().isDefined() and o.sqlText().isDefined()) or o.sqlText().get() != sql:
        return None
    return o.startIndex().get(), o.stopIndex().get()


def _divisions(plan, sql: str) -> Iterator[tuple]:
    """(span, node) of each division of a plan and of the plans in its expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in _DIVISIONS and (span := _span(node, sql)):
            yield span, node
        todo += _items(node.children())
        if is_instance_of(SparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            todo += _items(node.expressions())
            if kind == "UnresolvedWith":
                todo += [c._2() for c in _items(node.cteRelations())]
        elif kind in ("ScalarSubquery", "Exists", "ListQuery"):
            todo.append(node.plan())
        elif kind == "InSubquery":
            todo.append(node.query().plan())


def _last_outside(text: str, operator: str) -> int:
    """Where the operator stands last outside of parentheses and quotes; operators of its rank bind from the left."""
    depth, last = 0, -1
    for m in re.finditer(r"'(?:\\.|[^'\\])*'|`[^`]*`|.", text, re.S):
        depth += (m[0] in "([") - (m[0] in ")]")
        if m[0] == operator and depth == 0:
            last = m.start()
    return last


def _whole_number(operand, span: tuple[int, int], sql: str) -> bool:
    """Whether an operand is of an integral type, before the analyzer's own cast."""
    if operand.getClass().getSimpleName() == "Cast":
        own = _span(operand, sql)
        if own in (None, span) or not sql[own[0] :].lower().startswith("cast("):
            operand = operand.child()
    return operand.resolved() and operand.dataType().catalogString() in _INTEGRAL


def divide(session: SparkSession, sql: str) -> str:
    """The text with each division in the surface's meaning: of whole numbers a whole number, null by zero."""
    state = session._jsparkSession.sessionState()
    whole = True
    while parsed := dict(_divisions(state.sqlParser().parsePlan(sql), sql)):
        todo = set(parsed)
        if whole:
            # Whole operands stay so, whatever becomes of other divisions; theirs may turn whole with them.
            known = _divisions(session.sql(sql)._jdf.queryExecution().analyzed(), sql)
            found = {s for s, n in known if _whole_number(n.left(), s, sql) and _whole_number(n.right(), s, sql)}
            whole = bool(todo & found)
            todo = todo & found or todo
        inner = [s for s in todo if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in todo)]
        for start, stop in sorted(inner, reverse=True):
            node = parsed[start, stop]
            at = start + _last_outside(sql[start : stop + 1], _DIVISIONS[node.getClass().getSimpleName()])
            x, y = sql[start:at], sql[at + 1 : stop + 1]
            if sql[at] == "/":
                new = f"(({x}) DIV nullif(({y}), 0))" if whole else f"try_divide(cast(({x}) AS DOUBLE), cast(({y}) AS DOUBLE))"
            elif whole:
                new = f"mod(({x}), nullif(({y}), 0))"
            else:
                new = f"cast(mod(cast(({x}) AS BIGINT), nullif(cast(({y}) AS BIGINT), 0)) AS DOUBLE)"
            sql = sql[:start] + new + sql[stop + 1 :]
    return sql


#: A join whose one side is small in each partition streams the other side past it: a sort-merge join gathers all rows of a
#: key, which an outer join does for the side that is not kept. Where one is left (an advisory partition size above this one, both
#: sides large), it goes to disk beyond some rows.
JOINS = {
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold": "65536",
    "spark.sql.sortMergeJoinExec.buffer.spill.threshold": "1048576",
}


def session(spark: SparkSession) -> SparkSession:
    """A child session that has the helpers and none of the caller's views."""
    child = spark.newSession()
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **JOINS}.items():
        child.conf.set(key, value)
    for helper in HELPERS:
        child.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {helper}")
    return child
