"""Column expressions that clean, validate and identify ledger fields. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Description tokens that do not identify a counterparty.
NOISE = ["POS", "DEBIT", "CARD", "PURCHASE", "ACH", "ONLINE", "PAYMENT", "TRANSFER", "WITHDRAWAL", "CHECK", "ATM", "AUTH", "PENDING", "VISA", "MC", "TRX", "TXN"]
# Names that stand for an account type, and tokens that decide it otherwise, in order.
TYPE_NAMES = {
    "checking": ["checking"], "savings": ["savings"], "credit_card": ["credit_card", "credit", "creditcard", "card"], "loan": ["loan"],
    "brokerage": ["brokerage", "investment", "taxable"], "retirement": ["retirement", "401k", "ira", "roth"], "hsa": ["hsa"], "other": ["other"],
}
TYPE_TOKENS = {
    "checking": ["checking"], "savings": ["savings"], "credit_card": ["creditcard"], "retirement": ["retirement", "401k", "ira", "roth", "pension"],
    "brokerage": ["brokerage", "investment", "investments", "taxable", "broker"], "loan": ["loan", "mortgage", "studentloan", "auto"], "hsa": ["hsa"], "other": ["other"],
}
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: Column | str, digits: int) -> Column:
    """Scaled, rounded half away from zero, and scaled back."""
    return F.round(_c(x) * 10.0**digits, 0) / 10.0**digits


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at both ends; nothing left is null."""
    return F.nullif(F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", ""), F.lit(""))


def normal_text(x: Column | str) -> Column:
    """Runs of ASCII letters and digits, upper-cased, joined by single spaces; nothing left is null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(_c(x), "[^A-Za-z0-9]+", " "))), F.lit(""))


def fingerprint(x: Column | str) -> Column:
    """The first four identifying tokens of a description; none is null."""
    tokens = F.filter(F.split(normal_text(x), " "), lambda t: ~t.isin(NOISE) & ~t.rlike("^[0-9]+$"))
    return F.nullif(F.array_join(F.slice(tokens, 1, 4), " "), F.lit(""))


def counterparty(merchant: Column | str, description: Column | str) -> Column:
    """Struct of key, source, quality and eligible; null if neither field identifies anyone."""
    m, f = normal_text(merchant), fingerprint(description)
    n = F.size(F.split(f, " "))
    quality = F.when(n == 1, 0.55).when(n == 2, 0.8).when(n == 3, 0.85).otherwise(0.9)
    strong = F.struct(m.alias("key"), F.lit("merchant").alias("source"), F.lit(1.0).alias("quality"), F.lit(True).alias("eligible"))
    weak = F.struct(f.alias("key"), F.lit("description").alias("source"), quality.alias("quality"), (n >= 2).alias("eligible"))
    return F.when(m.isNotNull(), strong).when(f.isNotNull(), weak)


def sign_key(amount: Column | str) -> Column:
    return F.when(_c(amount) < 0, "debit").otherwise("credit")


def _clean(x: Column | str, clean: bool) -> Column:
    """Trimmed, unless the caller says that it is: a pattern over a pattern would run again for each use."""
    return _c(x) if clean else trimmed(x)


def valid_date(x: Column | str, clean: bool = False) -> Column:
    """The date of a YYYY-MM-DD text that exists, else null."""
    t = _clean(x, clean)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def effective_scale(x: Column | str, clean: bool = False) -> Column:
    """Decimal places that a number text needs, with its exponent; null if it is no number."""
    t = _clean(x, clean)
    places = F.length(F.regexp_extract(t, r"\.([0-9]*)", 1))
    exponent = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(t.rlike(NUMBER), F.greatest(F.lit(0), places - exponent))


def valid_amount(x: Column | str, clean: bool = False) -> Column:
    """The finite number of a text of at most two effective decimal places, else null."""
    t = _clean(x, clean)
    return amount_at_scale(t, effective_scale(t, True))


def amount_at_scale(t: Column | str, scale: Column | str) -> Column:
    """The same of a clean text whose effective scale is known."""
    v = _c(t).try_cast("double")
    return F.when((_c(scale) <= 2) & (F.abs(v) < float("inf")), v)  # the scale of what is no number is null


def account_type(x: Column | str, clean: bool = False) -> Column:
    """The canonical type of a free text: a known name, or the first rule that one of its tokens meets."""
    key = F.regexp_replace(F.regexp_replace(F.lower(_clean(x, clean)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    tokens = F.split(key, "_")
    out = F.when(F.lit(False), F.lit(""))
    for name, names in TYPE_NAMES.items():
        out = out.when(key.isin(names), name)
    for name, words in TYPE_TOKENS.items():
        meets = F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
        if name == "credit_card":
            meets = meets | (F.array_contains(tokens, "credit") & F.array_contains(tokens, "card"))
        out = out.when(meets, name)
    return out
