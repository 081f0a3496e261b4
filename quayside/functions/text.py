"""Text column functions.

Every function takes and returns ``Column`` and compiles to built-in
expressions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (reference semantics) -----------------------------------
# SQL guard: forbidden whole words, case-insensitive.
FORBIDDEN_WORDS = ["insert", "update", "delete", "drop", "alter", "truncate", "grant",
                   "revoke", "create", "call", "copy", "vacuum", "do", "execute", "merge",
                   "comment", "pg_sleep"]
SAFE_START = r"(?is)^\s*(with\b.*\)\s*)?select\b"
FORBIDDEN = r"(?i)\b(" + "|".join(FORBIDDEN_WORDS) + r")\b"
DDL_GUARD = r"(?i)^\s*CREATE\s+(UNIQUE\s+)?INDEX\b"
DDL_EXTRACT = r"(?i)(CREATE\s+(?:UNIQUE\s+)?INDEX\b[^;]*;)"
FENCE = r"(?i)^```(json|sql)?\s*|\s*```$"
EXEC_TIME = r"Execution Time:\s*([0-9.]+) ms"
# Redaction patterns (RE2- and Java-compatible: no look-around).
REDACT_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    # a country code or an area code in brackets before the groups, or three groups of
    # 3, 3 and 4 digits: plain digit runs and dotted quads are not phone numbers
    ("phone", r"\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)|[0-9]{1,4})([ .-]?[0-9]{2,4}){1,4}\b"
              r"|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}\b"
              r"|\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b"),
    ("money", r"[$€£] ?[0-9][0-9,]*(\.[0-9]+)?"),
    ("percent", r"[0-9]+(\.[0-9]+)? ?%"),
]
REDACTED = "[REDACTED]"
# Cheap necessary conditions for each pattern.
REDACT_NEEDS = {"email": "@", "money": "[$€£]", "percent": "%"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def star_after_first(x) -> Column:
    """Keep the first character, replace every later one (newlines too) by '*'.
    Same result as a global look-behind replace of ``(?s)(?<=.).``, written as
    plain string functions (no regex per character)."""
    c = _c(x)
    return F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(c) - 1, F.lit(0))))


def mask_contact(name, email) -> Column:
    """``N*** S***  <l****@domain>``.  First two words of the name keep
    their first letter (a missing second word leaves an empty part, hence the
    trailing blank); the e-mail's local part keeps one letter; no '@' gives
    an empty domain; any NULL input gives NULL."""
    n, e = _c(name), _c(email)
    local = F.split_part(e, F.lit("@"), F.lit(1))
    return F.concat(
        star_after_first(F.split_part(n, F.lit(" "), F.lit(1))), F.lit(" "),
        star_after_first(F.split_part(n, F.lit(" "), F.lit(2))), F.lit("  <"),
        F.left(local, F.lit(1)),
        F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(0))),
        F.lit("@"), F.split_part(e, F.lit("@"), F.lit(2)), F.lit(">"))


def is_safe_select(sql) -> Column:
    """No ';' anywhere, starts with SELECT (optionally after a leading
    WITH ... ')'), and none of the forbidden words as whole words."""
    s = _c(sql)
    return (~s.rlike(";")) & s.rlike(SAFE_START) & (~s.rlike(FORBIDDEN))


def is_index_ddl(ddl) -> Column:
    """P10: the statement is a CREATE [UNIQUE] INDEX."""
    return _c(ddl).rlike(DDL_GUARD)


def pg_substring(x, pattern: str, group: int = 1) -> Column:
    """``substring(x FROM pattern)``: first group, NULL when no match
    (``regexp_extract`` gives '' instead, which ANSI casts reject)."""
    return F.nullif(F.regexp_extract(_c(x), pattern, group), F.lit(""))


def extract_ddl(reply) -> Column:
    """The first CREATE INDEX statement in free text, else the trimmed text."""
    return F.coalesce(pg_substring(reply, DDL_EXTRACT), F.trim(_c(reply)))


def strip_fence(x) -> Column:
    """drop a leading ```json / ```sql fence and a trailing ``` fence."""
    return F.regexp_replace(F.trim(_c(x)), FENCE, "")


def strip_trailing_semicolon(x) -> Column:
    """F5."""
    return F.regexp_replace(F.trim(_c(x)), r";\s*$", "")


def clean_sql(x) -> Column:
    return strip_trailing_semicolon(strip_fence(x))


def pg_text(x) -> Column:
    """Postgres ``format('%s', NULL)`` prints '', Spark prints 'null'."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def split_list(x, sep: str = ",") -> Column:
    """a comma / semicolon list stored in text as a trimmed array."""
    return F.transform(F.split(_c(x), sep), lambda v: F.trim(v))


def short_id(x) -> Column:
    """session short id: dashes dropped, first 8 characters."""
    return F.left(F.replace(_c(x), F.lit("-"), F.lit("")), F.lit(8))


def redact(x, kinds: list[str] | None = None) -> Column:
    """D14 (pattern part): replace e-mails, phone numbers, money amounts and
    percentages by [REDACTED], in that order, over the whole text."""
    out = _c(x)
    for kind, pat in REDACT_PATTERNS:
        if kinds is None or kind in kinds:
            # a literal pre-check skips the regex on texts that cannot match
            need = REDACT_NEEDS.get(kind)
            rep = F.regexp_replace(out, pat, REDACTED)
            out = rep if need is None else F.when(out.rlike(need), rep).otherwise(out)
    return out


def redact_sql(col: str, kinds: list[str] | None = None) -> str:
    """DuckDB twin of :func:`redact` for the oracle."""
    out = col
    for kind, pat in REDACT_PATTERNS:
        if kinds is None or kind in kinds:
            out = f"regexp_replace({out}, '{pat}', '{REDACTED}', 'g')"
    return out
