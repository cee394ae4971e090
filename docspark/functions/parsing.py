"""Parsing and validation of single values: Column in, Column out, null where a value cannot be parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import strip

#: Address abbreviations, in the order in which they are replaced.
ADDRESS = [(" st.", " Street"), (" st,", " Street,"), (" ave.", " Avenue"), (" ave,", " Avenue,"), (" blvd.", " Boulevard"), (" blvd,", " Boulevard,"), (" dr.", " Drive"), (" dr,", " Drive,"), (" ln.", " Lane"), (" ln,", " Lane,"), (" rd.", " Road"), (" rd,", " Road,")]
TRUE, FALSE = ["true", "yes", "y", "1", "x", "checked"], ["false", "no", "n", "0", "", "unchecked"]
#: Date patterns in the order in which they are tried.
DATES = ["y-M-d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yy"]


def _double(c: Column) -> Column:
    return c.try_cast("double")


def parse_number(c: Column) -> Column:
    return _double(F.regexp_replace(strip(c), "[, ]", ""))


def parse_currency(c: Column) -> Column:
    plain = F.regexp_replace(strip(c), "[$€£¥, ]", "")
    return _double(F.regexp_replace(plain, r"^\((.*)\)$", "-$1"))


def normal_currency(c: Column) -> Column:
    """The normaliser's form: only dollar signs and commas are taken out."""
    return _double(F.regexp_replace(c, "[$,]", ""))


def parse_percentage(c: Column) -> Column:
    """Text keeps its number: 6.5% is 6.5."""
    return _double(F.regexp_replace(strip(c), "[% ]", ""))


def ratio_of_number(c: Column) -> Column:
    """Numbers above 1 are percentages."""
    return F.when(c <= 1, c.cast("double")).otherwise(c.cast("double") / 100)


def normal_percentage(c: Column) -> Column:
    """The normaliser's form: always a ratio."""
    return _double(F.regexp_replace(strip(c), "%", "")) / 100


def parse_bps(c: Column) -> Column:
    return _double(F.nullif(F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*(?:bps|basis points)", 1), F.lit(""))) / 10000


def parse_date(c: Column) -> Column:
    """ISO text by the first pattern that fits, else the stripped input."""
    text = strip(c)
    shape = {"y-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$"}
    tried = [F.when(text.rlike(shape.get(p, r"^[A-Za-z]+ \d{1,2}, \d{4}$")), F.try_to_date(text, p)) for p in DATES]
    return F.coalesce(*(F.date_format(t, "yyyy-MM-dd") for t in tried), text)


def parse_boolean(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def normalize_address(c: Column) -> Column:
    rules = F.array(*(F.struct(F.lit(short).alias("short"), F.lit(full).alias("full")) for short, full in ADDRESS))

    def replace_first(text: Column, rule: Column) -> Column:
        at = F.call_function("locate", rule.short, F.lower(text))
        tail = F.substring(text, at + F.length(rule.short), F.length(text))
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), rule.full, tail)).otherwise(text)

    return F.aggregate(rules, strip(c), replace_first)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def normalize_phone(c: Column) -> Column:
    d = _digits(c)
    part = lambda at: F.concat(F.lit("("), F.substring(d, at, 3), F.lit(") "), F.substring(d, at + 3, 3), F.lit("-"), F.substring(d, at + 6, 4))
    return F.when(F.length(d) == 10, part(1)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), part(2))).otherwise(F.regexp_replace(c, "[^0-9+]", ""))


def valid_phone(c: Column) -> Column:
    return F.length(_digits(c)) >= 10


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def valid_email(c: Column) -> Column:
    return normalize_email(c).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def format_ssn(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))).otherwise(c)


def format_ein(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 7))).otherwise(c)


def valid_nine(c: Column) -> Column:
    return F.length(_digits(c)) == 9


def confidence_band(c: Column) -> Column:
    return F.when(c >= 90, "high").when(c >= 75, "medium").otherwise("low")


def score_band(c: Column) -> Column:
    return F.when(c >= 90, "good").when(c >= 50, "fair").otherwise("poor")


def _masked(stars: str, plain: Column, n: int) -> Column:
    """The last n characters behind the stars; stars only for shorter values."""
    return F.when(F.length(plain) >= n, F.concat(F.lit(stars), F.right(plain, F.lit(n)))).otherwise(stars + "*" * n)


def mask_value(c: Column, kind: Column) -> Column:
    """What a viewer without the right to personal data sees."""
    plain = F.regexp_replace(c, "[- ]", "")
    return F.when(kind == "ssn", _masked("***-**-", plain, 4)).when(kind == "tax_id", _masked("**-***", plain, 4)).when(kind == "dob", F.lit("****-**-**")).otherwise("**REDACTED**")


def redact_value(c: Column, kind: Column) -> Column:
    """The form for logs: a birth date keeps its year, a government id its end."""
    d = _digits(c)
    year = F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit(""))
    born = F.when(year.isNotNull(), F.concat(F.lit("****-**-** ("), year, F.lit(")"))).otherwise("****-**-**")
    number = F.when(F.length(c) >= 4, F.concat(F.lit("****"), F.right(c, F.lit(4)))).otherwise("****")
    return F.when(kind == "ssn", _masked("***-**-", d, 4)).when(kind == "tax_id", _masked("**-***", d, 4)).when(kind == "dob", born).when(kind == "government_id", number).otherwise("[REDACTED]")
