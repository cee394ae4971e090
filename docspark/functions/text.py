"""Text functions: Column in, Column out, native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of which readable text should hold some.
COMMON_WORDS = [
    "the", "and", "for", "that", "this", "with", "from", "have", "date", "loan", "amount", "payment", "interest", "rate",
    "borrower", "lender", "agreement", "note", "shall", "will", "section", "article", "page", "total", "principal",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space in the sense of these operators.
BLANKS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def without_blanks(c: Column) -> Column:
    for x in BLANKS:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _measures(text: Column) -> Column:
    """struct(n, glyph, alnum, special, found, stripped) of a text: shares but for n, found and stripped.

    ``found`` counts common words up to five, as more make no difference. The shares of an empty text are 0.
    """
    n = F.length(text)
    words = F.array(*(F.lit(w) for w in COMMON_WORDS))
    found = let(F.lower(text), lambda low: F.aggregate(words, F.lit(0), lambda a, w: F.when(a >= 5, a).otherwise(a + F.contains(low, w).cast("int"))))
    glyphs = F.regexp_count(text, F.lit(r"/\d+\s*/\d+"))
    dense = let(without_blanks(text), lambda x: F.struct(F.length(x).alias("n"), F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")).alias("alnum")))
    raw = F.struct(n.alias("n"), glyphs.alias("glyphs"), dense.alias("dense"), found.alias("found"), F.length(strip(text)).alias("stripped"))
    return let(raw, lambda m: F.struct(m.n.alias("n"), (m.glyphs / F.greatest(F.lit(1.0), m.n / 10)).alias("glyph"), (m.dense.alnum / F.greatest(m.n, F.lit(1))).alias("alnum"), ((m.dense.n - m.dense.alnum) / F.greatest(m.n, F.lit(1))).alias("special"), m.found.alias("found"), m.stripped.alias("stripped")))


def text_quality(text: Column) -> Column:
    """struct(quality_score, is_readable, issues, has_text) of a page's text; each measure is computed once."""

    def judged(m: Column) -> Column:
        score = (1.0 - F.least(F.lit(1.0), m.glyph * 10)) * 0.4 + m.alnum * 0.3 + F.least(F.lit(1.0), m.found / 5) * 0.3
        issue = lambda cond, name: F.when(cond, F.lit(name))
        issues = F.array_compact(F.array(issue(m.glyph > 0.05, "glyph_indices_detected"), issue(m.alnum < 0.3, "low_alphanumeric_ratio"), issue(m.found == 0, "no_common_words"), issue(m.special > 0.3, "high_special_char_ratio")))
        has_text = (m.stripped > 50).alias("has_text")
        bad = F.struct(F.lit(0.0).alias("quality_score"), F.lit(False).alias("is_readable"), F.array(F.lit("insufficient_text")).alias("issues"), has_text)
        good = let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), lambda x: F.struct(x.alias("quality_score"), ((x >= 0.4) & (m.glyph <= 0.05)).alias("is_readable"), issues.alias("issues"), has_text))
        return F.when(m.stripped < 10, bad).otherwise(good)

    return let(_measures(F.coalesce(text, F.lit(""))), judged)


def token_estimate(text: Column, cut: int = 3000) -> Column:
    return F.floor(F.length(F.substring(text, 1, cut)) / 4).cast("int")


def truncated(text: Column, cap: int, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(marker))).otherwise(text)


def content_hash(c: Column, algorithm: str = "sha256") -> Column:
    found = {"sha256": lambda x: F.sha2(x, 256), "md5": F.md5, "sha1": F.sha1}.get(algorithm)
    if found is None:
        raise ValueError(f"unknown hash {algorithm!r}")
    return found(c)


def composite_fingerprint(digest: Column, name: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", digest, name, size.cast("string")), 256), 1, 32)


def multipart_etag(data: Column, part: int) -> Column:
    """md5 up to one part; else md5 of the parts' md5 bytes and the number of parts."""
    data = data.cast("binary")
    n = F.ceil(F.octet_length(data) / part).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.unhex(F.md5(F.substring(data, (k - 1) * part + 1, F.lit(part)))))
    joined = F.aggregate(each, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return F.when(n <= 1, F.md5(data)).otherwise(F.concat(F.md5(joined), F.lit("-"), n.cast("string")))
