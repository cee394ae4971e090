"""Small configuration tables that the registered queries use, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: section_id, ordinal, priority, keywords, min_matches, max_pages, extract_signatures, search_last_pages
SECTIONS = [
    ("s_en", 1, 2, ["the", "and", "that", "with", "tion", "of"], 4, 3, False, False),
    ("s_fr", 2, 3, ["que", "pour", "ieu", "éta", "les", "è"], 3, 2, False, False),
    ("s_es", 3, 3, ["ción", "de", "los", "que", "ñ"], 3, 2, False, False),
    ("s_de", 4, 4, ["sch", "und", "ch", "ein", "ß"], 3, 2, False, False),
    ("s_junk", 5, 1, ["###", "&&&", "***", "%%%", "license", "@"], 1, 4, False, False),
    ("s_sig", 6, 5, ["of"], 3, 2, True, True),
    ("s_front", 7, 6, [], 1, 1, False, False),
]
#: section_id, condition, patterns, bonus
RULES = [
    ("s_en", "first_n_pages", ["2"], 1),
    ("s_es", "contains_all", ["los", "que"], 2),
    ("s_de", "regex_match", [r"(^|[^\p{L}])und([^\p{L}]|$)"], 1),
    ("s_junk", "contains_any", ["@"], 5),
    ("s_sig", "last_n_pages", ["2"], 10),
]


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section_id string, ordinal int, priority int, keywords array<string>, min_matches int, max_pages int, extract_signatures boolean, search_last_pages boolean")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "section_id string, condition string, patterns array<string>, bonus int")


def _sql(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql, x)) + "]" + ("::VARCHAR[]" if not x else "")
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def values(rows: list[tuple], columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") v({columns}))"


SECTIONS_SQL = f"sections AS {values(SECTIONS, 'section_id, ordinal, priority, keywords, min_matches, max_pages, extract_signatures, search_last_pages')}"
RULES_SQL = f"rules AS {values(RULES, 'section_id, condition, patterns, bonus')}"
