"""Scoring profiles of two agreement types, as rules of the section operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: section_id, condition, patterns, bonus. Steps of position add up: the last three pages get 5 + 5.
LEGACY_RULES = [
    ("agreementInfo", "first_n_pages", ["5"], 1),
    ("lenderCommitments", "contains_any", ["schedule 2.01", "schedule 1.01", "schedule of commitments", "commitment schedule", "lender schedule", "schedule i", "commitments and applicable percentages"], 10),
    ("lenderCommitments", "contains_any", ["100.00%", "100.000000%", "applicable percentage", "pro rata share"], 5),
    ("lenderCommitments", "contains_with", ["$", "bank", "capital", "chase", "wells fargo", "citibank"], 3),
    ("signatures", "last_n_pages", ["3"], 5),
    ("signatures", "last_n_pages", ["5"], 5),
    ("signatures", "contains_any", ["witness whereof", "in witness"], 5),
    ("signatures", "contains_all", ["executed", "date"], 3),
    ("loanTerms", "first_n_pages", ["3"], 2),
    ("loanTerms", "first_n_pages", ["5"], 1),
    ("parties", "first_n_pages", ["3"], 3),
]


def legacy_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEGACY_RULES, "section_id string, condition string, patterns array<string>, bonus int")


def legacy_defaults(selected: DataFrame, pages: DataFrame, first: int = 5, last: int = 3) -> DataFrame:
    """(doc_id, section_id, page_number): the selection with its two defaults: agreementInfo is always the first
    pages of a document, whatever was selected, and signatures its last ones where none was selected."""
    seen = pages.select("doc_id", "page_number", "total_pages")
    info = seen.where(F.col("page_number") <= first).select("doc_id", F.lit("agreementInfo").alias("section_id"), "page_number")
    others = selected.where("section_id <> 'agreementInfo'").select("doc_id", "section_id", "page_number")
    signed = selected.where("section_id = 'signatures'").select("doc_id").distinct()
    tail = seen.where(F.col("page_number") > F.col("total_pages") - last).join(signed, "doc_id", "left_anti").select("doc_id", F.lit("signatures").alias("section_id"), "page_number")
    return info.unionByName(others).unionByName(tail)
