"""Document types and their configuration: resolving, versions, catalogues, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names in file names and the type that each means, in order.
FILENAME_TYPES = [("loan agreement", "loan_agreement"), ("credit agreement", "credit_agreement"), ("bsa profile", "bsa_profile"), ("bsa", "bsa_profile"), ("loan package", "loan_package"), ("w2", "w2"), ("w-2", "w2"), ("drivers license", "drivers_license"), ("driver license", "drivers_license")]


def classify_by_filename(docs: DataFrame) -> DataFrame:
    """Unknown documents take the type that their file name holds first in the list, with medium confidence."""
    name = F.regexp_replace(F.lower("file_name"), "[-_]", " ")
    found = F.coalesce(*(F.when(F.contains(name, F.lit(p)), t) for p, t in FILENAME_TYPES))
    unknown = F.coalesce("document_type", F.lit("")).isin("", "unknown")
    return docs.select("document_id", F.when(unknown, F.coalesce(found, F.lit("unknown"))).otherwise(F.col("document_type")).alias("document_type"), F.when(unknown & found.isNotNull(), "medium").otherwise(F.col("confidence")).alias("confidence"))


def resolve_plugin(docs: DataFrame, plugins: DataFrame, legacy: DataFrame) -> DataFrame:
    """By id, else as a section name, else by the legacy name as it is or in upper case. Spark broadcasts these tables by their size."""
    ids = plugins.select(F.col("plugin_id").alias("document_type"), F.col("plugin_id").alias("by_id"))
    names = plugins.select(F.explode("section_names").alias("document_type"), "plugin_id").groupBy("document_type").agg(F.min("plugin_id").alias("by_name"))
    old = legacy.select(F.col("name").alias("document_type"), F.col("plugin_id").alias("by_old"))
    up = legacy.select(F.col("name").alias("upper"), F.col("plugin_id").alias("by_upper"))
    out = docs.join(ids, "document_type", "left").join(names, "document_type", "left").join(old, "document_type", "left").withColumn("upper", F.upper("document_type")).join(up, "upper", "left")
    return out.select("document_id", "document_type", F.coalesce("by_id", "by_name", "by_old", "by_upper").alias("plugin_id"))


def identified_types(docs: DataFrame) -> DataFrame:
    """Sorted names of the types with a start page."""
    return docs.select("document_id", F.array_join(F.sort_array(F.map_keys(F.map_filter("starts", lambda k, v: v.isNotNull()))), ",").alias("types"))


def plugin_catalogue(sections: DataFrame, most: int = 10) -> DataFrame:
    """(plugin_id, keywords, n_sections, needs_signatures, has_pii): the first keywords in section order.

    Only ``most`` keywords of a plugin are ever gathered; its sections have rows of their own (``plugin_sections``).
    """
    words = sections.select("plugin_id", "ordinal", F.posexplode("keywords").alias("pos", "word"))
    first = words.withColumn("r", F.row_number().over(Window.partitionBy("plugin_id").orderBy("ordinal", "pos"))).where(F.col("r") <= most)
    keywords = first.groupBy("plugin_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x.word), ",").alias("keywords"))
    facts = sections.groupBy("plugin_id").agg(F.count("*").alias("n_sections"), F.bool_or("extract_signatures").alias("needs_signatures"), F.bool_or(F.coalesce(F.size("pii_paths") > 0, F.lit(False))).alias("has_pii"))
    return facts.join(keywords, "plugin_id", "left").select("plugin_id", F.coalesce("keywords", F.lit("")).alias("keywords"), "n_sections", "needs_signatures", "has_pii")


def plugin_sections(sections: DataFrame) -> DataFrame:
    """(plugin_id, position, section_id): a row for each section of a plugin, in order."""
    return sections.select("plugin_id", F.row_number().over(Window.partitionBy("plugin_id").orderBy("ordinal")).alias("position"), "section_id")


def active_plugins(files: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Built-in settings overlaid by published ones, leaf by leaf, with their source."""
    live = dynamic.where("status = 'published'").select("plugin_id", "path", F.col("value").alias("new"))
    out = files.join(live, ["plugin_id", "path"], "full")
    return out.select("plugin_id", "path", F.coalesce("new", "value").alias("value"), F.when(F.col("new").isNotNull(), "dynamic").otherwise("file").alias("source"))


def plugin_fields(schemas: DataFrame) -> DataFrame:
    """(plugin_id, section, name, label, type) of the fields of a JSON Schema of two levels: sections with fields.

    The label is the field's description, else its name; types are number, boolean and string. What stands at the
    first level without fields of its own is no section.
    """
    fields = "map<string,struct<type:string,description:string>>"
    sections = F.from_json(F.get_json_object("schema", "$.properties"), f"map<string,struct<properties:{fields}>>")
    rows = schemas.select("plugin_id", F.explode(sections).alias("section", "s")).select("plugin_id", "section", F.explode("s.properties").alias("name", "p"))
    kind = F.when(F.col("p.type").isin("number", "integer"), "number").when(F.col("p.type") == "boolean", "boolean").otherwise("string")
    return rows.select("plugin_id", "section", "name", F.coalesce("p.description", "name").alias("label"), kind.alias("type"))


def wizard_config(fields: DataFrame, most_keywords: int = 20, most_pages: int = 50) -> DataFrame:
    """One section for a flat field list: its first keywords in order, pages and queries."""
    labels = fields.select("plugin_id", F.lower("label").alias("k")).distinct()
    first = labels.withColumn("r", F.row_number().over(Window.partitionBy("plugin_id").orderBy("k"))).where(F.col("r") <= most_keywords)
    keywords = first.groupBy("plugin_id").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("keywords"))
    facts = fields.groupBy("plugin_id").agg(F.least(F.lit(most_pages), F.max("pages")).alias("max_pages"), F.count("*").alias("queries"))
    return facts.join(keywords, "plugin_id").select("plugin_id", "keywords", "max_pages", "queries")


def label_kind(name: Column, value: Column) -> Column:
    """Whether a value is shown as money, a percentage or a number, by its key and size."""
    low = F.lower(name)
    has = lambda *words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
    return F.when(has("rate", "percent", "pct") & (F.abs(value) <= 1), "percent").when(has("amount", "price", "balance", "payment", "fee", "total"), "money").otherwise("number")


def grounded_in(value: Column, text: Column) -> Column:
    """Whether a value occurs in a text: as normalised text, by a number of three digits or more, or by a longer word."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    numbers = lambda c: F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"\d{3,}"), F.lit(0))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{5,}"), F.lit(0))
    return F.contains(plain(text), plain(value)) | F.arrays_overlap(numbers(value), numbers(text)) | F.arrays_overlap(words(value), words(text))


def visible_rows(users: DataFrame) -> DataFrame:
    """Who may see and who may change personal data, by roles."""
    has = lambda *roles: F.arrays_overlap("roles", F.array(*(F.lit(r) for r in roles)))
    return users.select("user_id", has("Admins").alias("can_view"), has("Admins", "Reviewers").alias("can_modify"))


def backfill_stats(rows: DataFrame) -> DataFrame:
    """(scanned, encrypted, skipped, empty) of a pass over stored records."""
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("value").isNotNull() & (F.col("value") != "[ENCRYPTED]")).alias("encrypted"), F.count_if(F.col("value") == "[ENCRYPTED]").alias("skipped"), F.count_if(F.col("value").isNull()).alias("empty"))


def summary_by_type(docs: DataFrame, columns: dict[str, dict[str, str]]) -> DataFrame:
    """One headline row a document: for each type its own columns; the rest is null."""
    out = None
    for kind, own in columns.items():
        part = docs.where(F.col("document_type") == kind).select("document_id", "document_type", *(F.col(c).alias(a) for a, c in own.items()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
