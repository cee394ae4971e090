"""Cleaning up extracted results: tables by header, payloads, nested trees, names to redact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from docspark.functions import parsing as V
from docspark.operators.shared import beside, materialize

#: Field names that are redacted wherever they stand, and the kind of each.
PRIVATE = {"ssn": "ssn", "social_security_number": "ssn", "tax_id": "tax_id", "taxid": "tax_id", "ein": "tax_id", "dob": "dob", "date_of_birth": "dob", "dateofbirth": "dob", "license_number": "government_id", "passport": "government_id"}


def map_columns(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_id, role, position): each header cell takes the first rule whose substring it holds; of a
    role's columns the last counts. ``tables`` has header; rules (ordinal, part, role) are configuration."""
    cells = tables.select("table_id", F.posexplode("header").alias("position", "cell"))
    named = beside(cells, rules, F.contains(F.lower("cell"), F.col("part"))).groupBy("table_id", "position").agg(F.min_by("role", "ordinal").alias("role"))
    return named.groupBy("table_id", "role").agg(F.max("position").alias("position"))


def rebuild_rows(rows: DataFrame, roles: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, row_no, name, share, amount) of tables with more usable rows than the current list has.

    A row needs a name, and its first cell must not be a total. ``current`` has table_id and n.
    """
    wide = roles.groupBy("table_id").agg(*(F.max(F.when(F.col("role") == r, F.col("position"))).alias(f"at_{r}") for r in ("name", "share", "amount")))
    cell = lambda r: F.get("cells", F.col(f"at_{r}"))
    kept = rows.join(wide, "table_id").where(~F.upper(F.trim(F.get("cells", F.lit(0)))).startswith("TOTAL") & (F.trim(F.coalesce(cell("name"), F.lit(""))) != ""))
    parsed = kept.select("table_id", "row_no", F.trim(cell("name")).alias("name"), V.normal_percentage(cell("share")).alias("share"), V.normal_currency(cell("amount")).alias("amount"))
    enough = parsed.groupBy("table_id").agg(F.count("*").alias("k")).join(current, "table_id", "left").where((F.col("k") >= 2) & (F.col("k") > F.coalesce("n", F.lit(0)))).select("table_id")
    return parsed.join(enough, "table_id", "left_semi")


def rebuild_tiers(rows: DataFrame, roles: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, row_no, level, term_spread, base_spread, fee_rate) of pricing tables with more rows than the
    current list of tiers has; other tables keep their list and give no row.

    Roles are level, term, base and fee (see ``map_columns``); spreads and fees are read as percentages. A row
    without any of the four is left out. ``current`` has table_id and n.
    """
    names = {"level": "level", "term": "term_spread", "base": "base_spread", "fee": "fee_rate"}
    wide = roles.groupBy("table_id").agg(*(F.max(F.when(F.col("role") == r, F.col("position"))).alias(f"at_{r}") for r in names))
    enough = rows.groupBy("table_id").agg(F.count("*").alias("k")).join(current, "table_id", "left").where(F.col("k") > F.coalesce("n", F.lit(0))).select("table_id")
    cell = lambda r: F.get("cells", F.col(f"at_{r}"))
    out = rows.join(enough, "table_id", "left_semi").join(wide, "table_id")
    out = out.select("table_id", "row_no", F.trim(cell("level")).alias("level"), *(V.normal_percentage(cell(r)).alias(a) for r, a in names.items() if r != "level"))
    return out.where(F.coalesce("level", *(F.col(a).cast("string") for a in names.values())).isNotNull())


def first_table(extractions: DataFrame) -> DataFrame:
    """(doc_id, section_id, table_id): the first table of a section's first extraction that has one."""
    return extractions.where("table_id is not null").groupBy("doc_id", "section_id").agg(F.min_by("table_id", F.struct("seq", "idx")).alias("table_id"))


def unwrap_payload(rows: DataFrame) -> DataFrame:
    """The loan data of a payload, else all of it but its bookkeeping, as JSON; nested values stay as they are."""
    rest = F.map_filter(F.from_json("payload", "map<string,variant>"), lambda k, v: ~k.isin("validation", "audit", "signatures"))
    return rows.select("doc_id", F.coalesce(F.get_json_object("payload", "$.loanData"), F.to_json(rest)).alias("data"))


def clean_extraction(rows: DataFrame, cap: int = 5000) -> DataFrame:
    """Answers without bookkeeping keys, raw text cut with the number of characters left out."""
    n = F.length("raw_text")
    cut = F.when(n > cap, F.concat(F.substring("raw_text", 1, cap), F.lit("... ["), (n - cap).cast("string"), F.lit(" more]"))).otherwise(F.col("raw_text"))
    return rows.select("doc_id", F.map_filter("answers", lambda k, v: ~k.startswith("_")).alias("answers"), cut.alias("raw_text"))


def strip_geometry(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Only the named fields of a struct column."""
    own = [f.name for f in rows.schema[column].dataType.fields]
    return rows.withColumn(column, F.col(column).dropFields(*(f for f in own if f not in keep)))


def amendment_cleanup(rows: DataFrame) -> DataFrame:
    """An amended and restated agreement has no amendment number, unless the number says so itself."""
    restated = F.contains(F.lower("title"), F.lit("amended and restated"))
    return rows.withColumn("number", F.when(restated & ~F.coalesce(F.lower("number").startswith("amendment no"), F.lit(False)), None).otherwise(F.col("number")))


def nav_hits(nodes: DataFrame, terms: list[str], most: int = 6) -> DataFrame:
    """(doc_id, seq, hits): a document's nodes with the most question terms in title or summary."""
    from pyspark.sql.window import Window

    text = F.lower(F.concat_ws(" ", "title", "summary"))
    hits = sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "seq")
    return nodes.select("doc_id", "seq", hits.alias("hits")).where("hits > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def flatten_tree(trees: DataFrame, levels: int = 8) -> DataFrame:
    """(doc_id, path, title): the nodes of nested JSON, however deep; a node's path is its place on each level, so
    that the order of paths is preorder (below 1000 siblings). What is no JSON gives no rows.

    Each step puts a node's children beside it; ``levels`` steps are made at a time, until no children are left.
    """
    kids = lambda v, at: F.try_variant_get(v, at, "array<variant>")

    def child(path: Column, v: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        own = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
        return F.struct(F.concat_ws(".", path, own).alias("path"), F.try_variant_get(v, "$.title", "string").alias("title"), kids(v, "$.nodes").alias("kids"))

    def opened(step: DataFrame) -> DataFrame:
        own = F.struct("path", "title", F.lit(None).cast("array<variant>").alias("kids"))
        both = F.concat(F.when(F.col("path").isNotNull(), F.array(own)).otherwise(F.array().cast("array<struct<path:string,title:string,kids:array<variant>>>")), F.transform(F.coalesce("kids", F.array().cast("array<variant>")), lambda v, i: child(F.col("path"), v, i)))
        return step.select("doc_id", F.explode(both).alias("n")).select("doc_id", "n.*")

    step = trees.select("doc_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("title"), kids(F.try_parse_json("tree"), "$").alias("kids"))
    flat = None
    while True:
        for _ in range(levels):
            step = opened(step)
        step = materialize(step)
        more = F.coalesce(F.size("kids") > 0, F.lit(False))
        done = step.where(~more).select("doc_id", "path", "title")
        flat, step = done if flat is None else flat.unionByName(done), step.where(more)
        if step.isEmpty():
            return flat
        # The nodes themselves are done; their children are not.
        flat = flat.unionByName(step.select("doc_id", "path", "title"))
        step = step.select("doc_id", F.posexplode("kids").alias("i", "v"), "path").select("doc_id", child(F.col("path"), F.col("v"), F.col("i")).alias("n")).select("doc_id", "n.*")


def redact_by_name(df: DataFrame) -> DataFrame:
    """Every text field with a private name redacted, at any depth; the schema is walked when the plan is made."""

    def walk(c: Column, kind, name: str) -> Column:
        if isinstance(kind, StructType):
            for f in kind.fields:
                if _touches(f.dataType, f.name):
                    c = c.withField(f.name, walk(c[f.name], f.dataType, f.name))
            return c
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name))
        return F.when(c.isNotNull(), V.redact_value(c, F.lit(PRIVATE[name.lower()])))

    return df.withColumns({f.name: walk(F.col(f.name), f.dataType, f.name) for f in df.schema.fields if _touches(f.dataType, f.name)})


def _touches(kind, name: str) -> bool:
    if isinstance(kind, StructType):
        return any(_touches(f.dataType, f.name) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _touches(kind.elementType, name)
    return isinstance(kind, StringType) and name.lower() in PRIVATE


def schema_subset(defs: DataFrame, required: bool | None = None, pii: bool | None = None) -> DataFrame:
    """(schema_id, position, field_id): a schema's fields in order, all or those required or private; a row each."""
    from pyspark.sql.window import Window

    rows = defs
    for column, want in (("required", required), ("pii", pii)):
        if want is not None:
            rows = rows.where(F.col(column) == want)
    return rows.select("schema_id", F.row_number().over(Window.partitionBy("schema_id").orderBy("field_id")).alias("position"), "field_id")
