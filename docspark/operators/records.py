"""Records of extracted values: OCR tables, answers, validation, defaults, cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import parsing as V
from docspark.operators.privacy import decrypt_paths, encrypt_paths
from docspark.operators.shared import beside, materialize


def block_edges(blocks: DataFrame) -> DataFrame:
    """(doc_id, parent, type, child, position) from OCR blocks with relationship lists."""
    rel = blocks.select("doc_id", F.col("id").alias("parent"), F.explode("relationships").alias("r"))
    return rel.select("doc_id", "parent", F.col("r.type").alias("type"), F.posexplode("r.ids").alias("position", "child"))


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, text) of a dense grid; of cells at one place the first counts, gaps are empty.

    ``cells`` has table_id, row_index, col_index, text, position.
    """
    size = cells.groupBy("table_id").agg(F.max("row_index").alias("rows"), F.max("col_index").alias("cols"))
    grid = size.select("table_id", F.explode(F.sequence(F.lit(1), "rows")).alias("row_index"), "cols").select("table_id", "row_index", F.explode(F.sequence(F.lit(1), "cols")).alias("col_index"))
    first = cells.groupBy("table_id", "row_index", "col_index").agg(F.min_by("text", "position").alias("text"))
    return grid.join(first, ["table_id", "row_index", "col_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


#: The type of a block's edges in ``key_values``.
LINKS = "array<struct<type:string,position:int,child:string>>"


def _with_links(blocks: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``blocks`` with ``links``: the edges that are given, else those of the blocks' own relationships."""
    if edges is not None:
        given = edges.groupBy("doc_id", F.col("parent").alias("id")).agg(F.collect_list(F.struct("type", "position", "child")).alias("links"))
        return blocks.drop("links").join(given, ["doc_id", "id"], "left").withColumn("links", F.coalesce("links", F.array().cast(LINKS)))
    own = F.flatten(F.transform("relationships", lambda r: F.transform(r.ids, lambda c, i: F.struct(r.type.alias("type"), i.alias("position"), c.alias("child")))))
    return blocks.withColumn("links", F.coalesce(own, F.array().cast(LINKS)))


def key_values(blocks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, value, confidence): key and value blocks joined through their edges and words; the last of a key counts.

    Without ``edges``, those of the blocks' own relationships count. Ids are unique within a document. What a block says of
    itself and what others ask of it are rows of one table that meet in windows of (doc_id, id), first for values, then for
    words. So blocks that are dealt by document stay where they are, and nothing is shuffled again.
    """
    here = Window.partitionBy("doc_id", "id")
    words = F.transform(F.filter("links", lambda x: x.type == "CHILD"), lambda x: F.struct(x.position.alias("position"), x.child.alias("child")))
    values = F.transform(F.filter("links", lambda x: x.type == "VALUE"), lambda x: x.child)
    # A key without a value asks for none.
    values = F.when(F.array_contains("entity_types", "KEY"), F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("string"))))
    own = F.struct("id", F.when(F.col("id").isNotNull(), F.struct("text", "confidence", words.alias("words"))).alias("own"), F.lit(None).alias("key"))
    asked = F.transform(values, lambda v: F.struct(v.alias("id"), F.lit(None).alias("own"), F.struct(F.col("id").alias("parent"), F.col("confidence").alias("kc"), words.alias("words")).alias("key")))
    rows = _with_links(blocks, edges).select("doc_id", F.explode(F.concat(F.array(own), F.coalesce(asked, F.array()))).alias("r")).select("doc_id", "r.*").withColumn("own", F.max("own").over(here))

    pair = F.struct(F.col("key.parent").alias("parent"), F.col("id").alias("child"), F.col("key.kc").alias("kc"), F.col("own.confidence").alias("vc"))
    ask = lambda words, of_key: F.transform(words, lambda w: F.struct(w.child.alias("id"), F.lit(None).alias("text"), F.struct(pair.alias("pair"), F.lit(of_key).alias("of_key"), w.position.alias("position")).alias("word")))
    told = F.when(F.col("own.text").isNotNull(), F.array(F.struct("id", F.col("own.text").alias("text"), F.lit(None).alias("word"))))
    wanted = F.concat(ask(F.col("key.words"), True), F.coalesce(ask(F.col("own.words"), False), F.array()))
    rows = rows.select("doc_id", F.explode(F.when(F.col("key").isNull(), told).otherwise(wanted)).alias("r")).select("doc_id", "r.*")
    found = rows.withColumn("text", F.max("text").over(here)).where("word is not null and text is not null")

    joined = lambda of_key: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("word.of_key") == of_key, F.struct("word.position", "text")))), lambda x: x.text), " ")
    pairs = found.groupBy("doc_id", "word.pair").agg(joined(True).alias("key"), joined(False).alias("value")).where("trim(key) <> ''")
    confidence = F.when(F.coalesce("pair.vc", F.lit(0.0)) == 0, F.col("pair.kc")).otherwise(F.least("pair.kc", "pair.vc"))
    rows = pairs.select("doc_id", "key", "pair.parent", "value", confidence.alias("confidence"))
    return rows.groupBy("doc_id", "key").agg(F.max_by(F.struct("value", "confidence"), "parent").alias("v")).select("doc_id", "key", "v.value", "v.confidence")


def query_answers(asked: DataFrame, answers: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Every query asked with its answer, or the reason why it has none."""
    out = asked.join(answers, ["doc_id", "query"], "left")
    status = F.when(F.col("confidence").isNull(), "query_not_processed").when(F.coalesce("answer", F.lit("")) == "", "no_answer_found").otherwise("answered")
    return out.select("doc_id", "query", F.coalesce("answer", F.lit("")).alias("answer"), status.alias("status"), F.coalesce(F.col("confidence") >= threshold, F.lit(False)).alias("meets_threshold"))


def lines_to_text(lines: DataFrame) -> DataFrame:
    """``lines`` has doc_id, position, text, confidence."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x.text), "\n")
    return lines.groupBy("doc_id").agg(joined.alias("text"), F.count("*").alias("line_count"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("word_count"), F.avg("confidence").alias("mean_confidence"))


def best_answer_per_query(answers: DataFrame) -> DataFrame:
    """The surest answer of each query over pages; ties go to the lowest page, empty answers do not count."""
    kept = answers.where("answer <> ''").groupBy("doc_id", "query").agg(F.min_by(F.struct("answer", "confidence", "page_number"), F.struct(-F.col("confidence"), "page_number", "answer")).alias("b"))
    return kept.select("doc_id", "query", "b.*")


def best_value_per_key(values: DataFrame) -> DataFrame:
    """(doc_id, key, value, confidence, page_number): the surest value of each form field over pages; of equally
    sure ones the earliest page's. Empty values count, and a missing confidence is 0."""
    sure = F.coalesce("confidence", F.lit(0.0))
    best = F.min_by(F.struct("value", sure.alias("confidence"), "page_number"), F.struct(-sure, "page_number", "value"))
    return values.groupBy("doc_id", "key").agg(best.alias("b")).select("doc_id", "key", "b.*")


def signatures(blocks: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(doc_id, page, id, confidence, meets_threshold) of the signature blocks; a missing confidence is 0."""
    sure = F.coalesce("confidence", F.lit(0.0))
    return blocks.where("block_type = 'SIGNATURE'").select("doc_id", "page", "id", sure.alias("confidence"), (sure >= threshold).alias("meets_threshold"))


def tables_in_page_order(tables: DataFrame) -> DataFrame:
    """(doc_id, tables, failed): table ids in page order; failed only if every page failed."""
    ids = F.transform(F.sort_array(F.collect_list(F.when(~F.col("failed"), F.struct("page_number", "idx", "table_id")))), lambda x: x.table_id)
    return tables.groupBy("doc_id").agg(F.array_join(ids, ",").alias("tables"), F.bool_and("failed").alias("failed"))


def remap_page_index(rows: DataFrame, pages: str) -> DataFrame:
    return rows.withColumn("page_number", F.try_element_at(F.col(pages), F.col("page_index")))


def extraction_quality(rows: DataFrame, threshold: float = 85.0) -> DataFrame:
    low = F.slice(F.transform(F.sort_array(F.collect_set(F.when(F.col("confidence") < threshold, F.struct("confidence", "cell")))), lambda x: x.cell), 1, 10)
    return rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= threshold).alias("high"), F.count_if(F.col("confidence") < threshold).alias("low"), F.count_if(F.col("answer") == "").alias("unanswered"), F.array_join(low, ",").alias("lowest"))


def best_radio_choice(rows: DataFrame) -> DataFrame:
    """(doc_id, group_id, choice, note): of several selected the surest."""
    sel = rows.groupBy("doc_id", "group_id").agg(F.count_if(F.col("selected")).alias("n"), F.max_by(F.when(F.col("selected"), F.col("option")), F.when(F.col("selected"), F.struct("confidence", "option"))).alias("choice"))
    return sel.select("doc_id", "group_id", "choice", F.when(F.col("n") == 0, "nothing selected").when(F.col("n") > 1, "several selected").otherwise("").alias("note"))


PARSERS = {"number": V.parse_number, "currency": V.parse_currency, "percentage": V.parse_percentage}


def validate_fields(docs: DataFrame, defs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, field_id, value, is_valid, errors, warnings) of every defined field of every document.

    ``defs`` (field_id, field_type, required, validation_regex, min_value, max_value) is configuration.
    """
    rows = beside(docs.select("doc_id"), defs).join(values, ["doc_id", "field_id"], "left")
    v, kind = F.col("value"), F.col("field_type")
    missing = F.coalesce(v, F.lit("")) == ""
    number: Column = F.lit(None).cast("double")
    for name, parse in PARSERS.items():
        number = F.when(kind == name, parse(v)).otherwise(number)
    numeric = kind.isin(*PARSERS)
    text = F.when(kind == "date", V.parse_date(v)).when(kind == "boolean", V.parse_boolean(v).cast("string")).when(kind == "address", V.normalize_address(v)).when(kind == "phone", V.normalize_phone(v)).when(kind == "email", V.normalize_email(v)).when(kind == "ssn", V.format_ssn(v)).when(kind == "ein", V.format_ein(v)).when(numeric, number.cast("string")).otherwise(F.trim(v))
    failed = (numeric & number.isNull()) | ((kind == "boolean") & V.parse_boolean(v).isNull())
    err = lambda cond, name: F.when(cond, F.lit(name))
    errors = F.array_compact(
        F.array(
            err(missing & F.col("required"), "missing"), err(~missing & failed, "unparsed"), err(~missing & (number < F.col("min_value")), "below_min"), err(~missing & (number > F.col("max_value")), "above_max"),
            err(~missing & (kind == "email") & ~V.valid_email(v), "bad_email"), err(~missing & kind.isin("ssn", "ein") & ~V.valid_nine(v), "bad_id"), err(~missing & ~F.regexp_like(F.coalesce(text, v), F.concat(F.lit("^(?:"), F.col("validation_regex"), F.lit(")"))), "pattern"),
        )
    )
    warnings = F.array_compact(F.array(err(~missing & (kind == "phone") & ~V.valid_phone(v), "short_phone")))
    return rows.select("doc_id", "field_id", F.when(~missing, text).alias("value"), (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def validate_record(docs: DataFrame, defs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, is_valid, n_fields, n_errors, n_warnings, invalid): every defined field counts, absent ones included.

    A record is valid if all its fields are; ``invalid`` names the others in order.
    """
    fields = validate_fields(docs, defs, values)
    return fields.groupBy("doc_id").agg(
        F.bool_and("is_valid").alias("is_valid"), F.count("*").alias("n_fields"), F.sum(F.size("errors")).alias("n_errors"), F.sum(F.size("warnings")).alias("n_warnings"), F.sort_array(F.collect_set(F.when(~F.col("is_valid"), F.col("field_id")))).alias("invalid")
    )


def apply_overrides(leaves: DataFrame, overrides: DataFrame) -> DataFrame:
    """(doc_id, path, value, defaulted): configured defaults where a path is missing, null or empty."""
    grid = beside(leaves.select("doc_id").distinct(), overrides.withColumnRenamed("value", "default"))
    out = leaves.join(grid, ["doc_id", "path"], "full")
    empty = F.coalesce("value", F.lit("")) == ""
    return out.select("doc_id", "path", F.when(empty, F.coalesce("default", "value")).otherwise(F.col("value")).alias("value"), (empty & F.col("default").isNotNull()).alias("defaulted"))


def loan_defaults(loans: DataFrame) -> DataFrame:
    """Codes by default: frequency, billing type, currency, day count, rate type and index; and how many were set."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    line = F.upper(F.coalesce("document_type", F.lit(""))).rlike("LINE|LOC|REVOLV|CREDIT")
    rate, index = low("rate_type"), low("index_rate")
    rules = {
        "payment_frequency": F.lit("C:MONTHLY"),
        "billing_type": F.when(line, "A:INTEREST ONLY").otherwise("F:PAYMENT AMOUNT INCLUDING INTEREST"),
        "currency": F.lit("USD:US DOLLAR"),
        "day_count": F.lit("360ACTUAL:ACTUAL DAYS / 360 DAY YEAR"),
        "rate_code": F.when(F.contains(rate, F.lit("prime")), "PRM:PRIME RATE LOAN").when(F.contains(rate, F.lit("fixed")), "FIX:FIXED RATE LOAN").when(F.contains(rate, F.lit("sofr")), "SOF:SOFR"),
        "index_code": F.when(index.rlike("prime|wall street"), "WALLST:WALL STREET JOURNAL PRIME").when(F.contains(index, F.lit("sofr")), "SOFR:SOFR RATE"),
    }
    changed = sum(((blank(c) & d.isNotNull()).cast("int") for c, d in rules.items()), F.lit(0))
    return loans.select("doc_id", *(F.when(blank(c), d).otherwise(F.col(c)).alias(c) for c, d in rules.items()), changed.alias("changes"))


def code_lookup(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """The code of the first phrase that a text holds; ``codes`` (ordinal, phrase, code) is configuration."""
    hit = beside(rows, codes, F.contains(F.lower("text"), F.lower("phrase")))
    best = hit.groupBy("doc_id").agg(F.min_by("code", "ordinal").alias("code"))
    return rows.select("doc_id").join(best, "doc_id", "left")


def cross_reference(fields: DataFrame, pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, field_a, field_b, matches): the same fact in two fields; both null match."""
    a = fields.select("doc_id", F.col("field_id").alias("field_a"), F.col("value").alias("va"))
    b = fields.select("doc_id", F.col("field_id").alias("field_b"), F.col("value").alias("vb"))
    both = a.join(pairs, "field_a").join(b, ["doc_id", "field_b"])
    return both.select("doc_id", "field_a", "field_b", (F.col("va").eqNullSafe(F.col("vb")) | F.coalesce(F.abs(F.col("va") - F.col("vb")) <= tolerance, F.lit(False))).alias("matches"))


def authoritative_value(fields: DataFrame) -> DataFrame:
    """(doc_id, field_id, value, discrepancy): by rank of the source; ``fields`` has rank."""
    return fields.where("value is not null").groupBy("doc_id", "field_id").agg(F.min_by("value", F.struct("rank", "value")).alias("value"), (F.countDistinct("value") > 1).alias("discrepancy"))


#: What breaks a rule, over a loan's columns and those of ``_cross_rows``; a condition that is null breaks nothing.
RULES = [
    ("payment", "abs(amount * rate / 12 - payment) > amount * 0.01"),
    ("term", "months_between(maturity_date, effective_date) < 12 or months_between(maturity_date, effective_date) > 360"),
    ("fixed_type", "is_fixed and coalesce(rate_type, '') <> 'FIX:FIXED RATE LOAN'"),
    ("variable_index", "not is_fixed and coalesce(trim(rate_index), '') = ''"),
    ("parties", "coalesce(trim(borrower), '') = '' or coalesce(trim(lender), '') = ''"),
    ("shares", "abs(share_sum - 1) > 0.01"),
    ("commitments", "abs(commitment_sum - aggregate) > 0.01 * aggregate"),
    ("spreads", "falls > 0"),
]


def _cross_rows(loans: DataFrame, lenders: DataFrame | None, tiers: DataFrame | None) -> DataFrame:
    """``loans`` with share_sum and commitment_sum of their lenders, and how often a tier's spread is below the one before."""
    if lenders is not None:
        loans = loans.join(lenders.groupBy("doc_id").agg(F.sum("share").alias("share_sum"), F.sum("commitment").alias("commitment_sum")), "doc_id", "left")
    else:
        loans = loans.withColumns({c: F.lit(None).cast("double") for c in ("share_sum", "commitment_sum")})
    if tiers is None:
        return loans.withColumn("falls", F.lit(None).cast("long"))
    before = F.lag("spread").over(Window.partitionBy("doc_id").orderBy("level_no"))
    falls = tiers.where("spread is not null").withColumn("before", before).groupBy("doc_id").agg(F.count_if(F.col("spread") < F.col("before")).alias("falls"))
    return loans.join(falls, "doc_id", "left")


def sanity_rules(loans: DataFrame, lenders: DataFrame | None = None, tiers: DataFrame | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, failed): names of the rules that a loan breaks, in the order of ``rules`` (name, condition).

    ``loans`` has doc_id, amount, rate, payment, effective_date, maturity_date, is_fixed, rate_type, rate_index,
    borrower, lender, aggregate; ``lenders`` doc_id, share, commitment; ``tiers`` doc_id, level_no, spread. What a
    loan lacks breaks only the rules that ask for it.
    """
    broken = F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(name)) for name, condition in rules or RULES)))
    return _cross_rows(loans, lenders, tiers).select("doc_id", F.array_join(broken, ",").alias("failed"))


#: Levels that are opened in one plan before what is left is looked at.
LEVELS = 8


def _nested(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def _opened(step: DataFrame) -> DataFrame:
    """Objects and arrays opened by one level; scalars pass through, empty objects and arrays become null."""
    inner = step.lateralJoin(step.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    name = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "key")).when(F.col("pos").isNotNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("path"))
    opened = F.col("key").isNotNull() | F.col("pos").isNotNull()
    return inner.select("doc_id", F.when(opened, F.col("value")).when(~_nested(F.col("v")), F.col("v")).alias("v"), name.alias("path"), (F.col("hidden") | F.coalesce(F.col("key").startswith("_"), F.lit(False))).alias("hidden"))


def _leaves(rows: DataFrame, json_col: str, depth: int | None) -> DataFrame:
    """(doc_id, path, value, hidden) of the leaves of JSON up to ``depth`` levels down, or of all; a record without
    any has one row without a path. A leaf's value is null for JSON null; ``hidden``: a key on its path begins with _.

    Without a depth, ``LEVELS`` levels are opened at a time, and again for what is still nested, until nothing is.
    """
    step = rows.select("doc_id", F.try_parse_json(json_col).alias("v"), F.lit("").alias("path"), F.lit(False).alias("hidden"))
    flat = None
    while True:
        for _ in range(LEVELS if depth is None else depth):
            step = _opened(step)
        if depth is not None:
            flat = step
            break
        step = materialize(step.withColumn("more", _nested(F.col("v"))))
        done = step.where("not more").drop("more")
        flat, step = done if flat is None else flat.unionByName(done), step.where("more").drop("more")
        if step.isEmpty():
            break
    scalar = F.coalesce(~_nested(F.col("v")) & (F.schema_of_variant("v") != "VOID"), F.lit(False)) & (F.col("path") != "")
    return flat.select("doc_id", F.when(scalar, F.col("path")).alias("path"), F.when(scalar, F.variant_get("v", "$", "string")).alias("value"), "hidden")


def leaf_paths(rows: DataFrame, json_col: str, depth: int | None = None) -> DataFrame:
    """(doc_id, path, value) of the scalar leaves of nested JSON, however deep: a.b[0].c. Null and empty values and
    keys with a leading _ are left out, and so is what is no JSON, or lies deeper than a ``depth`` that is given."""
    return _leaves(rows, json_col, depth).where("value is not null and value <> '' and not hidden").select("doc_id", "path", "value")


def count_fields(rows: DataFrame, json_col: str, depth: int = 5) -> DataFrame:
    """(doc_id, fields): the number of leaves that are not null, to ``depth`` levels; 0 for records without any."""
    return _leaves(rows, json_col, depth).groupBy("doc_id").agg(F.count("value").alias("fields"))


def section_page_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "section_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page_number")), lambda p: p.cast("string")), ",").alias("pages"))


def merge_partial_records(rows: DataFrame, columns: list[str], document_type: str | None = None) -> DataFrame:
    """One record a document: the first non-null value of each column by ``seq``, and the number of parts.

    With a list column ``events`` (structs that begin with ts), the lists of all parts as one, sorted by time. With
    ``document_type`` the record takes that type, and ``dropped`` names the other types that its parts had: those
    records go, after they gave their values.
    """
    extra = [F.array_sort(F.flatten(F.collect_list("events"))).alias("events")] if "events" in rows.columns else []
    if document_type is not None:
        extra += [F.lit(document_type).alias("document_type"), F.array_remove(F.sort_array(F.collect_set("document_type")), document_type).alias("dropped")]
    return rows.groupBy("doc_id").agg(*(F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns), F.count("*").alias("parts"), *extra)


def deep_merge(base: DataFrame, over: DataFrame) -> DataFrame:
    """Leaves of two nested records by path: the override wins, a replaced list goes whole.

    Both have doc_id, path, value; a list's leaves have paths like a[0].
    """
    parent = F.regexp_extract("path", r"^([^\[]*)\[", 1)
    replaced = over.select("doc_id", parent.alias("p")).where("p <> ''").distinct()
    kept = base.withColumn("p", parent).join(replaced, ["doc_id", "p"], "left_anti").select("doc_id", "path", "value")
    out = kept.join(over.withColumnRenamed("value", "new"), ["doc_id", "path"], "full")
    return out.select("doc_id", "path", F.coalesce("new", "value").alias("value"))


def signature_summary(docs: DataFrame, signatures: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(doc_id, signatures, high, low, pages, status) of every document."""
    s = signatures.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= threshold).alias("high"), F.sort_array(F.collect_set("page_number")).alias("p"))
    out = docs.select("doc_id").join(s, "doc_id", "left")
    shown = F.array_join(F.transform(F.slice("p", 1, 5), lambda x: x.cast("string")), ",")
    status = F.when(F.col("n").isNull(), "UNSIGNED").when(F.col("high") > 0, "SIGNED").otherwise("PARTIAL")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("signatures"), F.coalesce("high", F.lit(0)).alias("high"), F.coalesce(F.col("n") - F.col("high"), F.lit(0)).alias("low"), F.coalesce(F.concat(shown, F.when(F.size("p") > 5, "...").otherwise("")), F.lit("")).alias("pages"), status.alias("status"))


def mask_paths(df: DataFrame, paths: dict[str, str], can_view: bool) -> DataFrame:
    """Values at dotted paths (``owners[*].ssn``) masked by their kind, unless the viewer may see them.

    The paths become column expressions when the plan is made: transform over lists, withField in structs.
    """
    if can_view or not paths:
        return df

    def masked(c: Column, parts: list[str], kind: str) -> Column:
        if not parts:
            return F.when(F.coalesce(c, F.lit("")) != "", V.mask_value(c, F.lit(kind))).otherwise(c)
        if parts[0] == "[*]":
            return F.transform(c, lambda x: masked(x, parts[1:], kind))
        return c.withField(parts[0], masked(c[parts[0]], parts[1:], kind))

    out = df
    for path, kind in paths.items():
        head, *rest = path.replace("[*]", ".[*]").split(".")
        out = out.withColumn(head, masked(F.col(head), rest, kind))
    return out


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """``encrypt_paths`` of whole columns."""
    return encrypt_paths(df, columns, key)


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """The inverse, without the envelope."""
    return decrypt_paths(df, columns, key).drop("envelope")


def access_report(accesses: DataFrame) -> DataFrame:
    """Accesses to personal data by accessor and document."""
    return accesses.groupBy("accessor_id", "document_id").agg(F.count("*").alias("accesses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
