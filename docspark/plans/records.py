"""Queries of the tree, record, parsing and privacy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import parsing as V
from docspark.functions import text as T
from docspark.operators import pages as P
from docspark.operators import privacy
from docspark.operators import records as R
from docspark.operators import trees as G
from docspark.plans import config


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Trees: conversations as outlines. The turn gives the structure (1, 1.1, 1.1.1, 2, …) and the page.


def _entries(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    top = (F.floor(F.col("t") / 3) + 1).cast("string")
    structure = F.when(F.col("t") % 3 == 0, top).when(F.col("t") % 3 == 1, F.concat(top, F.lit(".1"))).otherwise(F.concat(top, F.lit(".1.1")))
    return c.select("doc_id", F.col("t").alias("entry_id"), structure.alias("structure"), F.substring("text", 1, 20).alias("title"), (1 + F.col("t") * 2).alias("physical_page"), "text")


def _nodes(spark, sf):
    e = _entries(spark, sf)
    totals = e.groupBy("doc_id").agg((F.max("physical_page") + 3).alias("total_pages"))
    return G.tree_end_pages(G.tree_parents(e), totals), totals


def _pages(spark, sf):
    """Each entry's text is the text of its page and of the next."""
    e = _entries(spark, sf)
    return e.select("doc_id", F.explode(F.array("physical_page", F.col("physical_page") + 1)).alias("page_number"), "text").withColumn("tokens", T.token_estimate(F.col("text")))


def _printed(spark, sf):
    """Entries with printed pages, and pages with a table of contents in front that holds every title."""
    e = _entries(spark, sf).select("doc_id", F.col("entry_id").alias("seq"), "title", (F.col("physical_page") + 2).alias("printed_page"))
    line = F.concat(F.regexp_replace("title", r"\s", " "), F.lit(" x ..... "), F.col("printed_page").cast("string"))
    contents = e.groupBy("doc_id").agg(F.concat(F.lit("Contents\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x.l), "\n")).alias("text"))
    return e, _pages(spark, sf).select("doc_id", "page_number", "text").unionByName(contents.select("doc_id", F.lit(0).alias("page_number"), "text"))


def page_offset(spark, sf):
    return G.page_offset(*_printed(spark, sf))


def apply_offset(spark, sf):
    e, pages = _printed(spark, sf)
    return G.apply_offset(e, G.page_offset(e, pages)).select("doc_id", "seq", "physical_page")


def locate_titles(spark, sf):
    e = _entries(spark, sf).select("doc_id", F.col("entry_id").alias("seq"), "title", F.when(F.col("entry_id") % 2 == 0, F.col("physical_page")).alias("physical_page"))
    return G.locate_titles(e, _pages(spark, sf))


def tree_parents(spark, sf):
    return G.node_ids(G.tree_parents(_entries(spark, sf))).select("doc_id", "seq", "node_id", "parent", "depth", "start_index")


def tree_end_pages(spark, sf):
    return _nodes(spark, sf)[0].select("doc_id", "seq", "start_index", "end_index")


def tree_stats(spark, sf):
    return G.tree_stats(_nodes(spark, sf)[0])


def oversized_leaves(spark, sf):
    return G.oversized_leaves(_nodes(spark, sf)[0], _pages(spark, sf), 3, 300)


def split_oversized(spark, sf):
    """The pages of a document as headings on two levels."""
    nodes, pages = _nodes(spark, sf)[0], _pages(spark, sf)
    n = F.col("page_number")
    headings = pages.select("doc_id", n.alias("entry_id"), F.when(n % 3 == 0, "1").when(n % 3 == 1, "1.1").otherwise("2").alias("structure"), F.substring("text", 1, 10).alias("title"), "page_number")
    return G.split_oversized(nodes, G.oversized_leaves(nodes, pages, 3, 300), headings)


def verify_headings(spark, sf):
    e = _entries(spark, sf).withColumn("physical_page", F.col("physical_page") + F.when(F.col("entry_id") % 3 == 2, 2).otherwise(0))
    return G.verify_headings(e, _pages(spark, sf), 4).withColumn("share", F.round("share", 6))


def node_pages(spark, sf):
    return G.node_pages(_nodes(spark, sf)[0], 4, 8)


def compact_outline(spark, sf):
    return G.compact_outline(_nodes(spark, sf)[0]).select("doc_id", F.md5("outline").alias("outline_md5"))


def leaf_sections(spark, sf):
    return G.leaf_sections(_nodes(spark, sf)[0], 1).select("doc_id", "seq", "depth")


def _summaries(spark, sf):
    e = _entries(spark, sf)
    nodes, totals = _nodes(spark, sf)
    return nodes.join(e.select("doc_id", (F.col("entry_id") + 1).alias("seq"), F.substring("text", 21, 60).alias("summary")), ["doc_id", "seq"], "left"), totals


def match_sections_to_nodes(spark, sf):
    return G.match_sections_to_nodes(_summaries(spark, sf)[0], config.sections(spark))


def plan_from_tree(spark, sf):
    nodes, totals = _summaries(spark, sf)
    names = [(s[0], 2, s[0] == "s_sig") for s in config.SECTIONS if s[3]]
    return G.plan_from_tree(nodes, names, config.sections(spark), totals)


def tree_cost(spark, sf):
    return G.tree_cost(P.paginate(_t(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("pages")))


def cache_summaries(spark, sf):
    nodes, _ = _summaries(spark, sf)
    some = nodes.withColumn("summary", F.when(F.col("seq") % 2 == 0, F.col("summary")))
    new = nodes.where("seq % 3 = 1").select("doc_id", "seq", F.reverse("summary").alias("summary"))
    return G.cache_summaries(some, new).select("doc_id", "seq", F.md5("summary").alias("summary_md5"))


# OCR rows: line items as cells, answers and signatures.


def _lines(spark, sf, together=False, columns=("*",)):
    """``together``: dealt by document before they are made distinct, so that what is grouped by document and more stays where it is."""
    conf = F.least(F.lit(100.0), 60 + 40 * F.col("l_discount") * 10)
    rows = _t(spark, sf, "lineitem").select(*columns)
    return (rows.repartition("l_orderkey") if together else rows).distinct().select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("qty"), "l_extendedprice", F.round(conf, 4).alias("confidence"), "l_discount")


LINES = "li AS (SELECT DISTINCT * FROM lineitem), ln AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_quantity::INT AS qty, l_extendedprice, round(least(100.0::DOUBLE, 60 + 40 * l_discount * 10), 4) AS confidence, l_discount FROM li)"


def cells_to_rows(spark, sf):
    c = _lines(spark, sf).select(F.col("doc_id").alias("table_id"), F.col("n").alias("row_index"), (F.col("part") % 3 + 1).cast("int").alias("col_index"), F.concat(F.lit("q"), F.col("qty").cast("string")).alias("text"), F.struct("part", "supp", "l_extendedprice", "qty").alias("position"))
    return R.cells_to_rows(c)


def lines_to_text(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", "role", "text").alias("position"), F.coalesce("text", F.lit("")).alias("text"), (60 + F.col("turn") % 40).cast("double").alias("confidence"))
    return R.lines_to_text(c).select("doc_id", F.md5("text").alias("text_md5"), "line_count", "word_count", F.round("mean_confidence", 6).alias("mean_confidence"))


def _blocks(spark, sf, columns=("*",)):
    """Line items as OCR blocks: a key and a value block each with a word, and a signature for some."""
    li = _lines(spark, sf, True, columns)
    part = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    rid = F.concat_ws("-", part("n", 2), part("part", 7), part("supp", 6), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 11, "0"))
    rel = lambda kind, prefix: F.struct(F.lit(kind).alias("type"), F.array(F.concat(F.lit(prefix), rid)).alias("ids"))
    none = F.expr("cast(array() as array<struct<type:string,ids:array<string>>>)")

    def block(kind, prefix, text, confidence, entity, relations):
        return F.struct(F.concat(F.lit(prefix), rid).alias("id"), F.lit(kind).alias("block_type"), text.cast("string").alias("text"), confidence.cast("double").alias("confidence"), F.array(*(F.lit(e) for e in entity)).cast("array<string>").alias("entity_types"), relations.alias("relationships"))

    value = F.when(F.col("qty") % 10 == 0, 0).otherwise(50 + F.col("qty"))
    all_ = [
        block("KEY_VALUE_SET", "k", F.lit(None), F.col("confidence"), ["KEY"], F.array(rel("VALUE", "v"), rel("CHILD", "w"))),
        block("KEY_VALUE_SET", "v", F.lit(None), value, ["VALUE"], F.array(rel("CHILD", "x"))),
        block("WORD", "w", F.concat(F.lit("field"), (F.col("part") % 5).cast("string")), F.lit(99), [], none),
        block("WORD", "x", F.col("supp"), F.lit(99), [], none),
        block("SIGNATURE", "s", F.lit(None), F.when(F.col("qty") % 4 > 0, F.col("confidence")), [], none),
    ]
    return li.select("doc_id", F.col("n").alias("page"), F.explode(F.array(*all_)).alias("b")).select("doc_id", "page", "b.*")


def block_edges(spark, sf):
    return R.block_edges(_blocks(spark, sf))


def key_values(spark, sf):
    # Lines that differ in other columns only give the same keys and values.
    return R.key_values(_blocks(spark, sf, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")))


def signatures(spark, sf):
    return R.signatures(_blocks(spark, sf))


def best_value_per_key(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.concat(F.lit("field"), (F.col("part") % 5).cast("string")).alias("key"), F.col("supp").cast("string").alias("value"), F.when(F.col("qty") % 10 > 0, F.col("confidence")).alias("confidence"), F.col("n").alias("page_number"))
    return R.best_value_per_key(rows)


def _answers(spark, sf):
    return _lines(spark, sf).select("doc_id", F.concat(F.lit("q"), (F.col("part") % 4).cast("string")).alias("query"), F.when(F.col("qty") % 7 == 0, "").otherwise(F.col("supp").cast("string")).alias("answer"), "confidence", F.col("n").alias("page_number"))


def best_answer_per_query(spark, sf):
    return R.best_answer_per_query(_answers(spark, sf))


def query_answers(spark, sf):
    asked = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*(F.lit(f"q{k}") for k in range(5)))).alias("query"))
    best = _answers(spark, sf).groupBy("doc_id", "query").agg(F.max_by(F.struct("answer", "confidence"), F.struct("confidence", "page_number", "answer")).alias("b")).select("doc_id", "query", "b.*")
    return R.query_answers(asked, best)


def tables_in_page_order(spark, sf):
    t = _lines(spark, sf).select("doc_id", F.col("n").alias("page_number"), F.col("part").alias("idx"), F.concat(F.lit("t"), F.col("supp").cast("string")).alias("table_id"), (F.col("qty") % 3 == 0).alias("failed"))
    return R.tables_in_page_order(t)


def remap_page_index(spark, sf):
    rows = _lines(spark, sf).select("doc_id", "part", "supp", F.col("n").alias("page_index"), F.array(F.lit(4), F.lit(8), F.lit(15), F.lit(16)).alias("pages"))
    return R.remap_page_index(rows, "pages").select("doc_id", "part", "supp", "page_index", "page_number")


def extraction_quality(spark, sf):
    rows = _lines(spark, sf).select("doc_id", "confidence", F.concat_ws(":", F.col("part").cast("string"), F.col("supp").cast("string")).alias("cell"), F.when(F.col("qty") % 7 == 0, "").otherwise("x").alias("answer"))
    return R.extraction_quality(rows)


def confidence_bands(spark, sf):
    return _lines(spark, sf).groupBy(V.confidence_band(F.col("confidence")).alias("band"), V.score_band(F.col("confidence")).alias("score_band")).agg(F.count("*").alias("n"))


def best_radio_choice(spark, sf):
    rows = _lines(spark, sf).select("doc_id", (F.col("part") % 2).alias("group_id"), F.col("supp").cast("string").alias("option"), (F.col("qty") % 3 == 0).alias("selected"), "confidence")
    return R.best_radio_choice(rows)


def signature_summary(spark, sf):
    docs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return R.signature_summary(docs, _lines(spark, sf).where("qty % 5 = 0").select("doc_id", "confidence", F.col("n").alias("page_number")))


# Values.


def parsed_values(spark, sf):
    c = _t(spark, sf, "customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    cents = F.format_number(F.abs(bal), 2)
    money = F.when(bal < 0, F.concat(F.lit("($"), cents, F.lit(")"))).otherwise(F.concat(F.lit(" $"), cents))
    out = c.select(k.alias("id"), V.parse_number(cents).alias("number"), V.parse_currency(money).alias("currency"), V.normal_currency(F.concat(F.lit("$"), cents)).alias("normal_currency"), V.parse_percentage(F.concat((k % 200 / 10).cast("string"), F.lit("%"))).alias("percentage"), F.round(V.normal_percentage(F.concat((k % 200 / 10).cast("string"), F.lit("%"))), 6).alias("ratio"), V.parse_bps(F.concat((k % 300).cast("string"), F.lit(" bps"))).alias("bps"))
    return out


def parsed_dates(spark, sf):
    o = _t(spark, sf, "orders")
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "M/d/yyyy")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "MMMM d, yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "M-d-yyyy")).when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("id"), V.parse_date(text).alias("iso"))


def parsed_texts(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    digits = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    phone = F.when(k % 3 == 0, F.concat(F.lit("1-"), digits, F.lit("7"))).when(k % 3 == 1, F.concat(digits, F.lit("5"))).otherwise(F.substring(digits, 1, 7))
    address = F.concat(k.cast("string"), F.when(k % 3 == 0, " Oak st.").when(k % 3 == 1, " Elm AVE, Apt 3").otherwise(" Main Blvd. and 2nd st."))
    mail = F.when(k % 4 == 0, F.concat(F.lit(" User"), k.cast("string"), F.lit("@Example.ORG "))).otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example")))
    flag = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "no", " X ", "unchecked", "maybe"))), (k % 5 + 1).cast("int"))
    return c.select(k.alias("id"), V.format_ssn(digits).alias("ssn"), V.format_ein(F.substring(digits, 1, 8)).alias("ein"), V.normalize_phone(phone).alias("phone"), V.valid_phone(phone).alias("phone_ok"), V.normalize_address(address).alias("address"), V.normalize_email(mail).alias("email"), V.valid_email(mail).alias("email_ok"), V.parse_boolean(flag).alias("flag"))


def masked_values(spark, sf):
    k = F.col("c_custkey")
    digits = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    born = F.date_format(F.date_add(F.to_date(F.lit("1950-01-01")), (k * 37 % 18000).cast("int")), "yyyy-MM-dd")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("ssn", "tax_id", "dob", "government_id", "other"))), (k % 5 + 1).cast("int"))
    value = F.when(kind == "dob", born).when(k % 9 == 0, F.lit("12")).otherwise(V.format_ssn(digits))
    return _t(spark, sf, "customer").select(k.alias("id"), kind.alias("kind"), V.mask_value(value, kind).alias("masked"), V.redact_value(value, kind).alias("redacted"))


def mask_paths(spark, sf):
    """A nested document a customer, with two owners."""
    k = F.col("c_custkey")
    ssn = lambda n: V.format_ssn(F.lpad((k * n % 1000000000).cast("string"), 9, "0"))
    owners = F.array(*(F.struct((k + i).alias("key"), ssn(n).alias("ssn")) for i, n in enumerate((7919, 104729))))
    people = _t(spark, sf, "customer").select(k.alias("id"), F.struct(owners.alias("owners")).alias("d"))
    masked = R.mask_paths(people, {"d.owners[*].ssn": "ssn"}, can_view=False)
    return masked.select("id", F.array_join(F.transform("d.owners", lambda o: F.concat_ws(":", o.key.cast("string"), o.ssn)), ",").alias("owners"))


def encryption_round_trip(spark, sf):
    """Encrypted twice, which must change nothing, and decrypted."""
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    key = F.lit("0123456789abcdef").cast("binary")
    once = R.encrypt_columns(rows, ["name", "segment"], key)
    sealed = R.encrypt_columns(once, ["name", "segment"], key).withColumns({"mark": F.col("name"), "sealed": F.size("envelope")})
    return R.decrypt_columns(sealed, ["name", "segment"], key).select("id", "name", "segment", "mark", "sealed")


def _owned(spark, sf):
    """A customer as a nested record: two owners with numbers and a list of phones, some of them missing."""
    k = F.col("c_custkey")
    ssn = lambda n: F.when(k % n > 0, V.format_ssn(F.lpad((k * n % 1000000000).cast("string"), 9, "0")))
    owners = F.array(*(F.struct(F.lit(i).alias("place"), F.struct(ssn(n).alias("ssn"), (k + i).alias("tax")).alias("ids")) for i, n in enumerate((7919, 3))))
    return _t(spark, sf, "customer").select(k.alias("id"), F.struct(F.when(k % 5 > 0, owners).alias("owners"), F.array("c_name", F.lit(None)).alias("phones")).alias("d"))


PATHS, KEY = ["d.owners[*].ids.ssn", "d.owners[*].ids.tax", "d.phones[*]", "d.owners[*].none"], "0123456789abcdef"


def encrypt_paths(spark, sf):
    """Every element of nested lists sealed under a path of its own; a second run changes nothing."""
    key = F.lit(KEY).cast("binary")
    once = privacy.encrypt_paths(_owned(spark, sf), PATHS[:1], key)
    sealed = privacy.encrypt_paths(privacy.encrypt_paths(once, PATHS, key), PATHS, key)
    return sealed.select("id", F.to_json("d").alias("d"), F.array_join(F.array_sort(F.map_keys("envelope")), ",").alias("sealed"))


def decrypt_paths(spark, sf):
    """The round trip, after a try with a wrong key."""
    key = F.lit(KEY).cast("binary")
    sealed = privacy.encrypt_paths(_owned(spark, sf), PATHS, key)
    wrong = privacy.decrypt_paths(sealed, PATHS, F.lit(KEY[::-1]).cast("binary"))
    back = privacy.decrypt_paths(wrong, PATHS, key, {PATHS[1]: "bigint"})
    return back.select("id", F.to_json("d").alias("d"), F.size("envelope").alias("remaining"))


def access_report(spark, sf):
    e = _t(spark, sf, "events").where("event_type = 'view'")
    return R.access_report(e.select(F.col("user_id").alias("accessor_id"), (F.floor("value") % 20).cast("bigint").alias("document_id"), "ts"))


def _fields(spark, sf):
    """Customers as records, their field definitions and values."""
    defs = spark.createDataFrame([("amount", "currency", True, None, 0.0, 5000.0), ("rate", "percentage", False, None, 0.0, 10.0), ("mail", "email", True, None, None, None), ("code", "string", False, "[A-C]", None, None), ("flag", "boolean", False, None, None, None), ("absent", "string", True, None, None, None)], "field_id string, field_type string, required boolean, validation_regex string, min_value double, max_value double")
    k = F.col("c_custkey")
    c = _t(spark, sf, "customer")
    given = {"amount": F.concat(F.lit("$"), F.floor("c_acctbal").cast("string")), "rate": F.when(k % 4 > 0, F.concat((k % 17).cast("string"), F.lit("%"))), "mail": F.when(k % 3 == 0, F.lit("a@b.co")).otherwise("nobody"), "code": F.substring("c_mktsegment", 1, 1), "flag": F.when(k % 2 == 0, F.lit("Yes")).otherwise("perhaps")}
    rows = c.select(k.alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("field_id"), v.alias("value")) for n, v in given.items()))).alias("f")).select("doc_id", "f.field_id", "f.value")
    return c.select(k.alias("doc_id")), defs, rows


def validate_fields(spark, sf):
    return R.validate_fields(*_fields(spark, sf)).select("doc_id", "field_id", "is_valid", F.array_join("errors", ",").alias("errors"))


def validate_record(spark, sf):
    docs, defs, rows = _fields(spark, sf)
    return R.validate_record(docs, defs.where("field_id <> 'absent'"), rows).withColumn("invalid", F.array_join("invalid", ","))


def apply_overrides(spark, sf):
    o = spark.createDataFrame([("a.segment", "NONE"), ("a.extra", "E")], "path string, value string")
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit("a.segment").alias("path"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("value")), F.struct(F.lit("a.name").alias("path"), F.col("c_name").alias("value")))).alias("f"))
    return R.apply_overrides(c.select("doc_id", "f.path", "f.value"), o)


def loan_defaults(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey")
    some = lambda n, v: F.when(k % n == 0, F.lit(v))
    loans = p.select(k.alias("doc_id"), F.concat("p_type", F.when(k % 2 == 0, " line of credit").otherwise(" term")).alias("document_type"), F.when(k % 4 == 0, "Prime based").when(k % 4 == 1, "Fixed").when(k % 4 == 2, "SOFR + 1").alias("rate_type"), F.when(k % 3 == 0, "Wall Street Journal").when(k % 3 == 1, "Term SOFR").alias("index_rate"), some(5, "Q").alias("payment_frequency"), some(6, "B").alias("billing_type"), some(7, "EUR").alias("currency"), some(8, "365").alias("day_count"), some(9, "X").alias("rate_code"), some(10, "Y").alias("index_code"))
    return R.loan_defaults(loans)


def code_lookup(spark, sf):
    codes = spark.createDataFrame([(1, "small", "S"), (2, "ring", "R"), (3, "box", "B"), (4, "e", "E")], "ordinal int, phrase string, code string")
    return R.code_lookup(_t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), codes)


def cross_reference(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("field_id"), F.round("o_totalprice", 0).alias("value"))
    li = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.round(F.max("l_extendedprice"), 0).alias("value")).select("doc_id", F.lit("lines").alias("field_id"), "value")
    pairs = spark.createDataFrame([("total", "lines"), ("lines", "lines")], "field_a string, field_b string")
    return R.cross_reference(o.unionByName(li), pairs, 20000.0)


def authoritative_value(spark, sf):
    f = _lines(spark, sf).select("doc_id", F.concat(F.lit("f"), (F.col("part") % 3).cast("string")).alias("field_id"), F.when(F.col("qty") % 4 > 0, F.col("supp")).alias("value"), F.col("n").alias("rank"))
    return R.authoritative_value(f)


def sanity_rules(spark, sf):
    """Orders as loans, their lines as lenders and pricing tiers."""
    o, n, q = _t(spark, sf, "orders"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    k = F.col("o_orderkey")
    facts = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum(q).cast("double").alias("amount"), (F.max(n) * 0.01).alias("rate"), F.min(q).cast("double").alias("payment"), (F.count("*") * 6).cast("int").alias("months"))
    loans = o.select(k.alias("doc_id"), F.to_date("o_orderdate").alias("effective_date"), (k % 2 == 0).alias("is_fixed"), F.when(k % 3 > 0, "FIX:FIXED RATE LOAN").alias("rate_type"), F.when(k % 5 > 0, "SOFR").alias("rate_index"), F.when(k % 7 > 0, "b").alias("borrower"), F.when(k % 11 > 0, "l").otherwise(" ").alias("lender"), (k % 300).cast("double").alias("aggregate"))
    loans = loans.join(facts, "doc_id", "left").withColumn("maturity_date", F.add_months("effective_date", F.col("months")))
    li = _t(spark, sf, "lineitem")
    lenders = li.select(F.col("l_orderkey").alias("doc_id"), (n / 10.0).alias("share"), q.cast("double").alias("commitment"))
    tiers = li.groupBy(F.col("l_orderkey").alias("doc_id"), n.alias("level_no")).agg(F.max("l_tax").alias("spread"))
    return R.sanity_rules(loans, lenders, tiers)


def _nested(spark, sf):
    """Events as nested records: lists, objects in lists, hidden keys, nulls, empty values, and leaves up to fourteen levels down."""
    kind, k = F.col("event_type"), F.col("event_id")
    text = F.concat(F.lit('{"meta":{"kind":"'), kind, F.lit('","tags":["a",{"n":'), (k % 5).cast("string"), F.lit('}],"_h":"x","note":null},"props":'), F.coalesce("props", F.lit("null")), F.lit(',"empty":"","none":{},"deep":{"a":{"b":{"c":{"d":'), k.cast("string"), F.lit(',"e":{"f":2,"g":[{"h":{"i":{"j":[[{"k":'), k.cast("string"), F.lit('}],{},[]]}}}]}}}}}}'))
    return _t(spark, sf, "events").select(k.alias("doc_id"), text.alias("record"))


def leaf_paths(spark, sf):
    return R.leaf_paths(_nested(spark, sf), "record")


def count_fields(spark, sf):
    return R.count_fields(_nested(spark, sf), "record")


def section_page_map(spark, sf):
    return R.section_page_map(_lines(spark, sf).select("doc_id", F.concat(F.lit("s"), (F.col("part") % 3).cast("string")).alias("section_id"), F.col("n").alias("page_number")))


def merge_partial_records(spark, sf):
    """Events in hours as partial records of a user, each with its own list of events; records are of three types."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id", "ts", "event_type", "props")
    first = lambda kind, c: F.min_by(F.when((F.col("event_type") == kind) & F.col(c).isNotNull(), F.col(c)), F.when((F.col("event_type") == kind) & F.col(c).isNotNull(), F.struct("ts", "event_id")))
    parts = e.groupBy("doc_id", F.hour("ts").alias("seq")).agg(first("view", "props").alias("a"), first("click", "event_id").alias("b"), F.collect_list(F.struct("ts", "event_id")).alias("events"))
    kind = F.when(F.col("seq") % 3 == 0, "PROCESSING").when(F.col("seq") % 3 == 1, "LOAN").otherwise("OTHER")
    out = R.merge_partial_records(parts.withColumn("document_type", kind), ["a", "b"], "LOAN")
    return out.select("doc_id", "a", "b", "parts", F.array_join(F.transform("events", lambda x: x.event_id.cast("string")), ",").alias("events"), "document_type", F.array_join("dropped", ",").alias("dropped"))


def deep_merge(spark, sf):
    li = _lines(spark, sf)
    path = F.when(F.col("part") % 3 == 0, F.concat(F.lit("x.l["), F.col("n").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("x.f"), F.col("n").cast("string")))
    leaf = lambda df: df.groupBy("doc_id", path.alias("path")).agg(F.max("supp").alias("value"))
    return R.deep_merge(leaf(li.where("supp % 2 = 0")), leaf(li.where("supp % 2 = 1")))


QUERIES = {
    f.__name__: f
    for f in (
        page_offset, apply_offset, locate_titles, tree_parents, tree_end_pages, tree_stats, oversized_leaves, split_oversized, verify_headings, node_pages, compact_outline, leaf_sections, match_sections_to_nodes, plan_from_tree, tree_cost, cache_summaries,
        block_edges, key_values, signatures, best_value_per_key, cells_to_rows, lines_to_text, best_answer_per_query, query_answers, tables_in_page_order, remap_page_index, extraction_quality, confidence_bands, best_radio_choice, signature_summary,
        parsed_values, parsed_dates, parsed_texts, masked_values, mask_paths, encryption_round_trip, encrypt_paths, decrypt_paths, access_report, validate_fields, validate_record, apply_overrides, loan_defaults, code_lookup, cross_reference, authoritative_value, sanity_rules, leaf_paths, count_fields, section_page_map, merge_partial_records, deep_merge,
    )
}

ENTRIES = """en AS (SELECT conv_id AS doc_id, turn::INT AS entry_id, CASE turn % 3 WHEN 0 THEN (turn // 3 + 1)::VARCHAR WHEN 1 THEN (turn // 3 + 1) || '.1' ELSE (turn // 3 + 1) || '.1.1' END AS structure, substr(coalesce(text, ''), 1, 20) AS title, (1 + turn * 2)::INT AS physical_page, coalesce(text, '') AS text FROM conversations),
  pg AS (SELECT doc_id, physical_page + k AS page_number, text, length(substr(text, 1, 3000)) // 4 AS tokens FROM en, (VALUES (0), (1)) v(k))"""
PARENTS = f"""{ENTRIES}, sq AS (SELECT *, length(structure) - length(replace(structure, '.', '')) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page, structure, entry_id)::INT AS seq, physical_page AS start_index FROM en),
  pa AS (SELECT a.*, (SELECT max(b.seq) FROM sq b WHERE b.doc_id = a.doc_id AND b.seq < a.seq AND b.depth < a.depth) AS parent FROM sq a)"""
NODES = f"""{PARENTS}, tt AS (SELECT doc_id, max(physical_page) + 3 AS total_pages FROM en GROUP BY 1), nx AS (SELECT pa.*, total_pages, lead(start_index) OVER (PARTITION BY pa.doc_id, parent ORDER BY seq) AS nxt FROM pa JOIN tt USING (doc_id)),
  nd(doc_id, seq, parent, depth, title, start_index, end_index) AS (SELECT doc_id, seq, parent, depth, title, start_index, greatest(start_index, coalesce(nxt - 1, total_pages)) FROM nx WHERE parent IS NULL
    UNION ALL SELECT c.doc_id, c.seq, c.parent, c.depth, c.title, c.start_index, greatest(c.start_index, coalesce(c.nxt - 1, nd.end_index)) FROM nd JOIN nx c ON c.doc_id = nd.doc_id AND c.parent = nd.seq)"""
MATCHED = f"""{NODES}, {config.SECTIONS_SQL}, sm AS (SELECT nd.*, substr(text, 21, 60) AS summary FROM nd LEFT JOIN en ON en.doc_id = nd.doc_id AND en.entry_id + 1 = nd.seq),
  ma AS (SELECT doc_id, section_id, seq, start_index, end_index, list_sum(list_transform(keywords, lambda k: CASE WHEN contains(lower(title), lower(k)) THEN 3 WHEN contains(lower(coalesce(summary, '')), lower(k)) THEN 1 ELSE 0 END))::INT AS score FROM sm, sections)"""


def _claims() -> str:
    """One pair of tables for each section in turn: what it wants, and what it keeps."""
    parts, before = [], []
    for s in (x for x in config.SECTIONS if x[3]):
        n = s[0]
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM k_{b} k WHERE k.doc_id = w.doc_id AND k.page_number = w.page_number)" for b in before) or "true"
        parts.append(f"w_{n} AS (SELECT DISTINCT doc_id, unnest(range(start_index, end_index + 1))::INT AS page_number FROM ma WHERE section_id = '{n}' AND score >= 2), k_{n} AS (SELECT * FROM w_{n} w WHERE {free} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number) <= 2)")
        before.append(n)
    union = " UNION ALL ".join(f"SELECT doc_id, '{b}' AS section_id, page_number FROM k_{b}" for b in before)
    return f"WITH RECURSIVE {MATCHED}, {', '.join(parts)}, al AS ({union}) SELECT * FROM al UNION ALL SELECT doc_id, 's_sig', p FROM (SELECT doc_id, unnest(range(greatest(1, total_pages - 1), total_pages + 1))::INT AS p FROM tt) l WHERE NOT EXISTS (SELECT 1 FROM k_s_sig k WHERE k.doc_id = l.doc_id) AND NOT EXISTS (SELECT 1 FROM al WHERE al.doc_id = l.doc_id AND al.page_number = p)"


ANSWERS = f"{LINES}, an AS (SELECT doc_id, 'q' || part % 4 AS query, CASE WHEN qty % 7 = 0 THEN '' ELSE supp::VARCHAR END AS answer, confidence, n AS page_number FROM ln)"
OFFSET = f"{ENTRIES}, e AS (SELECT doc_id, entry_id AS seq, title, physical_page + 2 AS printed_page, row_number() OVER (PARTITION BY doc_id ORDER BY entry_id) AS k FROM en), h AS (SELECT e.doc_id, k, page_number - printed_page AS page_shift FROM e JOIN pg ON pg.doc_id = e.doc_id AND page_number - printed_page BETWEEN -5 AND 29 AND contains(lower(text), trim(lower(title))) WHERE k <= 10 AND trim(title) <> ''), b AS (SELECT doc_id, page_shift FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, page_shift) = 1), of_ AS (SELECT d.doc_id, coalesce(page_shift, 0)::INT AS page_shift, page_shift IS NOT NULL AS confident FROM (SELECT DISTINCT doc_id FROM en) d LEFT JOIN b USING (doc_id))"
DIGITS = "lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0')"
RID = "lpad(n::VARCHAR, 2, '0') || '-' || lpad(part::VARCHAR, 7, '0') || '-' || lpad(supp::VARCHAR, 6, '0') || '-' || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 11, '0')"
BLOCKS = f"{LINES}, bk AS (SELECT *, {RID} AS rid FROM ln)"
LEAVES = """nj AS (SELECT event_id AS doc_id, '{"meta":{"kind":"' || event_type || '","tags":["a",{"n":' || event_id % 5 || '}],"_h":"x","note":null},"props":' || coalesce(props, 'null') || ',"empty":"","none":{},"deep":{"a":{"b":{"c":{"d":' || event_id || ',"e":{"f":2,"g":[{"h":{"i":{"j":[[{"k":' || event_id || '}],{},[]]}}}]}}}}}}' AS j FROM events),
  lf AS (SELECT doc_id, replace(fullkey, '"', '') AS name, t.type AS kind, atom ->> '$' AS value, length(fullkey) - length(replace(replace(fullkey, '.', ''), '[', '')) AS levels FROM nj, json_tree(j) t)"""
SSN = f"substr({DIGITS}, 1, 3) || '-' || substr({DIGITS}, 4, 2) || '-' || substr({DIGITS}, 6)"

SQL = {
    "page_offset": f"WITH {OFFSET} SELECT * FROM of_",
    "apply_offset": f"WITH {OFFSET} SELECT e.doc_id, e.seq, printed_page + page_shift AS physical_page FROM e JOIN of_ USING (doc_id)",
    "locate_titles": f"WITH {ENTRIES} SELECT en.doc_id, entry_id AS seq, min(page_number) AS physical_page FROM en JOIN pg ON pg.doc_id = en.doc_id AND contains(lower(pg.text), trim(lower(title))) WHERE entry_id % 2 = 1 AND trim(title) <> '' GROUP BY 1, 2",
    "tree_parents": f"WITH {PARENTS} SELECT doc_id, seq, lpad((seq - 1)::VARCHAR, 4, '0') AS node_id, parent, depth, start_index FROM pa",
    "tree_end_pages": f"WITH RECURSIVE {NODES} SELECT doc_id, seq, start_index, end_index FROM nd",
    "tree_stats": f"WITH RECURSIVE {NODES} SELECT doc_id, count(*) AS nodes, count(*) FILTER (parent IS NULL) AS top_level, max(depth) AS max_depth, max(end_index) AS last_page FROM nd GROUP BY 1",
    "oversized_leaves": f"WITH RECURSIVE {NODES}, lf AS (SELECT * FROM nd a WHERE NOT EXISTS (SELECT 1 FROM nd b WHERE b.doc_id = a.doc_id AND b.parent = a.seq)), z AS (SELECT lf.doc_id, seq, end_index - start_index + 1 AS pages, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM lf LEFT JOIN pg ON pg.doc_id = lf.doc_id AND page_number BETWEEN start_index AND end_index GROUP BY 1, 2, 3) SELECT doc_id, seq, pages::BIGINT AS pages, tokens FROM z WHERE pages > 3 OR tokens > 300",
    "verify_headings": f"WITH {ENTRIES}, s AS (SELECT doc_id, title, physical_page + CASE WHEN entry_id % 3 = 2 THEN 2 ELSE 0 END AS p FROM en QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || entry_id)) <= 4) SELECT s.doc_id, count(*) AS checked, round(avg(contains(lower(substr(text, 1, 2000)), trim(lower(title)))::INT), 6) AS share FROM s JOIN pg ON pg.doc_id = s.doc_id AND page_number = p GROUP BY 1",
    "split_oversized": f"""WITH RECURSIVE {NODES}, lv AS (SELECT * FROM nd a WHERE NOT EXISTS (SELECT 1 FROM nd b WHERE b.doc_id = a.doc_id AND b.parent = a.seq)), z AS (SELECT lv.doc_id, seq AS leaf, start_index AS a, end_index AS z FROM lv LEFT JOIN pg ON pg.doc_id = lv.doc_id AND page_number BETWEEN start_index AND end_index GROUP BY ALL HAVING end_index - start_index + 1 > 3 OR coalesce(sum(tokens), 0) > 300),
      h AS (SELECT z.*, page_number AS p, CASE page_number % 3 WHEN 0 THEN '1' WHEN 1 THEN '1.1' ELSE '2' END AS st, substr(text, 1, 10) AS title FROM z JOIN pg ON pg.doc_id = z.doc_id AND page_number BETWEEN a AND z), s AS (SELECT *, (st = '1.1')::INT AS depth, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY p, st)::INT AS seq FROM h)
      SELECT doc_id, leaf, seq, (SELECT max(b.seq) FROM s b WHERE b.doc_id = s.doc_id AND b.leaf = s.leaf AND b.seq < s.seq AND b.depth < s.depth) AS parent, depth, title, p AS start_index, greatest(p, coalesce((SELECT min(b.p) FROM s b WHERE b.doc_id = s.doc_id AND b.leaf = s.leaf AND b.seq > s.seq AND b.depth <= s.depth) - 1, z)) AS end_index FROM s""",
    "node_pages": f"WITH RECURSIVE {NODES}, x AS (SELECT doc_id, seq, unnest(range(start_index, least(end_index, start_index + 4) + 1))::INT AS page_number FROM nd) SELECT * FROM x QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) <= 8",
    "compact_outline": f"WITH RECURSIVE {NODES} SELECT doc_id, md5(string_agg(repeat('  ', depth) || '[' || lpad((seq - 1)::VARCHAR, 4, '0') || '] ' || title || ' (p.' || start_index || CASE WHEN start_index = end_index THEN '' ELSE '-' || end_index END || ')', chr(10) ORDER BY seq)) AS outline_md5 FROM nd GROUP BY 1",
    "leaf_sections": f"WITH RECURSIVE {NODES} SELECT doc_id, seq, depth FROM nd a WHERE depth = 1 OR (depth < 1 AND NOT EXISTS (SELECT 1 FROM nd b WHERE b.doc_id = a.doc_id AND b.parent = a.seq))",
    "match_sections_to_nodes": f"WITH RECURSIVE {MATCHED} SELECT doc_id, section_id, seq, score FROM ma WHERE score >= 2",
    "plan_from_tree": _claims(),
    "tree_cost": "WITH p AS (SELECT doc_id, greatest(1, ceil(length(coalesce(text, '')) / 1500.0))::BIGINT AS p FROM documents), t AS (SELECT doc_id, 500 * least(p, 20) + 500 * p + 7500 AS tokens_in, 200 + 100 * p + 750 AS tokens_out FROM p) SELECT *, round(tokens_in / 1e6 + tokens_out * 5 / 1e6, 6) AS cost FROM t",
    "cache_summaries": f"WITH RECURSIVE {MATCHED} SELECT doc_id, seq, md5(coalesce(CASE WHEN seq % 2 = 0 THEN summary END, CASE WHEN seq % 3 = 1 THEN reverse(summary) END)) AS summary_md5 FROM sm",
    "block_edges": f"WITH {BLOCKS} SELECT doc_id, p || rid AS parent, type, c || rid AS child, 0 AS position FROM bk, (VALUES ('k', 'VALUE', 'v'), ('k', 'CHILD', 'w'), ('v', 'CHILD', 'x')) v(p, type, c)",
    "key_values": f"WITH {BLOCKS} SELECT doc_id, 'field' || part % 5 AS key, supp::VARCHAR AS value, CASE WHEN qty % 10 = 0 THEN confidence ELSE least(confidence, 50 + qty) END AS confidence FROM bk QUALIFY row_number() OVER (PARTITION BY doc_id, part % 5 ORDER BY rid DESC) = 1",
    "signatures": f"WITH {BLOCKS} SELECT doc_id, n AS page, 's' || rid AS id, CASE WHEN qty % 4 > 0 THEN confidence ELSE 0 END AS confidence, qty % 4 > 0 AND confidence >= 85 AS meets_threshold FROM bk",
    "best_value_per_key": f"WITH {LINES}, c AS (SELECT doc_id, 'field' || part % 5 AS key, supp::VARCHAR AS value, CASE WHEN qty % 10 > 0 THEN confidence ELSE 0 END AS confidence, n AS page_number FROM ln) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY confidence DESC, page_number, value) = 1",
    "cells_to_rows": f"WITH {LINES}, f AS (SELECT doc_id, n, part % 3 + 1 AS c, 'q' || qty AS t FROM ln QUALIFY row_number() OVER (PARTITION BY doc_id, n, part % 3 ORDER BY part, supp, l_extendedprice, qty) = 1), z AS (SELECT doc_id, max(n) AS r, max(part % 3 + 1) AS c FROM ln GROUP BY 1), g AS (SELECT doc_id, i::INT AS i, unnest(range(1, c + 1))::INT AS j FROM (SELECT doc_id, c, unnest(range(1, r + 1)) AS i FROM z)) SELECT g.doc_id AS table_id, i AS row_index, j AS col_index, coalesce(t, '') AS text FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.n = i AND f.c = j",
    "lines_to_text": r"SELECT conv_id AS doc_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS text_md5, count(*) AS line_count, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')))::BIGINT AS word_count, round(avg(60 + turn % 40), 6) AS mean_confidence FROM conversations GROUP BY 1",
    "best_answer_per_query": f"WITH {ANSWERS} SELECT doc_id, query, answer, confidence, page_number FROM an WHERE answer <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, query ORDER BY confidence DESC, page_number, answer) = 1",
    "query_answers": f"WITH {ANSWERS}, b AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY doc_id, query ORDER BY confidence DESC, page_number DESC, answer DESC) = 1) SELECT o_orderkey AS doc_id, q.query, coalesce(answer, '') AS answer, CASE WHEN confidence IS NULL THEN 'query_not_processed' WHEN answer = '' THEN 'no_answer_found' ELSE 'answered' END AS status, coalesce(confidence >= 85, false) AS meets_threshold FROM orders CROSS JOIN (SELECT 'q' || unnest(range(0, 5)) AS query) q LEFT JOIN b ON b.doc_id = o_orderkey AND b.query = q.query",
    "tables_in_page_order": f"WITH {LINES} SELECT doc_id, coalesce(string_agg('t' || supp, ',' ORDER BY n, part, 't' || supp) FILTER (qty % 3 <> 0), '') AS tables, bool_and(qty % 3 = 0) AS failed FROM ln GROUP BY 1",
    "remap_page_index": f"WITH {LINES} SELECT doc_id, part, supp, n AS page_index, [4, 8, 15, 16][n] AS page_number FROM ln",
    "extraction_quality": f"WITH {LINES}, l AS (SELECT DISTINCT doc_id, confidence, part || ':' || supp AS cell FROM ln WHERE confidence < 85), t AS (SELECT doc_id, string_agg(cell, ',' ORDER BY confidence, cell) AS c FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence, cell) <= 10) GROUP BY 1) SELECT doc_id, count(*) AS total, count(*) FILTER (confidence >= 85) AS high, count(*) FILTER (confidence < 85) AS low, count(*) FILTER (qty % 7 = 0) AS unanswered, coalesce(any_value(c), '') AS lowest FROM ln LEFT JOIN t USING (doc_id) GROUP BY 1",
    "confidence_bands": f"WITH {LINES} SELECT CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 75 THEN 'medium' ELSE 'low' END AS band, CASE WHEN confidence >= 90 THEN 'good' WHEN confidence >= 50 THEN 'fair' ELSE 'poor' END AS score_band, count(*) AS n FROM ln GROUP BY 1, 2",
    "best_radio_choice": f"WITH {LINES}, g AS (SELECT doc_id, part % 2 AS group_id, count(*) FILTER (qty % 3 = 0) AS k FROM ln GROUP BY 1, 2), b AS (SELECT doc_id, part % 2 AS group_id, supp::VARCHAR AS choice FROM ln WHERE qty % 3 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id, part % 2 ORDER BY confidence DESC, supp::VARCHAR DESC) = 1) SELECT doc_id, group_id, choice, CASE WHEN k = 0 THEN 'nothing selected' WHEN k > 1 THEN 'several selected' ELSE '' END AS note FROM g LEFT JOIN b USING (doc_id, group_id)",
    "signature_summary": f"""WITH {LINES}, s AS (SELECT doc_id, count(*) AS k, count(*) FILTER (confidence >= 85) AS h FROM ln WHERE qty % 5 = 0 GROUP BY 1), pp AS (SELECT DISTINCT doc_id, n FROM ln WHERE qty % 5 = 0), pl AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (r <= 5) || CASE WHEN max(r) > 5 THEN '...' ELSE '' END AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM pp) GROUP BY 1)
      SELECT o_orderkey AS doc_id, coalesce(k, 0) AS signatures, coalesce(h, 0) AS high, coalesce(k - h, 0) AS low, coalesce(p, '') AS pages, CASE WHEN k IS NULL THEN 'UNSIGNED' WHEN h > 0 THEN 'SIGNED' ELSE 'PARTIAL' END AS status FROM orders LEFT JOIN s ON s.doc_id = o_orderkey LEFT JOIN pl ON pl.doc_id = o_orderkey""",
    "parsed_values": "SELECT c_custkey AS id, round(abs(c_acctbal), 2) AS number, round(c_acctbal, 2) AS currency, round(abs(c_acctbal), 2) AS normal_currency, (c_custkey % 200) / 10.0::DOUBLE AS percentage, round((c_custkey % 200) / 1000.0::DOUBLE, 6) AS ratio, (c_custkey % 300) / 10000.0::DOUBLE AS bps FROM customer",
    "parsed_dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN 'on ' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "parsed_texts": f"""WITH c AS (SELECT c_custkey AS k, {DIGITS} AS d FROM customer), p AS (SELECT *, CASE k % 3 WHEN 0 THEN '1' || d || '7' WHEN 1 THEN d || '5' ELSE substr(d, 1, 7) END AS p, CASE k % 3 WHEN 0 THEN 11 WHEN 1 THEN 10 ELSE 7 END AS n FROM c)
      SELECT k AS id, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6) AS ssn, substr(d, 1, 8) AS ein, CASE n WHEN 10 THEN '(' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7) WHEN 11 THEN '+1 (' || substr(p, 2, 3) || ') ' || substr(p, 5, 3) || '-' || substr(p, 8) ELSE p END AS phone, n >= 10 AS phone_ok,
        k || CASE k % 3 WHEN 0 THEN ' Oak Street' WHEN 1 THEN ' Elm Avenue, Apt 3' ELSE ' Main Boulevard and 2nd Street' END AS address, CASE WHEN k % 4 = 0 THEN 'user' || k || '@example.org' ELSE 'user' || k || '@example' END AS email, k % 4 = 0 AS email_ok, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM p""",
    "masked_values": f"""WITH c AS (SELECT c_custkey AS k, ['ssn', 'tax_id', 'dob', 'government_id', 'other'][c_custkey % 5 + 1] AS kind, {SSN} AS s, strftime(DATE '1950-01-01' + (c_custkey * 37 % 18000)::INT, '%Y') AS y FROM customer), v AS (SELECT *, k % 9 = 0 AND kind <> 'dob' AS short FROM c)
      SELECT k AS id, kind, CASE kind WHEN 'ssn' THEN '***-**-' || CASE WHEN short THEN '****' ELSE right(s, 4) END WHEN 'tax_id' THEN '**-***' || CASE WHEN short THEN '****' ELSE right(s, 4) END WHEN 'dob' THEN '****-**-**' ELSE '**REDACTED**' END AS masked,
        CASE kind WHEN 'ssn' THEN '***-**-' || CASE WHEN short THEN '****' ELSE right(s, 4) END WHEN 'tax_id' THEN '**-***' || CASE WHEN short THEN '****' ELSE right(s, 4) END WHEN 'dob' THEN '****-**-** (' || y || ')' WHEN 'government_id' THEN CASE WHEN short THEN '****' ELSE '****' || right(s, 4) END ELSE '[REDACTED]' END AS redacted FROM v""",
    "mask_paths": f"SELECT c_custkey AS id, c_custkey || ':***-**-' || right({DIGITS}, 4) || ',' || c_custkey + 1 || ':***-**-' || right(lpad((c_custkey * 104729 % 1000000000)::VARCHAR, 9, '0'), 4) AS owners FROM customer",
    "encryption_round_trip": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, '[ENCRYPTED]' AS mark, CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 1 END AS sealed FROM customer",
    "access_report": "SELECT user_id AS accessor_id, floor(value)::BIGINT % 20 AS document_id, count(*) AS accesses, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'view' GROUP BY 1, 2",
    "validate_fields": """WITH c AS (SELECT c_custkey AS k, floor(c_acctbal) AS a, c_mktsegment[1] AS m FROM customer)
      SELECT k AS doc_id, 'amount' AS field_id, a BETWEEN 0 AND 5000 AS is_valid, CASE WHEN a < 0 THEN 'below_min' WHEN a > 5000 THEN 'above_max' ELSE '' END AS errors FROM c
      UNION ALL SELECT k, 'rate', k % 4 = 0 OR k % 17 <= 10, CASE WHEN k % 4 > 0 AND k % 17 > 10 THEN 'above_max' ELSE '' END FROM c UNION ALL SELECT k, 'mail', k % 3 = 0, CASE WHEN k % 3 = 0 THEN '' ELSE 'bad_email' END FROM c
      UNION ALL SELECT k, 'code', m IN ('A', 'B', 'C'), CASE WHEN m IN ('A', 'B', 'C') THEN '' ELSE 'pattern' END FROM c UNION ALL SELECT k, 'flag', k % 2 = 0, CASE WHEN k % 2 = 0 THEN '' ELSE 'unparsed' END FROM c UNION ALL SELECT k, 'absent', false, 'missing' FROM c""",
    "validate_record": """WITH c AS (SELECT c_custkey AS doc_id, floor(c_acctbal) NOT BETWEEN 0 AND 5000 AS amount, c_custkey % 4 > 0 AND c_custkey % 17 > 10 AS rate, c_custkey % 3 > 0 AS mail, c_mktsegment[1] NOT IN ('A', 'B', 'C') AS code, c_custkey % 2 > 0 AS flag FROM customer)
      SELECT doc_id, NOT (amount OR rate OR mail OR code OR flag) AS is_valid, 5 AS n_fields, amount::INT + rate::INT + mail::INT + code::INT + flag::INT AS n_errors, 0 AS n_warnings, concat_ws(',', CASE WHEN amount THEN 'amount' END, CASE WHEN code THEN 'code' END, CASE WHEN flag THEN 'flag' END, CASE WHEN mail THEN 'mail' END, CASE WHEN rate THEN 'rate' END) AS invalid FROM c""",
    "apply_overrides": "SELECT c_custkey AS doc_id, 'a.segment' AS path, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'NONE' END AS value, c_custkey % 3 = 0 AS defaulted FROM customer UNION ALL SELECT c_custkey, 'a.name', c_name, false FROM customer UNION ALL SELECT c_custkey, 'a.extra', 'E', true FROM customer",
    "loan_defaults": """WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN 'Q' ELSE 'C:MONTHLY' END AS payment_frequency, CASE WHEN k % 6 = 0 THEN 'B' WHEN k % 2 = 0 THEN 'A:INTEREST ONLY' ELSE 'F:PAYMENT AMOUNT INCLUDING INTEREST' END AS billing_type, CASE WHEN k % 7 = 0 THEN 'EUR' ELSE 'USD:US DOLLAR' END AS currency,
        CASE WHEN k % 8 = 0 THEN '365' ELSE '360ACTUAL:ACTUAL DAYS / 360 DAY YEAR' END AS day_count, CASE WHEN k % 9 = 0 THEN 'X' WHEN k % 4 = 0 THEN 'PRM:PRIME RATE LOAN' WHEN k % 4 = 1 THEN 'FIX:FIXED RATE LOAN' WHEN k % 4 = 2 THEN 'SOF:SOFR' END AS rate_code, CASE WHEN k % 10 = 0 THEN 'Y' WHEN k % 3 = 0 THEN 'WALLST:WALL STREET JOURNAL PRIME' WHEN k % 3 = 1 THEN 'SOFR:SOFR RATE' END AS index_code,
        (k % 5 > 0)::INT + (k % 6 > 0)::INT + (k % 7 > 0)::INT + (k % 8 > 0)::INT + (k % 9 > 0 AND k % 4 < 3)::INT + (k % 10 > 0 AND k % 3 < 2)::INT AS changes FROM p""",
    "code_lookup": "SELECT p_partkey AS doc_id, CASE WHEN contains(lower(p_name), 'small') THEN 'S' WHEN contains(lower(p_name), 'ring') THEN 'R' WHEN contains(lower(p_name), 'box') THEN 'B' WHEN contains(lower(p_name), 'e') THEN 'E' END AS code FROM part",
    "cross_reference": "WITH l AS (SELECT l_orderkey AS k, round(max(l_extendedprice), 0) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey AS doc_id, 'total' AS field_a, 'lines' AS field_b, abs(round(o_totalprice, 0) - v) <= 20000 AS matches FROM orders JOIN l ON k = o_orderkey UNION ALL SELECT k, 'lines', 'lines', true FROM l",
    "authoritative_value": f"WITH {LINES}, f AS (SELECT doc_id, 'f' || part % 3 AS field_id, supp AS value, n FROM ln WHERE qty % 4 > 0) SELECT doc_id, field_id, min_by(value, n * 1000000 + value) AS value, count(DISTINCT value) > 1 AS discrepancy FROM f GROUP BY 1, 2",
    "sanity_rules": """WITH l AS (SELECT l_orderkey AS k, sum(l_quantity::INT)::DOUBLE AS a, max(l_linenumber) * 0.01::DOUBLE AS r, min(l_quantity::INT)::DOUBLE AS p, count(*) * 6 AS m, sum(l_linenumber / 10.0::DOUBLE) AS s FROM lineitem GROUP BY 1),
      t AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_tax) AS x FROM lineitem GROUP BY 1, 2), d AS (SELECT a.k, bool_or(b.x < a.x) AS falls FROM t a JOIN t b ON a.k = b.k AND b.n = (SELECT min(n) FROM t c WHERE c.k = a.k AND c.n > a.n) GROUP BY 1), o AS (SELECT o_orderkey AS k FROM orders)
      SELECT k AS doc_id, concat_ws(',', CASE WHEN abs(a * r / 12 - p) > a * 0.01::DOUBLE THEN 'payment' END, CASE WHEN m < 12 OR m > 360 THEN 'term' END, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'fixed_type' END, CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN 'variable_index' END, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'parties' END,
        CASE WHEN abs(s - 1) > 0.01::DOUBLE THEN 'shares' END, CASE WHEN abs(a - k % 300) > 0.01::DOUBLE * (k % 300) THEN 'commitments' END, CASE WHEN falls THEN 'spreads' END) AS failed FROM o LEFT JOIN l USING (k) LEFT JOIN d USING (k)""",
    "encrypt_paths": """WITH c AS (SELECT c_custkey AS k, c_custkey % 5 > 0 AS own, c_name AS p FROM customer), o AS (SELECT *, c.k % 7919 > 0 AS a, c.k % 3 > 0 AS b FROM c)
      SELECT k AS id, '{' || CASE WHEN own THEN '"owners":[{"place":0,"ids":{' || CASE WHEN a THEN '"ssn":"[ENCRYPTED]",' ELSE '' END || '"tax":"[ENCRYPTED]"}},{"place":1,"ids":{' || CASE WHEN b THEN '"ssn":"[ENCRYPTED]",' ELSE '' END || '"tax":"[ENCRYPTED]"}}],' ELSE '' END || '"phones":["[ENCRYPTED]",null]}' AS d,
        concat_ws(',', CASE WHEN own AND a THEN 'd.owners[0].ids.ssn' END, CASE WHEN own THEN 'd.owners[0].ids.tax' END, CASE WHEN own AND b THEN 'd.owners[1].ids.ssn' END, CASE WHEN own THEN 'd.owners[1].ids.tax' END, 'd.phones[0]') AS sealed FROM o""",
    "decrypt_paths": """WITH s AS (SELECT c_custkey AS k, c_name AS p, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS x, lpad((c_custkey * 3 % 1000000000)::VARCHAR, 9, '0') AS y FROM customer),
      f AS (SELECT k, p, substr(x, 1, 3) || '-' || substr(x, 4, 2) || '-' || substr(x, 6) AS x, substr(y, 1, 3) || '-' || substr(y, 4, 2) || '-' || substr(y, 6) AS y FROM s)
      SELECT k AS id, '{' || CASE WHEN k % 5 > 0 THEN '"owners":[{"place":0,"ids":{' || CASE WHEN k % 7919 > 0 THEN '"ssn":"' || x || '",' ELSE '' END || '"tax":' || k || '}},{"place":1,"ids":{' || CASE WHEN k % 3 > 0 THEN '"ssn":"' || y || '",' ELSE '' END || '"tax":' || (k + 1) || '}}],' ELSE '' END || '"phones":["' || p || '",null]}' AS d, 0 AS remaining FROM f""",
    "leaf_paths": f"WITH {LEAVES} SELECT doc_id, substr(name, 3) AS path, value FROM lf WHERE kind NOT IN ('OBJECT', 'ARRAY', 'NULL') AND value <> '' AND NOT contains(name, '._')",
    "count_fields": f"WITH {LEAVES} SELECT doc_id, count(*) FILTER (kind NOT IN ('OBJECT', 'ARRAY', 'NULL') AND levels BETWEEN 1 AND 5) AS fields FROM lf GROUP BY 1",
    "section_page_map": f"WITH {LINES} SELECT doc_id, 's' || part % 3 AS section_id, string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) AS pages FROM ln GROUP BY 1, 2",
    "merge_partial_records": """WITH p AS (SELECT user_id AS d, hour(ts) AS q, min_by(props, (ts, event_id)) FILTER (event_type = 'view' AND props IS NOT NULL) AS a, min_by(event_id, (ts, event_id)) FILTER (event_type = 'click') AS b FROM events GROUP BY 1, 2),
      m AS (SELECT d, min_by(a, q) FILTER (a IS NOT NULL) AS a, min_by(b, q) FILTER (b IS NOT NULL) AS b, count(*) AS parts, concat_ws(',', CASE WHEN bool_or(q % 3 = 2) THEN 'OTHER' END, CASE WHEN bool_or(q % 3 = 0) THEN 'PROCESSING' END) AS dropped FROM p GROUP BY 1)
      SELECT d AS doc_id, any_value(a) AS a, any_value(b) AS b, any_value(parts) AS parts, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events, 'LOAN' AS document_type, any_value(dropped) AS dropped FROM m JOIN events ON user_id = d GROUP BY 1""",
    "deep_merge": f"""WITH {LINES}, f AS (SELECT doc_id, CASE WHEN part % 3 = 0 THEN 'x.l[' || n || ']' ELSE 'x.f' || n END AS path, part % 3 = 0 AS listed, supp % 2 AS o, max(supp) AS v FROM ln GROUP BY 1, 2, 3, 4), b AS (SELECT * FROM f a WHERE o = 0 AND NOT (listed AND EXISTS (SELECT 1 FROM f c WHERE c.doc_id = a.doc_id AND c.o = 1 AND c.listed))), n AS (SELECT * FROM f WHERE o = 1)
      SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(b.path, n.path) AS path, coalesce(n.v, b.v) AS value FROM b FULL JOIN n ON b.doc_id = n.doc_id AND b.path = n.path""",
}
