"""Queries of the extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import extraction as X
from docspark.operators import pages as P
from docspark.plans import records as R
from docspark.plans import workflow as W

RULES = [(1, "lender", "name"), (2, "share", "share"), (3, "%", "share"), (4, "commit", "amount"), (5, "amount", "amount")]
TIERS = [(1, "usage", "level"), (2, "level", "level"), (3, "threshold", "level"), (4, "term", "term"), (5, "sofr", "term"), (6, "benchmark", "term"), (7, "rfr", "term"), (8, "abr", "base"), (9, "base rate", "base"), (10, "unused", "fee"), (11, "commitment fee", "fee"), (12, "fee rate", "fee")]


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tables(spark, sf):
    """A supplier's shipments as a table of lenders: name, share, amount, and a total."""
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("table_id"))
    header = F.when(F.col("table_id") % 3 == 0, F.array(F.lit("Lender"), F.lit("Share %"), F.lit("Commitment"))).when(F.col("table_id") % 3 == 1, F.array(F.lit("Amount"), F.lit("Lender name"), F.lit("Other"), F.lit("Amount 2"))).otherwise(F.array(F.lit("x"), F.lit("Pro rata %")))
    return s.select("table_id", header.alias("header"))


def _rules(spark):
    return spark.createDataFrame(RULES, "ordinal int, part string, role string")


def map_columns(spark, sf):
    return X.map_columns(_tables(spark, sf), _rules(spark))


def rebuild_rows(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").cast("string").alias("row_no"), F.array(F.when(F.col("l_linenumber") == 7, "Total").otherwise(F.concat(F.lit("L"), F.col("l_partkey").cast("string"))), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")), F.concat(F.lit("$"), F.col("l_orderkey").cast("string"))).alias("cells"))
    current = _t(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("table_id"), F.when(F.col("s_suppkey") % 4 == 0, 1000000).otherwise(1).alias("n"))
    out = X.rebuild_rows(li, map_columns(spark, sf), current)
    return out.groupBy("table_id").agg(F.count("*").alias("rows"), F.min("name").alias("first_name"), F.round(F.sum("share"), 6).alias("share"), F.sum("amount").alias("amount"))


def first_table(spark, sf):
    li = R._lines(spark, sf)
    return X.first_table(li.select("doc_id", F.concat(F.lit("s"), (F.col("part") % 2).cast("string")).alias("section_id"), F.col("n").alias("seq"), F.struct("part", "supp", "l_extendedprice").alias("idx"), F.when(F.col("qty") % 3 > 0, F.concat(F.lit("t"), F.col("supp").cast("string"))).alias("table_id")))


def unwrap_payload(spark, sf):
    k = F.col("p_partkey")
    body = F.when(k % 2 == 0, F.concat(F.lit('{"loanData":{"a":'), k.cast("string"), F.lit('},"audit":{"x":1}}'))).otherwise(F.concat(F.lit('{"b":"'), F.col("p_name"), F.lit('","c":{"d":[1,{"e":"f"}]},"validation":"v"}')))
    return X.unwrap_payload(_t(spark, sf, "part").select(k.alias("doc_id"), body.alias("payload")))


def clean_extraction(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("_id"), F.col("doc_id").cast("string")).alias("answers"), F.coalesce("text", F.lit("")).alias("raw_text"))
    return X.clean_extraction(d, 500).select("doc_id", F.to_json("answers").alias("answers"), F.md5("raw_text").alias("text_md5"))


def strip_geometry(spark, sf):
    a = R._answers(spark, sf).select("doc_id", "query", "page_number", F.struct("answer", "confidence", F.lit(1.0).alias("left"), F.lit(2.0).alias("top")).alias("a"))
    return X.strip_geometry(a, "a", ["answer", "confidence"]).select("doc_id", "query", "page_number", F.to_json("a").alias("a")).groupBy("a").agg(F.count("*").alias("n"))


def amendment_cleanup(spark, sf):
    k = F.col("p_partkey")
    rows = _t(spark, sf, "part").select(k.alias("doc_id"), F.when(k % 2 == 0, "Amended and Restated Credit Agreement").otherwise("Third Amendment").alias("title"), F.when(k % 3 == 0, "Amendment No. 2").when(k % 3 == 1, "2").alias("number"))
    return X.amendment_cleanup(rows)


def nav_hits(spark, sf):
    return X.nav_hits(R._summaries(spark, sf)[0], ["the", "que", "und", "tion"], 2)


#: Levels of the chain of nodes in the trees below.
CHAIN = 12


def flatten_tree(spark, sf):
    """Trees with a chain of twelve levels, a node without children and one with an empty list of them."""
    leaf = F.concat(F.lit('{"title":"'), F.col("p_name"), F.lit('"}'))
    chain = leaf
    for n in range(CHAIN - 1, 1, -1):
        chain = F.concat(F.lit(f'{{"title":"c{n}","nodes":['), chain, F.lit("]}"))
    tree = F.concat(F.lit('[{"title":"a","nodes":['), leaf, F.lit(","), chain, F.lit(']},{"title":"e","nodes":[]},'), leaf, F.lit("]"))
    return X.flatten_tree(_t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), tree.alias("tree")))


def redact_by_name(spark, sf):
    k = F.col("c_custkey")
    ssn = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    rows = _t(spark, sf, "customer").select(k.alias("id"), F.struct(ssn.alias("ssn"), F.col("c_name").alias("name"), F.array(F.struct(F.lit("1970-05-06").alias("dob"))).alias("kids")).alias("owner"))
    return X.redact_by_name(rows).select("id", F.to_json("owner").alias("owner"))


def schema_subset(spark, sf):
    defs = _t(spark, sf, "part").select(F.col("p_brand").alias("schema_id"), F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("field_id"), (F.col("p_size") % 2 == 0).alias("required"), (F.col("p_size") % 3 == 0).alias("pii"))
    return X.schema_subset(defs, required=True, pii=False)


def latest_report(spark, sf):
    rows = W._verdicts(spark, sf).select("doc_id", F.col("baseline_id").alias("report_id"), "verdict", "seq", "supp", "l_extendedprice")
    return P.latest_by(rows, ["doc_id"], F.desc("seq"), F.desc("supp"), F.desc("l_extendedprice"), F.desc("report_id"), "verdict").select("doc_id", "report_id", "verdict")


def rebuild_tiers(spark, sf):
    """Line items of a supplier as a pricing table: usage, spreads and a fee."""
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("table_id"))
    header = F.when(F.col("table_id") % 2 == 0, F.array(*(F.lit(x) for x in ("Usage", "Term SOFR", "ABR", "Unused fee")))).otherwise(F.array(*(F.lit(x) for x in ("ABR spread", "Level", "x"))))
    roles = X.map_columns(s.select("table_id", header.alias("header")), spark.createDataFrame(TIERS, "ordinal int, part string, role string"))
    pct = lambda c: F.concat(c.cast("int").cast("string"), F.lit("%"))
    li = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").cast("string").alias("row_no"), F.array(F.concat(F.lit(" "), pct(F.col("l_quantity"))), pct(F.col("l_linenumber")), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(pct(F.col("l_linenumber") + 1)), pct(F.col("l_quantity") + 2)).alias("cells"))
    current = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("table_id"), F.when(F.col("s_suppkey") % 3 == 0, 1000000).otherwise(1).alias("n"))
    out = X.rebuild_tiers(li, roles, current)
    return out.groupBy("table_id").agg(F.count("*").alias("rows"), F.min("level").alias("first_level"), *(F.round(F.sum(c), 6).alias(c) for c in ("term_spread", "base_spread", "fee_rate")))


QUERIES = {f.__name__: f for f in (map_columns, rebuild_rows, first_table, unwrap_payload, clean_extraction, strip_geometry, amendment_cleanup, nav_hits, flatten_tree, redact_by_name, schema_subset, latest_report, rebuild_tiers)}

SQL = {
    "map_columns": "SELECT s_suppkey AS table_id, role, position FROM supplier JOIN (VALUES (0, 'name', 0), (0, 'share', 1), (0, 'amount', 2), (1, 'name', 1), (1, 'amount', 3), (2, 'share', 1)) v(m, role, position) ON s_suppkey % 3 = m",
    "rebuild_rows": """WITH r AS (SELECT l_suppkey AS table_id, 'L' || l_partkey AS nm, l_quantity::INT AS q, l_orderkey AS o, l_suppkey % 3 AS m FROM lineitem WHERE l_linenumber <> 7),
      p AS (SELECT table_id, CASE m WHEN 0 THEN nm ELSE q || '%' END AS name, CASE WHEN m = 0 THEN q / 100.0::DOUBLE END AS share, CASE WHEN m = 0 THEN o::DOUBLE END AS amount FROM r WHERE m < 2),
      g AS (SELECT table_id, count(*) AS rows, min(name) AS first_name, round(sum(share), 6) AS share, sum(amount) AS amount FROM p GROUP BY 1) SELECT * FROM g WHERE rows >= 2 AND rows > CASE WHEN table_id % 4 = 0 THEN 1000000 WHEN table_id % 2 = 0 THEN 1 ELSE 0 END""",
    "first_table": f"WITH {R.LINES} SELECT doc_id, 's' || part % 2 AS section_id, 't' || supp AS table_id FROM ln WHERE qty % 3 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, part % 2 ORDER BY n, part, supp, l_extendedprice) = 1",
    "unwrap_payload": """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '{"a":' || p_partkey || '}' ELSE '{"b":"' || p_name || '","c":{"d":[1,{"e":"f"}]}}' END AS data FROM part""",
    "clean_extraction": """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents) SELECT doc_id, '{"lang":"' || lang || '"}' AS answers, md5(CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '... [' || (length(t) - 500) || ' more]' ELSE t END) AS text_md5 FROM d""",
    "strip_geometry": f"""WITH {R.ANSWERS} SELECT '{{"answer":"' || answer || '","confidence":' || confidence || '}}' AS a, count(*) AS n FROM an GROUP BY 1""",
    "amendment_cleanup": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Amended and Restated Credit Agreement' ELSE 'Third Amendment' END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Amendment No. 2' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 1 THEN '2' END AS number FROM part",
    "nav_hits": f"WITH RECURSIVE {R.MATCHED}, h AS (SELECT doc_id, seq, contains(lower(concat_ws(' ', title, summary)), 'the')::INT + contains(lower(concat_ws(' ', title, summary)), 'que')::INT + contains(lower(concat_ws(' ', title, summary)), 'und')::INT + contains(lower(concat_ws(' ', title, summary)), 'tion')::INT AS hits FROM sm) SELECT doc_id, seq, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, seq) <= 2",
    "flatten_tree": f"SELECT p_partkey AS doc_id, path, coalesce(t, p_name) AS title FROM part, (SELECT '001.002' || repeat('.001', n - 2) AS path, CASE WHEN n < {CHAIN} THEN 'c' || n END AS t FROM range(2, {CHAIN + 1}) r(n) UNION ALL VALUES ('001', 'a'), ('001.001', NULL), ('002', 'e'), ('003', NULL)) v",
    "redact_by_name": f"""SELECT c_custkey AS id, '{{"ssn":"***-**-' || right({R.DIGITS}, 4) || '","name":"' || c_name || '","kids":[{{"dob":"****-**-** (1970)"}}]}}' AS owner FROM customer""",
    "schema_subset": "SELECT p_brand AS schema_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS field_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0",
    "rebuild_tiers": """WITH r AS (SELECT l_suppkey AS table_id, l_quantity::INT AS q, l_linenumber AS n, l_suppkey % 2 = 0 AS even FROM lineitem),
      t AS (SELECT table_id, CASE WHEN even THEN q || '%' ELSE n || '%' END AS level, CASE WHEN even THEN n / 100.0::DOUBLE END AS term, CASE WHEN NOT even THEN q / 100.0::DOUBLE WHEN n <> 3 THEN (n + 1) / 100.0::DOUBLE END AS base, CASE WHEN even THEN (q + 2) / 100.0::DOUBLE END AS fee FROM r)
      SELECT table_id, count(*) AS rows, min(level) AS first_level, round(sum(term), 6) AS term_spread, round(sum(base), 6) AS base_spread, round(sum(fee), 6) AS fee_rate FROM t GROUP BY 1 HAVING count(*) > CASE WHEN table_id % 3 = 0 THEN 1000000 ELSE 1 END""",
    "latest_report": f"WITH {W.VERDICTS} SELECT doc_id, baseline_id AS report_id, verdict FROM vd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC, supp DESC, l_extendedprice DESC, baseline_id DESC, verdict) = 1",
}
