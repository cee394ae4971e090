"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import chat, conversation_repair, decontaminate, html_extract, jpeg, licenses, mixing, pii, quality, secrets, simhash, suffix_dedup, token_alignment
from docspark.llm._common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op1(table(spark, sf_dir, "documents"))


def op2_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.op2(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.op11(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op12(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op13(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_jpeg_media, op3_chat_format, op4_decontamination, op5_secrets, op6_mixing, op7_simhash, op8_html_extract, op9_quality, op10_pii, op11_token_alignment, op12_license_scan, op13_conversation_repair, pipeline)}


#: The digests of every conversation, and of -7, by the template's lengths.
OP3_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
  e AS (SELECT *, CASE WHEN contains(text, '\') OR contains(text, ' </turn>' || chr(10)) THEN len(regexp_extract_all(text, '\\|###|</turn>|: ', 0, 'i')) ELSE 0 END AS escapes FROM c),
  j AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, sum(15 + length(role) + length(text) + escapes)::BIGINT AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM j"""

#: Slots by earliest deadline, slot after slot, then each row's block and slot.
OP6_SQL = """WITH RECURSIVE sz AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
  sh AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) AS i, greatest(1000, 8 * count(*) OVER ()) AS q, (greatest(1000, 8 * count(*) OVER ()) - count(*) OVER ()) * w / sum(w) OVER () AS share, count(*) OVER () AS k FROM sz),
  lo AS (SELECT *, floor(share)::BIGINT AS low, row_number() OVER (ORDER BY -round(share - floor(share), 9), i) AS r, q - k - sum(floor(share)::BIGINT) OVER () AS rest FROM sh),
  tg AS (SELECT source, n, i, q, 1 + low + (r <= rest)::INT AS c FROM lo),
  one AS (SELECT list(c ORDER BY i) AS cs, max(q) AS q FROM tg),
  ed(t, done, pick) AS (SELECT -1::BIGINT, list_transform(cs, lambda x: 0::BIGINT), 0::BIGINT FROM one
    UNION ALL SELECT t, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END), p FROM (SELECT t + 1 AS t, done, (list_min(list_transform(done, lambda d, j: CASE WHEN d < cs[j] AND d * q // cs[j] <= t + 1 THEN ((d + 1) * q + cs[j] - 1) // cs[j] * 100000 + j END)) % 100000)::BIGINT AS p FROM ed, one WHERE t + 1 < q) x),
  sl AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS o FROM ed WHERE t >= 0),
  d AS (SELECT doc_id, d.source, tg.i, c, q, ((doc_id % 2147483648) * 2654435761 >> 12) % ceil(n / 1024.0)::BIGINT AS g FROM documents d JOIN tg ON tg.source IS NOT DISTINCT FROM d.source),
  rk AS (SELECT *, row_number() OVER (PARTITION BY i, g ORDER BY doc_id) AS rn FROM d),
  fs AS (SELECT i, g, coalesce(sum(ceil(m / 16.0)::BIGINT) OVER (PARTITION BY i ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT i, g, count(*) AS m FROM d GROUP BY 1, 2)),
  bl AS (SELECT rk.*, first + (rn - 1) // 16 AS mix_block FROM rk JOIN fs ON fs.i = rk.i AND fs.g = rk.g)
SELECT doc_id, source, mix_block::BIGINT AS mix_block, (mix_block // c * q + t)::BIGINT AS mix_slot FROM bl JOIN sl ON sl.i = bl.i AND sl.o = mix_block % c"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force."""
    return {"op3_chat_format": OP3_SQL, "op6_mixing": OP6_SQL, "op12_license_scan": licenses.op12_sql(), "op13_conversation_repair": conversation_repair.OP13_SQL}
