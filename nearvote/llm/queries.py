"""The queries opN_<name>, each its operator over a whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearvote.llm import chat_format, compression_quality, decontaminate, line_crf, ngram_join, packing, secret_scan, toxicity, url_filter, warc
from nearvote.llm.common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.report(turns.unionByName(extra))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_quality_rules, op4_ngram_jaccard_join, op5_secret_scans, op6_chat_formatting, op7_warc, op8_packing, op9_quality_classifier, op10_decontamination)}


def _spans_sql() -> str:
    """(rid, kind_order, kind, start, stop) of all kept matches; starts are running sums of lengths."""
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        # Pieces between matches, from the same expression without groups.
        plain = rule.pattern.replace("(?i:", "(?i:\0").replace("(p", "(?:p").replace("([", "(?:[").replace("\0", "").replace("'", "''") if rule.group else pattern
        parts.append(f"""
        SELECT rid, {order} AS kind_order, '{rule.kind}' AS kind, got, n, sum(gap + n) OVER (PARTITION BY rid ORDER BY i) - n AS start
        FROM (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x))) AS got,
                     unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap
              FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{plain}') AS gaps FROM texts))
        WHERE true QUALIFY got >= {rule.least}""")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.RULES if r.base)
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    op5 = f"""
    WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
    found AS ({_spans_sql()}),
    spans AS (SELECT rid, kind_order, kind, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM found)
    SELECT any_value(d.doc_id) AS doc_id, {counts},
           sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) FILTER (kind IN ({base})), '')) AS base_sha256,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order), '') AS spans
    FROM texts d LEFT JOIN spans s ON d.rid = s.rid GROUP BY d.rid"""
    escaped = lambda x: f"length({x})" + "".join(f" + {len(safe) - 1} * (length({x}) - length(replace({x}, '{plain}', '')))" for plain, safe in chat_format.ESCAPES)
    sizes = " ".join(f"WHEN '{role}' THEN {len(s.before + s.after)}" for role, s in chat_format.TEMPLATE.items())
    other = len((chat_format.OTHER.before + chat_format.OTHER.after).replace("{role}", ""))
    op6 = f"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    loss AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt, {escaped("text")} + CASE role {sizes} ELSE {other} + {escaped("role")} END AS size FROM said),
    orders AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles FROM said GROUP BY conv_id)
    SELECT l.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256, sum(size)::BIGINT AS formatted_chars,
           any_value(regexp_full_match(array_to_string(o.roles, ' '), '(system )*user assistant( user assistant)*')) AS valid
    FROM loss l JOIN orders o ON l.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY l.conv_id"""
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    op7 = f"""
    WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    digests AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM bodies),
    keepers AS (SELECT h, max(page_id) AS keeper FROM digests GROUP BY h)
    SELECT page_id, payload_bytes, {letters} AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM digests JOIN keepers USING (h)"""
    return {"op5_secret_scans": op5, "op6_chat_formatting": op6, "op7_warc": op7}
