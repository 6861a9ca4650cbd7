"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.llm.alignment import alignment_report
from vintagebook.llm.audit import audit_report
from vintagebook.llm.common import WORD, table
from vintagebook.llm.exactdedup import exact_dedup_report
from vintagebook.llm.fingerprints import fingerprint_report
from vintagebook.llm.language import language_report
from vintagebook.llm.mixing import SEED, mix_report
from vintagebook.llm.packing import packing_report
from vintagebook.llm.repeats import repeats_report
from vintagebook.llm.simhash import near_duplicates
from vintagebook.llm.tokens import token_counts
from vintagebook.llm.topk import top_k
from vintagebook.llm.toxicity import toxicity_report
from vintagebook.llm.warc import archive_report


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _on("documents", near_duplicates),
    "op2_token_counts": _on("documents", token_counts),
    "op3_packing": _on("documents", packing_report),
    "op4_repeats": _on("documents", repeats_report),
    "op5_fingerprints": _on("documents", fingerprint_report),
    "op6_toxicity": lambda spark, sf_dir: toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_mixing": _on("documents", mix_report),
    "op8_top_k": lambda spark, sf_dir: top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0),
    "op9_language": _on("documents", language_report),
    "op10_warc": _on("pages", archive_report),
    "op11_exact_dedup": _on("documents", exact_dedup_report),
    "op12_alignment": _on("documents", alignment_report),
    "op13_filter_audit": lambda spark, sf_dir: audit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

SQL: dict[str, str] = {
    "op7_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS most FROM s),
        f AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(most) OVER filling, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0)) AS level
              FROM w WINDOW filling AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT arg_min(level, most / weight) AS common FROM f WHERE most > level * weight),
        t AS (SELECT source, source_size, CASE WHEN most <= level * weight OR common IS NULL THEN most ELSE least(most, common * weight) END AS target FROM f, c),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM t)
        SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN
            ('0x' || substr(sha256(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(d.source, '-'))), 1, 13))::BIGINT / 4503599627370496e0 < rate - floor(rate)
            THEN 1 ELSE 0 END AS BIGINT) AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_filter_audit": rf"""
        WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
              FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
                     min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(words) < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                     | CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
                     | CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END | CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
              FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
        r AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM s, c GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return QUERIES | {"pipeline": run}


def statements() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return SQL | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})


__all__ = ["QUERIES", "SQL", "WORD", "queries", "statements"]
