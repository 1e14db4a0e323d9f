"""The operators of this package as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlake.llm import (
    byte_bpe,
    conversation_repair,
    decontaminate,
    exact_dedup,
    fingerprints,
    jaccard_join,
    page_text,
    resampling,
    secrets,
    substring_dedup,
    token_file,
    toxicity,
    warc,
)
from marketlake.llm.common import importable, table

Query = Callable[[SparkSession, str], DataFrame]


def _query(operator: Callable[..., DataFrame], *names: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return operator(*[table(spark, sf_dir, name) for name in names], **options)

    return run


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": _query(jaccard_join.near_duplicates, "documents", k=4, percent=85),
    "op2_secret_scan": _query(secrets.digests, "documents"),
    "op3_token_file": _query(token_file.digests, "documents"),
    "op4_substring_dedup": _query(substring_dedup.digests, "documents"),
    "op5_exact_dedup": _query(exact_dedup.groups, "documents"),
    "op6_toxicity": _query(toxicity.predictions, "documents", "labels"),
    "op7_warc": _query(warc.digests, "pages"),
    "op8_page_text": _query(page_text.main_text, "pages"),
    "op9_decontaminate": _query(decontaminate.passages, "documents", "benchmark"),
    "op10_byte_bpe": _query(byte_bpe.digests, "documents"),
    "op11_importance_resampling": _query(resampling.resample, "documents", "benchmark"),
    "op12_conversation_repair": _query(conversation_repair.digests, "conversations"),
    "op13_document_fingerprints": _query(fingerprints.digests, "documents"),
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
#: CRC-32 of the UTF-8 bytes of a text: the table of 256 entries, and one step per byte.
_CRC32 = """
    WITH RECURSIVE steps(n, c, k) AS (
        SELECT range, range, 0 FROM range(256)
        UNION ALL
        SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
        FROM steps WHERE k < 8
    ), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8)
"""


def _crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, len({code}) // 2),
            lambda i: ('0x' || {code}[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


#: DuckDB SQL of those queries that it can express. The others run models or tokenizers.
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE
                WHEN len(w) >= 4 THEN list_sort(list_distinct(
                    [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE [] END AS s
            FROM worded
        ), classes AS (
            SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
        ), entries AS (SELECT c, n, unnest(s) AS g FROM classes),
        pairs AS (
            SELECT a.c AS a, b.c AS b FROM entries a JOIN entries b ON a.g = b.g AND a.c <> b.c
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT c AS a, c AS b FROM classes
            UNION
            SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
        ), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
            coalesce(root, doc_id) AS component_id
        FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN roots ON c = a
    """,
    "op4_substring_dedup": f"""
        WITH worded AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded)
        ), firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
        gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places
            FROM windows JOIN firsts USING (s) WHERE first < doc_id GROUP BY doc_id
        ), split AS (
            SELECT doc_id, w, coalesce(places, []) AS places FROM worded LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
            sha256(array_to_string(
                list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ')) AS kept_sha256
        FROM split
    """,
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256({_LOWER}) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY {_LOWER})
    """,
    "op7_warc": r"""
        WITH coded AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                regexp_extract(regexp_replace(coalesce(url, ''), '[\x00-\x20]', '%20', 'g'),
                    '^[a-z]+://[^/?#]*([^#]*)', 1) AS path,
                max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
            FROM pages
        )
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
            array_to_string([
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                    1 + ((('0x' || h[10 * (k // 8) + 1:10 * (k // 8) + 10])::BIGINT
                        >> (35 - 5 * (k % 8))) & 31)::BIGINT]
                FOR k IN range(0, 32)], '') AS payload_digest,
            CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to,
            CASE WHEN path = '' THEN '/' ELSE path END AS request_target,
            CAST(octet_length(encode(html)) AS BIGINT) AS metadata_bytes
        FROM coded
    """,
    "op11_importance_resampling": f"""
        {_CRC32}, words AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER},
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), wanted AS (
            SELECT list_filter(regexp_split_to_array({_LOWER},
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), source AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM words) GROUP BY x),
        target AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM wanted) GROUP BY x),
        coded AS (
            SELECT x, coalesce(source.n, 0) AS s, coalesce(target.n, 0) AS t0,
                {_crc32("x")} % 10000 AS bucket
            FROM source FULL JOIN target USING (x), crc
        ), buckets AS (
            SELECT bucket, sum(s)::DOUBLE AS s, sum(t0)::DOUBLE AS t,
                sum(sum(s)) OVER () + 10000 AS all_s, sum(sum(t0)) OVER () + 10000 AS all_t
            FROM coded GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * all_s::DOUBLE / ((s + 1) * all_t::DOUBLE)))::BIGINT AS gain
            FROM buckets
        ), weights AS (
            SELECT doc_id, sum(gain) AS weight
            FROM (SELECT doc_id, unnest(w) AS x FROM words) JOIN coded USING (x) JOIN gains USING (bucket)
            GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((
                    ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN weights USING (doc_id)
        ), drawn AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
            FROM scored WHERE n_features >= 20
        )
        SELECT scored.*, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
        FROM scored LEFT JOIN drawn USING (doc_id)
    """,
    "op12_conversation_repair": f"""
        {_CRC32}, faulty AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
            FROM conversations, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM faulty
        ), placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
            FROM damaged
        ), faults AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS letter,
                left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated'
                    ELSE '' END AS fault
            FROM placed
        ), moves(q, e, role, q2, cost) AS (VALUES
            (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
            (0, 'R', 'user', 2, 2), (1, 'R', 'user', 2, 2), (2, 'R', 'assistant', 3, 2), (3, 'R', 'user', 2, 2)
        ), gaps(q, n, q2, roles) AS (VALUES
            (0, 0, 0, ''), (0, 1, 2, 'u'), (0, 2, 3, 'ua'), (0, 3, 2, 'uau'), (1, 0, 1, ''), (1, 1, 2, 'u'),
            (1, 2, 3, 'ua'), (1, 3, 2, 'uau'), (2, 0, 2, ''), (2, 1, 3, 'a'), (2, 2, 2, 'au'),
            (3, 0, 3, ''), (3, 1, 2, 'u'), (3, 2, 3, 'ua')
        ), ways AS (
            SELECT conv_id, 0 AS i, 0 AS q, 0 AS cost, '' AS audit, [] :: VARCHAR[] AS lines
            FROM (SELECT DISTINCT conv_id FROM faults)
            UNION ALL
            SELECT conv_id, i, q, best.cost, best.audit, best.lines FROM (
                SELECT w.conv_id, f.i, coalesce(m.q2, g.q2) AS q, min({{
                    'cost': w.cost + 2 * g.n + CASE WHEN m.e IS NULL THEN 3
                        ELSE m.cost + (f.fault = 'truncated')::INT END,
                    'audit': w.audit || repeat('I', g.n) || coalesce(m.e, 'D'),
                    'lines': w.lines || list_transform(string_split(g.roles, ''),
                        lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[1:g.n]
                        || CASE m.e WHEN 'K' THEN [f.role || ':' || f.text]
                            WHEN 'R' THEN [m.role || ':' || f.text] ELSE [] END
                }}) AS best
                FROM ways w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1
                JOIN gaps g ON g.q = w.q
                LEFT JOIN (SELECT * FROM moves UNION ALL SELECT q, NULL, NULL, q, 3 FROM range(4) r(q)) m
                    ON m.q = g.q2 AND (m.e IS NULL OR f.fault NOT IN ('blank', 'duplicate')
                        AND (m.e = 'R' OR m.role = f.letter))
                GROUP BY w.conv_id, f.i, coalesce(m.q2, g.q2)
            )
        ), ends AS (
            SELECT conv_id, min({{'cost': cost + 2 * g.n, 'audit': audit || repeat('I', g.n),
                'lines': lines || list_transform(string_split(g.roles, ''),
                    lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[1:g.n]}}) AS best
            FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS n FROM ways) w JOIN gaps g ON g.q = w.q
            WHERE i = w.n AND g.q2 IN (0, 3) GROUP BY conv_id
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id
        )
        SELECT all_ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
            coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
            coalesce(best.audit, '') AS audit,
            sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) all_ids
        LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM all_ids.conv_id
        LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM all_ids.conv_id
    """,
}
