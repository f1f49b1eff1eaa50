"""Names, callables and oracle SQL of the subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline.run}


OP3 = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, q, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (
  SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND k = 1
"""

OP4 = """
WITH words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
               FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
c1 AS (SELECT w, count(*) AS n FROM words GROUP BY w),
pairs AS (SELECT a.doc_id, a.w AS v, b.w FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
c2 AS (SELECT v, w, count(*) AS n FROM pairs GROUP BY v, w),
scored AS (SELECT doc_id, CASE WHEN c2.n >= 2 THEN ln(c2.n) - ln(cv.n) ELSE ln(0.4) + ln(cw.n) - ln((SELECT count(*) FROM words)) END AS s
           FROM pairs JOIN c2 USING (v, w) JOIN c1 cv ON cv.w = pairs.v JOIN c1 cw ON cw.w = pairs.w)
SELECT d.doc_id, CAST(count(s) AS BIGINT) AS n_scored, round(coalesce(sum(s), 0.0), 4) AS log_score
FROM documents d LEFT JOIN scored ON d.doc_id = scored.doc_id GROUP BY d.doc_id
"""

OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_cascade": OP3, "op4_stupid_backoff": OP4, "op6_warc_revisit": OP6}
