"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy
from .decontaminate import overlaps
from .filter_audit import audit
from .language_model import score_documents
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dup import near_duplicates
from .neighbours import nearest
from .quality import classify
from .secrets import find_secrets
from .spelling import group_variants
from .substrings import remove_repeats
from .warc import round_trip


@tidy
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


@tidy
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@tidy
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@tidy
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


@tidy
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@tidy
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@tidy
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@tidy
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@tidy
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@tidy
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@tidy
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@tidy
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


@tidy
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_BLANKS = r"[^\x20\x09-\x0D]+"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secret_spans() -> str:
    """One row for each match of each kind, with its place: the pieces before it and the matches before it add up."""
    keys = "|".join(_any_case(w).replace("]_", "]_?") for w in ("password", "passwd", "secret", "token", "api_key"))
    kinds = [
        (0, f"({keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8, "true"),
        (1, "(AKIA[A-Z0-9]+)", 1, 16, "true"),
        (2, "([0-9a-f]+)", 1, 32, "true"),
        (3, "(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})", 1, 1, "true"),
        (4, "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, "true"),
        (5, "([A-Za-z0-9+/_=-]+)", 1, 32, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"),
    ]
    one = """SELECT doc_id, source, {0} AS kind, a, a + length(m) AS b, v FROM (
        SELECT doc_id, source, m[i] AS m, v[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, source, regexp_extract_all(t, '{1}') AS m, regexp_extract_all(t, '{1}', {2}) AS v, string_split_regex(t, '{1}') AS p FROM d WHERE regexp_matches(t, '{1}'))))
      WHERE length(v) >= {3} AND {4}"""
    return " UNION ALL ".join(one.format(*k) for k in kinds)


#: DuckDB SQL for those queries that SQL can express.
ORACLE: dict[str, str] = {
    "op3_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) < doc_id AS again FROM x),
        c AS (SELECT p.doc_id, p.i, word, max(coalesce(again, false)::INT) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
              FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
        g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op5_near_duplicates": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS node, regexp_extract_all(text, '{_BLANKS}') AS w FROM documents),
        s AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
                ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i+4], ' '))) END) AS h FROM d WHERE doc_id = node),
        n AS (SELECT node, count(*) AS n FROM s GROUP BY node),
        k AS (SELECT a.node AS u, b.node AS v, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.node < b.node GROUP BY ALL),
        e AS (SELECT u, v FROM k JOIN n x ON x.node = u JOIN n y ON y.node = v WHERE k >= 0.8 * (x.n + y.n - k)),
        l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r(node, root) AS (SELECT u, u FROM l UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node),
        c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT doc_id, coalesce(root, d.node) AS class_id, d.node AS copy_of FROM d LEFT JOIN c ON c.node = d.node""",
    "op6_secret_scan": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), c AS ({_secret_spans()}),
        k AS (SELECT * FROM c x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM c y WHERE y.doc_id = x.doc_id AND y.kind < 3 AND y.a < x.b AND x.a < y.b)),
        o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT doc_id) >= 10 OR owners >= 3 AS example FROM k GROUP BY v),
        j AS (SELECT doc_id, kind, a, b, owners, example, ['assign','access','hex','provider','pem','opaque'][kind + 1] || ':' || a || ':' || b AS s FROM k JOIN o USING (v) WHERE kind < 5 OR (NOT example AND owners <= 2))
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
          sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans,
          count(*) FILTER (WHERE owners = 1 AND NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example
        FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""",
    "op9_warc_round_trip": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
                     source_size::DOUBLE * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
        f AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM f),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
        c AS (SELECT d.*, u.source_size, u.target, u.copies, u.target - u.copies * u.source_size AS rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS grp
              FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
        SELECT doc_id, size, source_size, target,
               (size * (copies + CASE WHEN upto <= rest OR (upto - grp <= rest AND upto - rest < rest - (upto - grp)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM c""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        bw AS (SELECT item_id, len(w) AS n, least(13, len(w)) AS win, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM b),
        m AS (SELECT DISTINCT doc_id, item_id, n, win, dw.pos - bw.pos AS shift, bw.pos AS pos FROM dw JOIN bw USING (word)),
        r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM m),
        x AS (SELECT doc_id, item_id, win, max(k) AS matched FROM r GROUP BY ALL)
        SELECT doc_id, item_id, matched::BIGINT AS matched, win::BIGINT AS "window", matched / win::DOUBLE AS similarity
        FROM x JOIN (SELECT doc_id, max(len(w)) AS words FROM d GROUP BY doc_id) USING (doc_id) WHERE matched >= 0.8 * win AND (win >= 6 OR (matched = win AND (win >= 3 OR words = win)))""",
    "op11_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '{_BLANKS}') AS w, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS copy FROM d),
        m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false)::INT AS good, coalesce(bool_or(toxic = 1), false)::INT AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
                || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
                || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN copy THEN 'E' ELSE '' END) AS p
              FROM w LEFT JOIN m USING (doc_id)),
        c AS (SELECT part, p, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        o AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM l a JOIN l b ON b.l <> a.l JOIN l c ON c.l NOT IN (a.l, b.l) JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
        s AS (SELECT o, step, o[step] AS f, o[1:step - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
        x AS (SELECT c.*, s.*, contains(p, f) AS fails, len(list_intersect(string_split(p, ''), string_split(before, ''))) > 0 AND before <> '' AND p <> '' AS gone FROM c, s),
        r AS (SELECT part, o AS filter_order, step::INT AS step, f,
                coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE p = f), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost
              FROM x GROUP BY ALL)
        SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op12_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        g AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
