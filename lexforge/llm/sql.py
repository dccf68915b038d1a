"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from .url_filter import SUFFIXES

_WORDS = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), line AS (
  SELECT r, unnest(lines) AS l, unnest(range(len(lines))) AS k FROM d
), judged AS (
  SELECT r, k, l, len(regexp_extract_all(l, '{_WORDS}')) AS n FROM line
), verdict AS (
  SELECT r, k, l, n, n = 0 OR (
    (n >= 4 OR regexp_matches(l, '[.!?:;\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]["''\x{{201D}}\x{{2019}}\x{{00BB}})\]]*(?:[\x20\x09-\x0D]|\z)'))
    AND 2 * len(regexp_extract_all(l, '[#*$%&|<>~^=_]+')) <= n
    AND 4 * len(regexp_extract_all(l, '[!?]{{2}}')) <= n + 3
    AND NOT regexp_matches(l, '(?i)\A[\x20\x09-\x0D]*(?:home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back|back to top|read more|skip to content|site ?map|contact(?: us)?|about(?: us)?|share|print|subscribe|products|services|blog|news|faq|careers|help|privacy|terms|startseite|impressum|kontakt|datenschutz|anmelden|suche|accueil|connexion|rechercher|mentions l[\x{{E9}}\x{{C9}}]gales|inicio|contacto|buscar|acerca de)(?:[\x20\x09-\x0D.:>|/\x{{B7}}-]+(?:home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back|back to top|read more|skip to content|site ?map|contact(?: us)?|about(?: us)?|share|print|subscribe|products|services|blog|news|faq|careers|help|privacy|terms|startseite|impressum|kontakt|datenschutz|anmelden|suche|accueil|connexion|rechercher|mentions l[\x{{E9}}\x{{C9}}]gales|inicio|contacto|buscar|acerca de))*[\x20\x09-\x0D.:>|]*\z')
    AND 4 * len(regexp_extract_all(l, '(?:\A|[\x20\x09-\x0D])[|\x{{00BB}}\x{{203A}}\x{{2022}}\x{{00B7}}>/](?:[\x20\x09-\x0D]|\z)')) <= n
    AND NOT regexp_matches(l, '(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|use of cookies|enable javascript|lorem ipsum|copyright \x{{A9}}|\x{{A9}} ?[0-9]{{4}}|alle rechte vorbehalten|tous droits r[\x{{E9}}\x{{C9}}]serv[\x{{E9}}\x{{C9}}]s|todos los derechos reservados')) AS good
  FROM judged
), by_line AS (
  SELECT r, count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS n_dup_lines,
         count(*) FILTER (WHERE NOT good) AS n_lines_removed,
         coalesce(sum(n) FILTER (WHERE NOT good), 0) AS n_words_removed
  FROM verdict GROUP BY r
), win AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), often AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n >= 2
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS t(o) GROUP BY r
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_lines_removed::BIGINT AS n_lines_removed, n_words_removed::BIGINT AS n_words_removed
  FROM d JOIN by_line USING (r) LEFT JOIN covered USING (r)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_removed <= 50 * n_words AS kept
FROM figures
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fit AS (
  SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS s FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.98
), reach AS (
  SELECT DISTINCT a AS n, a AS m FROM link
  UNION
  SELECT reach.n, link.b FROM reach JOIN link ON reach.m = link.a
), component AS (
  SELECT n, min(m) AS c FROM reach GROUP BY n
), degree AS (
  SELECT a, count(*) AS k FROM link GROUP BY a
)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept
FROM v LEFT JOIN degree ON a = vec_id LEFT JOIN component ON n = vec_id
"""

OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d
), g AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT DISTINCT a AS n, a AS m FROM link
  UNION
  SELECT reach.n, link.b FROM reach JOIN link ON reach.m = link.a
), component AS (
  SELECT n, min(m) AS c FROM reach GROUP BY n
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(c, doc_id)::BIGINT AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM s LEFT JOIN component ON n = doc_id
"""
OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::UBIGINT FOR i IN range(4)] AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1))::BIGINT AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1))::BIGINT AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same integers, round by round: distances to all entries, the nearest, and floored means."""
    steps = [
        f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS e FROM v, range({parts}) AS t(p)
), c0 AS MATERIALIZED (
  SELECT p, s - 1 AS j, e FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, e) AS s FROM v WHERE vec_id IS NOT NULL QUALIFY s <= {entries}) USING (r)
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT r, p, min(d) AS d, arg_min(j, d * {entries} + j) AS j FROM (
    SELECT x.r, p, j, list_sum(list_transform(range(1, len(x.e) + 1), lambda i: (x.e[i] - c{k}.e[i]) * (x.e[i] - c{k}.e[i])))::BIGINT AS d FROM x JOIN c{k} USING (p)
  ) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c{k}.p, c{k}.j, coalesce(n.e, c{k}.e) AS e FROM c{k} LEFT JOIN (
    SELECT p, j, list(floor_of ORDER BY i) AS e FROM (
      SELECT p, j, i, ((sum(w) - ((sum(w) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_of
      FROM (SELECT m{k}.p, m{k}.j, unnest(x.e) AS w, unnest(range(len(x.e))) AS i FROM m{k} JOIN x USING (r, p)) GROUP BY p, j, i
    ) GROUP BY p, j
  ) n ON n.p = c{k}.p AND n.j = c{k}.j
)""")
    return (
        "WITH "
        + ",".join(steps)
        + f""", code AS (
  SELECT r, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM m{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN code USING (r), digest
"""
    )


_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
_TURN = "0.5 > (a + 1) / (a + b + 2)"

#: The beta tail by its continued fraction, one row a host and step; the fraction's steps are as many as convergence needs.
OP13 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(regexp_extract(coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, ''), '(?s)\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, ''), '(?s)\A[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), known AS (
  SELECT doc_id::VARCHAR AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(regexp_replace(host, '(?s)\A.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') AS name
  FROM u LEFT JOIN known ON doc = regexp_extract(path, '/([0-9]+)(?:\.[A-Za-z]+)?(?:/|\z)', 1) GROUP BY host
), i AS (
  SELECT *, regexp_matches(name, '\A(?:[0-9]+(?:\.[0-9]+)*|\[.*)\z') AS address, string_split(name, '.') AS l FROM h
), j AS (
  SELECT *, CASE WHEN len(l) >= 2 AND array_to_string(l[-2:], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS k FROM i
), hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN '' ELSE array_to_string(l[-k:], '.') END AS suffix, CASE WHEN address THEN name ELSE array_to_string(l[-k - 1:], '.') END AS domain FROM j
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS c FROM domains GROUP BY suffix
), s1 AS (
  SELECT *, sum((bad - n * c) ** 2 - n * c * (1 - c)) OVER () AS o, sum(n * (n - 1.0) * c * (1 - c)) OVER () AS m FROM s0
), s2 AS (
  SELECT *, 1 / CASE WHEN m > 0 THEN greatest(least(o / m, 1 / 3.0), 1 / 1001.0) ELSE 1 / 1001.0 END - 1 AS w FROM s1
), d0 AS (
  SELECT d.*, (s2.bad + w * s2.c) / (s2.n + w) AS c FROM domains d JOIN s2 USING (suffix)
), d1 AS (
  SELECT *, sum((bad - n * c) ** 2 - n * c * (1 - c)) OVER () AS o, sum(n * (n - 1.0) * c * (1 - c)) OVER () AS m FROM d0
), d2 AS (
  SELECT *, 1 / CASE WHEN m > 0 THEN greatest(least(o / m, 1 / 3.0), 1 / 1001.0) ELSE 1 / 1001.0 END - 1 AS w FROM d1
), h0 AS (
  SELECT t.*, (d2.bad + w * d2.c) / (d2.n + w) AS c FROM hosts t JOIN d2 USING (domain)
), h1 AS (
  SELECT *, sum((bad - n * c) ** 2 - n * c * (1 - c)) OVER () AS o, sum(n * (n - 1.0) * c * (1 - c)) OVER () AS m FROM h0
), h2 AS (
  SELECT *, 1 / CASE WHEN m > 0 THEN greatest(least(o / m, 1 / 3.0), 1 / 1001.0) ELSE 1 / 1001.0 END - 1 AS w FROM h1
), beta AS (
  SELECT host, n, bad, bad + w * c AS a, n - bad + w * (1 - c) AS b FROM h2
), side AS (
  SELECT *, {_TURN} AS turn, CASE WHEN {_TURN} THEN b ELSE a END AS p, CASE WHEN {_TURN} THEN a ELSE b END AS q FROM beta
), f AS (
  SELECT host, p, q, 0 AS k, 1e300::DOUBLE AS c, 1.0::DOUBLE AS d, 1.0::DOUBLE AS y FROM side
  UNION ALL
  SELECT host, p, q, k + 1, 1 + g / c, 1 / (1 + g * d), y * (1 + g / c) / (1 + g * d) FROM (
    SELECT *, CASE WHEN (k + 1) % 2 = 0 THEN ((k + 1) // 2) * (q - (k + 1) // 2) * 0.5 / ((p + 2 * ((k + 1) // 2) - 1) * (p + 2 * ((k + 1) // 2)))
              ELSE -(p + (k + 1) // 2) * (p + q + (k + 1) // 2) * 0.5 / ((p + 2 * ((k + 1) // 2)) * (p + 2 * ((k + 1) // 2) + 1)) END AS g
    FROM f WHERE k < 120 + 8 * sqrt(p + q)
  )
), tail AS (
  SELECT host, exp(p * ln(0.5) + q * ln(0.5) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * y AS z FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY k DESC) = 1
), judged AS (
  SELECT side.host, n, bad, CASE WHEN turn THEN z ELSE 1 - z END AS above FROM side JOIN tail ON side.host = tail.host
), ruled AS (
  SELECT page_id, u.host, path, n, bad, above,
         CASE WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u JOIN judged ON u.host = judged.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN above >= 0.95 THEN 'block' ELSE 'allow' END AS verdict,
       n::BIGINT AS host_judged, bad::BIGINT AS host_bad
FROM ruled
"""

ORACLES = {"op3_quality_rules": OP3, "op9_minhash_near": OP9, "op10_vector_near": OP10, "op11_vector_codes": _op11(), "op12_fill_middle": OP12, "op13_url_reputation": OP13}
