"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)"

# the characters stripped or counted as white space: blank, and code points 9 to 13
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# phrases of the boilerplate rule
_BOILER = ("accept cookies|all rights reserved|click here|cookie policy|enable javascript|lorem ipsum|"
           "privacy policy|read more|sign up for our newsletter|subscribe to our newsletter|terms of service|terms of use")



def _licence_sql() -> str:
    """The texts of the templates are data; words, cues, windows and weights are worked out here again, from line positions."""
    from corvid.llm.licenses import NOTICES, TEXTS

    texts = [(licence, False, t) for licence, notices in NOTICES.items() for t in notices]
    texts += [(p.stem, True, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    quoted = [(licence, full, t.replace("'", "''")) for licence, full, t in texts]
    values = ", ".join(f"({k}, '{licence}', {full}, '{t}')" for k, (licence, full, t) in enumerate(quoted))
    words = "regexp_extract_all(replace(lower({}), 'licenc', 'licens'), '[a-z0-9]+(?:\\.[0-9]+)*')"
    return f"""
WITH src(k, licence, full_text, text) AS (VALUES {values}),
tpl AS (SELECT k, licence, full_text, {words.format('text')} AS x FROM src),
lead AS (SELECT k, len(x) AS m, min(i) AS ahead, min_by(x[i], i) AS cue
  FROM (SELECT k, x, unnest(range(1, len(x) + 1)) AS i FROM tpl WHERE NOT full_text)
  WHERE regexp_matches(x[i], '^licens|^redistribut|^permission|^domain') GROUP BY k, m),
tt AS (SELECT k, term, 1 + ln(count(*)) AS f FROM (SELECT k, unnest(x) AS term FROM tpl) GROUP BY k, term),
docs AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM docs),
held AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({words.format('text')})) AS term FROM docs)
  WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT t.term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) t LEFT JOIN held USING (term), total),
tw AS (SELECT k, term, f * idf / sqrt(sum((f * idf) ** 2) OVER (PARTITION BY k)) AS w FROM tt JOIN idf USING (term)),
cued AS (SELECT * FROM docs WHERE regexp_matches({words.format('text')}::VARCHAR, 'licens|redistribut|permission|domain')),
raw AS (SELECT doc_id, {words.format('line')} AS x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cued)),
lines AS (SELECT doc_id, x, i, sum(len(x)) OVER (PARTITION BY doc_id ORDER BY i) AS behind, sum(len(x)) OVER (PARTITION BY doc_id) AS n_file
  FROM raw WHERE len(x) > 0),
spot AS (SELECT doc_id, n_file, x[j] AS cue, behind - len(x) + j AS p FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM lines)),
laid AS (SELECT doc_id, k, m, p, n_file, greatest(p - ahead + 1, 1) AS a, least(p - ahead + m, n_file) AS b FROM spot JOIN lead USING (cue)),
win AS (SELECT laid.doc_id, k, p, flatten(list(x ORDER BY i)) AS x, 2 * sum(len(x)) >= any_value(laid.n_file) AS whole
  FROM laid JOIN lines ON lines.doc_id = laid.doc_id AND behind >= a AND behind - len(x) + 1 <= b
  GROUP BY laid.doc_id, k, p, m HAVING sum(len(x)) <= 3 * m),
units AS (SELECT doc_id, k, p, x, whole FROM win
  UNION ALL SELECT doc_id, k, 0, {words.format('text')}, true FROM cued, tpl WHERE full_text),
tf AS (SELECT doc_id, k, p, whole, term, 1 + ln(count(*)) AS f FROM (SELECT doc_id, k, p, whole, unnest(x) AS term FROM units) GROUP BY ALL),
w AS (SELECT doc_id, k, p, whole, tf.term, f * coalesce(idf, ln(n + 1.0) + 1) AS w FROM total, tf LEFT JOIN idf USING (term)),
score AS (SELECT doc_id, w.k, p, whole, round(sum(w.w * tw.w) / sqrt(sum(w.w ** 2)), 6) AS score
  FROM w LEFT JOIN tw ON tw.k = w.k AND tw.term = w.term GROUP BY ALL HAVING score >= 0.75),
own AS (SELECT doc_id, licence, score, whole FROM score JOIN src USING (k)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, score DESC, k) = 1),
files AS (SELECT own.*, path FROM own JOIN docs USING (doc_id)),
by_dir AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, licence, count(*) AS n FROM files WHERE whole GROUP BY ALL),
dir AS (SELECT dir, licence FROM by_dir QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, licence) = 1)
SELECT d.doc_id, d.path, coalesce(own.licence, a.licence, b.licence, c.licence) AS licence, own.score,
  CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN coalesce(a.licence, b.licence, c.licence) IS NOT NULL THEN 'inherited' END AS origin
FROM docs d LEFT JOIN own ON own.doc_id = d.doc_id
  LEFT JOIN dir a ON a.dir = regexp_extract(d.path, '^(.*)/[^/]*$', 1)
  LEFT JOIN dir b ON b.dir = regexp_extract(d.path, '^(.*)/[^/]*/[^/]*$', 1)
  LEFT JOIN dir c ON c.dir = ''"""


def _clusters_sql(rounds: int = 3) -> str:
    """Plain distances to 16 centroids, with one pair of tables for each round."""
    ctes = ["""v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) <= 16)"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS best FROM
  (SELECT v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k} c)
  GROUP BY vec_id, x)""")
        if k < rounds:
            ctes.append(f"""m{k} AS (SELECT c, list(m ORDER BY j) AS x FROM (SELECT c, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM
  (SELECT best.c AS c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS j) GROUP BY best.c, j)) GROUP BY c)""")
            ctes.append(f"c{k + 1} AS (SELECT c, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m USING (c))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE_SQL = {
    "op12_centroid_clustering": _clusters_sql(),
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op7_license_scan": _licence_sql(),
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_transform([('0x' || substr(d, i * 5 + 1, 5))::BIGINT],
    lambda v: {' || '.join(_B32.format(s=s) for s in (15, 10, 5, 0))})[1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM m""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.top IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM d GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x:
      (length(regexp_replace(x, '[^|>»›•·]', '', 'g')) >= 3 AND length(regexp_replace(x, '[^|>»›•·]', '', 'g')) * 4
         >= length(regexp_replace(x, '[^\\x20\\x09-\\x0D]', '', 'g')))
      OR (length(regexp_replace(x, '[^#*$%&<>{{}}^~=_\\\\]', '', 'g')) >= 3
         AND length(regexp_replace(x, '[^#*$%&<>{{}}^~=_\\\\]', '', 'g')) >= 0.1 * length(x))
      OR len(regexp_extract_all(x, '[!?][!?]')) >= 3 OR regexp_matches(lower(x), '{_BOILER}')),
      lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')))), 0) AS lost
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars - lost >= 0.5 * word_chars AS kept FROM f""",
    "op8_ngram_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id""",
}
