"""SQL forms of the dealt queries that have one."""

# Words of a text, A-Z folded; the blanks that part them are x20 and x09-x0D.
_WORDS = r"""list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
docs AS (
  SELECT *, CASE WHEN size = 0 THEN 1 ELSE floor(log2(size))::BIGINT + 1 END AS bits FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
    coalesce(sum(source_size) OVER w, 0)::BIGINT AS capped, coalesce(sum(weight) OVER w, 0)::BIGINT AS used
  FROM sources
  WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((total - 3 * capped)::DOUBLE, used) AS rest, arg_min((weights - used)::DOUBLE, used) AS shares
  FROM filled WHERE weight * (total - 3 * capped)::DOUBLE / (weights - used)::DOUBLE <= 3.0 * source_size),
targets AS (
  SELECT source, source_size, CASE WHEN 3.0 * source_size < weight * rest / shares
    THEN 3.0 * source_size ELSE weight * rest / shares END AS target
  FROM sources, level),
classes AS (
  SELECT t.source, target, bits, sum(size)::BIGINT AS words
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL),
tried AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER up, 0)::BIGINT)
      / (sum(bits * words) OVER (PARTITION BY source ORDER BY bits))::BIGINT AS level
  FROM classes
  WINDOW up AS (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT source, coalesce(max_by(level, bits) FILTER (WHERE level * bits <= 3), 3.0) AS level
  FROM tried GROUP BY source),
wanted AS (
  SELECT c.source, any_value(level) AS level,
    any_value(target) - sum(floor(least(3.0, level * bits))::BIGINT * words)::BIGINT AS wanted
  FROM classes c JOIN levels l ON c.source IS NOT DISTINCT FROM l.source GROUP BY c.source),
chances AS (
  SELECT d.*, source_size, target, wanted,
    CASE WHEN size > 0 THEN floor(least(3.0, level * bits))::BIGINT ELSE 0 END AS whole,
    CASE WHEN size > 0 THEN least(3.0, level * bits) - floor(least(3.0, level * bits)) ELSE 0.0 END AS chance,
    (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    LEFT JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT *, CASE WHEN chance > 0 THEN (draw / (1 - draw)) / (chance / (1 - chance)) ELSE 'inf'::DOUBLE END AS odds
        FROM chances))
SELECT doc_id, size, source_size, target,
  whole + (chance > 0 AND before + size / 2.0::DOUBLE <= wanted)::BIGINT AS copies,
  (whole + (chance > 0 AND before + size / 2.0::DOUBLE <= wanted)::BIGINT) * size AS taken
FROM ranked
"""

_REACHED = """
reached AS (
  SELECT id, id AS root FROM nodes
  UNION
  SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.id)
"""

SHINGLES = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
  FROM split),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM sets d JOIN (SELECT id, min(root) AS component_id FROM reached GROUP BY id) c ON c.id = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACHED}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, c.component_id,
  v.vec_id = c.component_id AS kept
FROM embeddings v JOIN (SELECT id, min(root) AS component_id FROM reached GROUP BY id) c ON c.id = v.vec_id
"""

URLS = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""

# Base32 of a SHA-1 in hexadecimal: each sign takes five bits out of two neighbouring digits.
WARC = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) || '0' AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      ((instr('0123456789abcdef', substr(hex, 1 + 5 * i // 4, 1)) - 1) * 16
        + instr('0123456789abcdef', substr(hex, 2 + 5 * i // 4, 1)) - 1) // [8, 4, 2, 1][1 + 5 * i % 4]) % 32)::INTEGER, 1)
    FOR i IN range(32)], '') AS payload_digest
  FROM hashed),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""

NEGATIVES = """
WITH given AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM given a JOIN given b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
