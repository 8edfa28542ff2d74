"""DuckDB SQL for the operators whose exact rows SQL can say, over whole tables."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOWS_OF_WORDS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
early AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN early USING (h) WHERE f < win.doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[s:s + 4], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, s, md5(substr(x, 2 * s - 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS s FROM d WHERE length(x) >= 200)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
marked AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
span AS (SELECT doc_id, run, min(s) AS a, max(s) + 99 AS b FROM marked GROUP BY ALL),
gap AS (SELECT doc_id, a, coalesce(lag(b) OVER w, 0) AS before FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
piece AS (SELECT d.doc_id, a, substr(x, 2 * before + 1, 2 * (a - before - 1)) AS t FROM gap JOIN d USING (doc_id)),
joined AS (SELECT doc_id, string_agg(t, '' ORDER BY a) AS t FROM piece GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS e FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN joined USING (doc_id) LEFT JOIN total USING (doc_id)"""


FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
fails AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
share AS (SELECT part, bit AS of_bit, sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS shapley FROM cell, letter GROUP BY ALL)
SELECT part, filter_order, step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, any_value(shapley)::BIGINT AS shapley
FROM steps, cell JOIN share USING (part) WHERE of_bit = bit GROUP BY part, filter_order, step"""


def _round(n: int) -> str:
    """Each part's nearest entry of the codebooks of a round, and the codebooks after it."""
    return f"""near{n} AS (SELECT vec_id, label, row, part.p, part.a, part.b, part.c, part.d, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT part.*, e, (part.a - book.a)**2 + (part.b - book.b)**2 + (part.c - book.c)**2 + (part.d - book.d)**2 AS dist FROM part JOIN book{n} book USING (p)) part GROUP BY ALL),
book{n + 1} AS (SELECT old.p, old.e, {", ".join(f"coalesce(new.{x}, old.{x}) AS {x}" for x in "abcd")} FROM book{n} old LEFT JOIN (
  SELECT p, e, {", ".join(f"floor(sum({x}) / count(*))::BIGINT AS {x}" for x in "abcd")} FROM near{n} GROUP BY ALL) new USING (p, e)),"""


VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, embedding AS v, row_number() OVER () AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
part AS (SELECT vec_id, label, row, p, {", ".join(f"floor(256 * v[4 * p + {i}]::DOUBLE)::BIGINT AS {x}" for i, x in enumerate("abcd", 1))} FROM k, range(16) r(p)),
book0 AS (SELECT p, e, a, b, c, d FROM part JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) USING (row)),
{_round(0)}
{_round(1)}
{_round(2)}
coded AS (SELECT vec_id, label, row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near2 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded"""
