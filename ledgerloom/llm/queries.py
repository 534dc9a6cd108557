"""One query for each text operator, over whole tables, with production parameters."""

from __future__ import annotations

from ledgerloom.llm import (collocations, decontaminate, line_dedup, manifest, mixing, ngram_join, oracles, packing, quality, secrets,
                            suffix_dedup, token_count, toxicity, vector_dedup)
from ledgerloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_decontamination"] = r"""
WITH doc AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + 12] AS v, least(len(w), 13) AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM item WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM doc),
cand AS (SELECT p.doc_id, p.s, ks.k, p.w[p.s:p.s + ks.k - 1] AS v FROM place p JOIN ks ON p.s + ks.k - 1 <= len(p.w)),
hit AS (SELECT c.doc_id, c.s, c.k, win.item_id FROM cand c JOIN win ON c.k = win.k AND c.v = win.v),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query
def op2_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    kinds = ", ".join(f"({i}, '{k[0]}', '{k[1].replace(chr(39), chr(39) * 2)}', '{k[2]}', '{k[3]}')" for i, k in enumerate(secrets.KINDS))
    near = lambda role: f"""(coalesce(s - max(CASE WHEN role = '{role}' THEN e END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {secrets.REACH}, false)
      OR coalesce(min(CASE WHEN role = '{role}' THEN s END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - e <= {secrets.REACH}, false))"""  # noqa: E731
    return rf"""
WITH kind(rank, name, pattern, role, strength) AS (VALUES {kinds}),
doc AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, t, kind.*, regexp_extract_all(t, pattern) AS h, string_split_regex(t, pattern) AS g FROM doc, kind),
part AS (SELECT * EXCLUDE (h, g), h[i] AS hit, length(g[i]) AS gap FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM raw)),
placed AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, t, rank ORDER BY i) AS e FROM part),
kept AS (
  SELECT doc_id, t, rank, name, role, strength, e - length(hit) AS s, e FROM placed
  WHERE (name <> 'assign' OR length(regexp_replace(hit, '{secrets.BEFORE_VALUE.replace("'", "''")}', '')) >= 6)
    AND (name <> 'weak_secret' OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')))),
scoped AS (
  SELECT *, {near('identifier')} AS by_identifier, {near('secret')} AS by_secret FROM kept
  WINDOW w AS (PARTITION BY doc_id, t ORDER BY s, rank, e)),
told AS (
  SELECT *, name || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS line FROM scoped
  WHERE strength = 'base' OR (role = 'identifier' AND by_secret) OR (role = 'secret' AND by_identifier) OR (role = 'endpoint' AND by_secret AND by_identifier)),
per AS (
  SELECT doc_id, t, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
    string_agg(line, ',' ORDER BY s, rank, e) FILTER (strength = 'base') AS base, string_agg(line, ',' ORDER BY s, rank, e) AS spans FROM told GROUP BY doc_id, t)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc d LEFT JOIN per ON d.doc_id IS NOT DISTINCT FROM per.doc_id AND d.t = per.t
"""


ORACLES["op2_secret_scan"] = _secrets_sql()


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


ORACLES["op3_line_dedup"] = f"""
WITH line AS (
  SELECT doc_id, no, s, row_number() OVER (ORDER BY doc_id, no) AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS no FROM documents WHERE text IS NOT NULL)),
one AS (SELECT s, min(pos) AS pos, length(s) AS n FROM line WHERE trim(s) <> '' GROUP BY s),
long AS (SELECT * FROM one WHERE n >= {line_dedup.MIN_CHARS}),
cut AS (SELECT s, pos, n, i, hash(left(s, i - 1) || substr(s, i + 1)) AS v FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM long)),
swap AS (SELECT n, i, v, min(pos) AS m FROM cut GROUP BY ALL HAVING count(*) > 1),
twin AS (
  SELECT s, min(m) AS m FROM (
    SELECT cut.s, swap.m FROM cut JOIN swap USING (n, i, v)
    UNION ALL SELECT cut.s, long.pos FROM cut JOIN long ON cut.v = hash(long.s) AND cut.n = long.n + 1
    UNION ALL SELECT long.s, cut.pos FROM cut JOIN long ON cut.v = hash(long.s) AND cut.n = long.n + 1) GROUP BY s),
judged AS (
  SELECT line.*, trim(line.s) <> '' AND line.pos > least(one.pos, coalesce(twin.m, one.pos)) AS gone
  FROM line LEFT JOIN one USING (s) LEFT JOIN twin USING (s)),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed, string_agg(s, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)) AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""


@query
def op9_vector_dedup(spark, sf_dir):
    return vector_dedup.link(table(spark, sf_dir, "embeddings"))


ORACLES["op9_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
unit AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v LEFT JOIN deg ON deg.a = v.vec_id JOIN comp ON comp.a = v.vec_id
"""


@query
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query
def op4_ngram_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    levels = ["domain", "lang", "source"]
    ctes, keys, up = [], ["one"], "root"
    for i in range(3):
        here = ["one", *levels[:i + 1]]
        cases = "".join(f" WHEN lang = '{k[2:]}' THEN {v}" if k.startswith("*/") and i == 1 else f" WHEN concat_ws('/', {', '.join(levels[:i + 1])}) = '{k}' THEN {v}" if not k.startswith("*/") else "" for k, v in mixing.WEIGHTS.items())
        k, h = ", ".join(keys), ", ".join(here)
        ctes.append(f"""
n{i} AS (SELECT {h}, CAST(sum(t) * {mixing.MAX_EPOCHS} AS DOUBLE) AS c, CAST(CASE{cases} ELSE 1 END AS DOUBLE) AS w FROM leaf GROUP BY {h}),
o{i} AS (SELECT *, c / w AS r FROM n{i} JOIN {up} USING ({k})),
l{i} AS (SELECT *, (b - coalesce(sum(c) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (PARTITION BY {k}) - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lam
  FROM o{i} WINDOW f AS (PARTITION BY {k} ORDER BY r, {levels[i]})),
u{i} AS (SELECT {h}, CASE WHEN r <= lam THEN c ELSE w * max(CASE WHEN r > lam THEN lam END) OVER (PARTITION BY {k}) END AS b FROM l{i}),""")
        keys, up = here, f"u{i}"
    return f"""
WITH doc AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, 'unknown')), 1, 1) < '8' THEN 'web' WHEN substr(md5(coalesce(source, 'unknown')), 1, 1) < 'c' THEN 'forum' ELSE 'curated' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS t FROM documents),
leaf AS (SELECT 1 AS one, domain, lang, source, sum(t) AS t FROM doc GROUP BY ALL),
root AS (SELECT 1 AS one, CAST(floor(sum(t) * CAST({mixing.FRACTION} AS DOUBLE)) AS DOUBLE) AS b FROM leaf),
{''.join(ctes)}
due AS (SELECT domain, lang, source, t AS whole, CAST(floor(round(b, 6)) AS BIGINT) AS due FROM u2 JOIN leaf USING (one, domain, lang, source)),
full_ AS (SELECT *, CASE WHEN whole > 0 THEN least(due // whole, {mixing.MAX_EPOCHS}) ELSE 0 END AS n FROM due),
keyed AS (SELECT doc.*, n, CASE WHEN n < {mixing.MAX_EPOCHS} THEN due - n * whole ELSE 0 END AS rest, md5('{mixing.SEED}|' || CAST(n AS BIGINT) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM doc JOIN full_ USING (domain, lang, source)),
told AS (SELECT *, n + CASE WHEN coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS copies FROM keyed)
SELECT doc_id, domain, lang, source, CAST(t AS BIGINT) AS n_tokens, CAST(copies AS BIGINT) AS n_copies FROM told WHERE copies > 0
"""


ORACLES["op6_mixing"] = _mixing_sql()


ORACLES["op4_ngram_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM doc)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS p, doc_id AS q FROM documents UNION SELECT r.p, s.b FROM reach r JOIN sym s ON r.q = s.a),
low AS (SELECT p, min(q) AS c FROM reach GROUP BY p)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN size USING (doc_id) JOIN low ON low.p = d.doc_id
"""

ORACLES["op8_suffix_dedup"] = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM doc WHERE n >= 50)),
first AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
hit AS (SELECT doc_id, i FROM win JOIN first USING (w) WHERE doc_id > m),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
span AS (SELECT doc_id, g, min(i) AS s, max(i) + 50 AS e FROM run GROUP BY doc_id, g),
gap AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM span),
per AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM doc d LEFT JOIN per USING (doc_id)
"""


@query
def op11_merkle_manifest(spark, sf_dir):
    return manifest.report(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = oracles.merkle_sql()


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = oracles.COLLOCATIONS


@query
def op13_packing(spark, sf_dir):
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
