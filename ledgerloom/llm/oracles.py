"""DuckDB SQL of the manifest and of collocations, put together level by level."""

from __future__ import annotations


def _levels(name: str, start: str, key: str, levels: int) -> str:
    """CTEs {name}0.. of nodes (key, pos, h, c = nodes of the tree) with their siblings to the left and right."""
    out = []
    for k in range(levels):
        source = start if k == 0 else f"""(
          SELECT {key}, p AS pos, CASE WHEN c = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
          FROM (SELECT *, pos // 8 AS p FROM {name}{k - 1}) GROUP BY {key}, p, c)"""
        run = f"OVER (PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k} AS (
          SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS c,
            coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM {source})""")
    return ",\n".join(out)


def _walk(name: str, source: str, key: str, levels: int) -> str:
    """CTE chain {name}_f0.. over rows with (key, pos, folded, siblings): a level's siblings are met by place."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_f{k} AS (
          SELECT d.* EXCLUDE (folded, siblings), CASE WHEN n.c = 1 THEN folded ELSE sha256(n.l || folded || n.r) END AS folded,
            siblings || n.l || n.r AS siblings
          FROM {source if k == 0 else f'{name}_f{k - 1}'} d JOIN {name}{k} n ON n.{key} = d.{key} AND n.pos = d.pos // {8 ** k})""")
    return ",\n".join(out)


def merkle_sql(levels: int = 7) -> str:
    """For up to 8 ** (levels - 1) rows of a language and as many languages."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS leaf,
    CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_levels('own', '(SELECT t, pos, leaf AS h FROM placed)', 't', levels)},
subroots AS (SELECT 1 AS one, t, h, row_number() OVER (ORDER BY t) - 1 AS pos FROM own{levels - 1}),
{_levels('top', '(SELECT one, pos, h FROM subroots)', 'one', levels)},
start AS (SELECT doc_id, t, pos, leaf, claimed AS folded, '' AS siblings FROM placed),
{_walk('own', 'start', 't', levels)},
between AS (
  SELECT f.doc_id, f.leaf, f.folded, f.siblings, s.one, s.h AS subroot, s.pos FROM own_f{levels - 1} f JOIN subroots s ON s.t = f.t),
{_walk('top', 'between', 'one', levels)}
SELECT doc_id, leaf, subroot, n.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = n.h AS verified
FROM top_f{levels - 1} f JOIN top{levels - 1} n ON n.one = f.one
"""


COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT g.lang, g.m, phrase, a, unnest(generate_series(1, g.m - 1)) AS k, string_split(phrase, ' ') AS ws FROM g WHERE g.m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM g q WHERE q.lang = b.lang AND q.m > b.m AND 100 * q.a >= 80 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
