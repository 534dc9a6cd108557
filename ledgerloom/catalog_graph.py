"""Queries over account graphs: communities, ranks, triangles, embeddings, samples, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom import catalog_flow as cf
from ledgerloom.catalog_flow import GRAPH, hp
from ledgerloom.functions import tables
from ledgerloom.operators import export, flow, graph, sampling
from ledgerloom.plans.ordered import numbered
from ledgerloom.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def aa(spark, sf_dir):
    return flow.account_edges(hp(spark, sf_dir))


def entities(spark, sf_dir):
    """(party, entity): parties pair up, for sampling tests that need small entities."""
    return fx.owners(spark, sf_dir).select("party", F.expr("party div 2").alias("entity")).distinct()


RGRAPH = GRAPH.replace("WITH ledger", "WITH RECURSIVE ledger")
BOTH_SQL = "both_ AS (SELECT a AS src, b AS dst, weight FROM aa UNION ALL SELECT b, a, weight FROM aa)"
WCC_SQL = RGRAPH + """,
link AS (SELECT a, b FROM aa WHERE weight >= 2 UNION SELECT b, a FROM aa WHERE weight >= 2),
reach AS (SELECT id AS p, id AS q FROM accounts UNION SELECT r.p, l.b FROM reach r JOIN link l ON r.q = l.a),
label AS (SELECT p AS id, min(q) AS com_id FROM reach GROUP BY p),
sized AS (SELECT com_id, count(*) AS com_size FROM label GROUP BY com_id)"""


@query(f"{WCC_SQL} SELECT id, com_id, com_size FROM label JOIN sized USING (com_id)")
def wcc(spark, sf_dir):
    return graph.wcc(fx.accounts(spark, sf_dir), aa(spark, sf_dir))


@query(f"{WCC_SQL} SELECT com_id, com_size FROM sized")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(wcc(spark, sf_dir))


@query(f"""{WCC_SQL} SELECT com_size, count(*) AS n_components, string_agg(CAST(com_id AS VARCHAR), ',' ORDER BY com_id) FILTER (r <= 100) AS first_components
FROM (SELECT *, row_number() OVER (PARTITION BY com_size ORDER BY com_id) AS r FROM sized) GROUP BY com_size""")
def wcc_size_groups(spark, sf_dir):
    return graph.size_groups(wcc(spark, sf_dir))


@query(f"{GRAPH},\n{BOTH_SQL} SELECT id, count(src) AS aa_degree FROM accounts LEFT JOIN both_ ON id = src GROUP BY id")
def aa_degree(spark, sf_dir):
    return graph.aa_degree(fx.accounts(spark, sf_dir), aa(spark, sf_dir))


PR_ROUNDS = 5
SHARE_SQL = f"{BOTH_SQL}, share AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS s FROM both_)"
PR_SQL = f"""{GRAPH},
{SHARE_SQL},
pr0 AS (SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS pr FROM both_)""" + "".join(
    f",\npr{k} AS (SELECT p.id, 0.15 + 0.85 * coalesce(r.recv, 0) AS pr FROM pr{k - 1} p LEFT JOIN (SELECT dst, sum(s * pr) AS recv FROM share JOIN pr{k - 1} ON src = id GROUP BY dst) r ON p.id = r.dst)" for k in range(1, PR_ROUNDS + 1))
MAX_ROUNDS, MAX_CHANGE = 25, 0.001
#: All rounds, each of which repeats the one before it once that one changed next to nothing.
CONVERGED = f"""{SHARE_SQL},
cv0 AS MATERIALIZED (SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS pr FROM both_), st0 AS MATERIALIZED (SELECT false AS done)""" + "".join(
    f""",
cv{k} AS MATERIALIZED (SELECT p.id, p.pr AS old, CASE WHEN (SELECT done FROM st{k - 1}) THEN p.pr ELSE 0.15 + 0.85 * coalesce(r.recv,
    0) END AS pr FROM cv{k - 1} p LEFT JOIN (SELECT dst, sum(s * pr) AS recv FROM share JOIN cv{k - 1} ON src = id GROUP BY dst) r ON p.id = r.dst),
st{k} AS MATERIALIZED (SELECT coalesce(max(abs(pr - old)) <= {MAX_CHANGE}, true) AS done FROM cv{k})""" for k in range(1, MAX_ROUNDS + 1)) + f""",
pr AS (SELECT id, round(pr, 6) AS pagerank FROM cv{MAX_ROUNDS})"""
CONV_SQL = f"{GRAPH},\n{CONVERGED}"


def _ranks(spark, sf_dir):
    return graph.pagerank(aa(spark, sf_dir)).select("id", F.round("pagerank", 6).alias("pagerank"))


@query(f"{PR_SQL} SELECT id, round(pr, 6) AS pagerank FROM pr{PR_ROUNDS}")
def pagerank_fixed(spark, sf_dir):
    return graph.pagerank(aa(spark, sf_dir), max_change=-1, max_iter=PR_ROUNDS).select("id", F.round("pagerank", 6).alias("pagerank"))


@query(f"{CONV_SQL} SELECT id, round(pagerank, 4) AS pagerank FROM pr")
def pagerank_converged(spark, sf_dir):
    return _ranks(spark, sf_dir).select("id", F.round("pagerank", 4).alias("pagerank"))


@query(f"{CONV_SQL} SELECT id, pagerank FROM pr ORDER BY pagerank DESC, id LIMIT 25")
def pagerank_topk(spark, sf_dir):
    return graph.top_k(_ranks(spark, sf_dir), 25)


@query(f"""{CONV_SQL}, top AS (SELECT id FROM pr ORDER BY pagerank DESC, id LIMIT 25)
SELECT a, b, weight FROM aa WHERE a IN (SELECT id FROM top) AND b IN (SELECT id FROM top)""")
def pagerank_top_subgraph(spark, sf_dir):
    return graph.induced(aa(spark, sf_dir), graph.top_k(_ranks(spark, sf_dir), 25))


def _triangle_sql(cap: int) -> str:
    return f"""{GRAPH},
{BOTH_SQL}, deg AS (SELECT src, count(*) AS d FROM both_ GROUP BY src),
act AS (SELECT a, b FROM aa JOIN deg x ON x.src = a JOIN deg y ON y.src = b WHERE x.d <= {cap} AND y.d <= {cap}),
hit AS (SELECT a, b, count(*) AS n FROM act JOIN both_ p ON p.src = a JOIN both_ q ON q.src = b AND q.dst = p.dst GROUP BY a, b),
cr AS (SELECT id, sum(n) AS c FROM (SELECT a AS id, n FROM hit UNION ALL SELECT b, n FROM hit) GROUP BY id)
SELECT a.id, CAST(coalesce(c, 0) // 2 AS BIGINT) AS triangle_count, CASE WHEN d > 1 THEN round(2.0 * (coalesce(c, 0) // 2) / (d * (d - 1)), 6)
    ELSE 0.0 END AS clustering_coef
FROM accounts a LEFT JOIN cr USING (id) LEFT JOIN deg ON deg.src = a.id"""


@query(_triangle_sql(1000))
def triangles(spark, sf_dir):
    return graph.triangles(fx.accounts(spark, sf_dir), aa(spark, sf_dir))


@query(_triangle_sql(20))
def triangles_capped(spark, sf_dir):
    return graph.triangles(fx.accounts(spark, sf_dir), aa(spark, sf_dir), 20)


def _fastrp_sql(dim: int = 16, hops: int = 3, seed: int = 42) -> str:
    mod, mult, inc = graph.LCG_MOD, graph.LCG_MULT, graph.LCG_INC
    q = f"""{RGRAPH},
{BOTH_SQL}, deg AS (SELECT src, count(*) AS d FROM both_ GROUP BY src), tot AS (SELECT sum(d) AS m FROM deg),
vid AS (SELECT src, d, dense_rank() OVER (ORDER BY src) + {inc} AS inc FROM deg),
draw AS (SELECT src, d, inc, -1 AS i, CAST((inc + {mult} * {seed}) % {mod} AS BIGINT) AS r FROM vid UNION ALL SELECT src, d, inc, i + 1,
    CAST((r * {mult} + inc) % {mod} AS BIGINT) FROM draw WHERE i < {dim - 1}),
ini AS (SELECT src, i, pow(d / m, -0.1) * sqrt(3.0) * CASE WHEN r / {mod} <= 1 / 6 THEN 1 WHEN r / {mod} <= 1 / 3 THEN -1 ELSE 0 END AS val
    FROM draw, tot WHERE i >= 0),
h0 AS (SELECT dst AS id, i, sum(val) AS val FROM both_ JOIN ini USING (src) GROUP BY ALL)"""
    for k in range(1, hops + 1):
        q += f""",
m{k} AS (SELECT id, i, sum(val) / greatest(1, d) AS s FROM (SELECT dst AS id, i, val FROM both_ JOIN h{k - 1} h ON src = h.id UNION ALL SELECT id, i,
    val FROM h{k - 1}) JOIN deg ON deg.src = id GROUP BY id, i, d),
h{k} AS (SELECT id, i, CASE WHEN n > 0 THEN s / n ELSE s END AS val FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY id)) AS n FROM m{k}))"""
    every = " UNION ALL ".join(f"SELECT id, i, val FROM h{k}" for k in range(1, hops + 1))
    return f"{q} SELECT id, CAST(i AS INT) AS i, round(sum(val) / {hops}, 4) + 0.0 AS value FROM ({every}) GROUP BY id, i"


@query(_fastrp_sql())
def fastrp(spark, sf_dir):
    regions, weights = graph.regions_of([], (0, 16, 1.0)), graph.weights_of("1.0,1.0,1.0")
    return graph.fastrp(aa(spark, sf_dir), 16, weights, regions=regions).select("id", F.col("i").cast("int").alias("i"), (F.round("value", 4) + F.lit(0.0)).alias("value"))


_SCOPE_SQL = """scope AS (SELECT id FROM label WHERE com_id = (SELECT com_id FROM sized ORDER BY com_size DESC, com_id LIMIT 1)),
aa_in AS (SELECT * FROM aa WHERE a IN (SELECT id FROM scope) AND b IN (SELECT id FROM scope))"""


@query(_fastrp_sql(8, 2).replace(RGRAPH, f"{WCC_SQL},\n{_SCOPE_SQL}", 1).replace(BOTH_SQL, BOTH_SQL.replace("FROM aa", "FROM aa_in"), 1))
def fastrp_scoped(spark, sf_dir):
    """Embeddings of the largest component alone."""
    labels = wcc(spark, sf_dir)
    largest = labels.orderBy(F.desc("com_size"), "com_id").limit(1).select("com_id")
    members = labels.join(F.broadcast(largest), "com_id", "left_semi").select("id")
    d = graph.fastrp(aa(spark, sf_dir), 8, (1.0, 1.0), members=members)
    return d.select("id", F.col("i").cast("int").alias("i"), (F.round("value", 4) + F.lit(0.0)).alias("value"))


#: Every account is a seed of one batch: the batches of an epoch cover all of them, with drawn positives beside.
BATCH_SQL = """pos AS (SELECT id, row_number() OVER (ORDER BY md5('5|0|' || id), id) - 1 AS r FROM mules WHERE is_mule = 1),
un AS (SELECT id, row_number() OVER (ORDER BY md5('5|0|' || id), id) - 1 AS r FROM mules WHERE is_mule = 0),
un2 AS (SELECT r // 14 AS batch, id, CAST(r % 14 + 2 AS INT) AS slot FROM un),
want AS (SELECT batch, CAST(s AS INT) AS slot, CAST('0x' || substr(md5('5|0|' || batch || '|' || s), 1, 8) AS BIGINT) % (SELECT count(*)
    FROM pos) AS r FROM (SELECT DISTINCT batch FROM un2), range(2) t(s)),
epoch AS (SELECT batch, id, slot FROM un2 UNION ALL SELECT batch, id, slot FROM want JOIN pos USING (r)),
seeds AS (SELECT batch AS batch_id, id, min(slot) AS slot FROM epoch GROUP BY ALL)"""


@query(f"{GRAPH}, {BATCH_SQL} SELECT * FROM epoch")
def epoch_batches(spark, sf_dir):
    return sampling.epoch_batches(fx.mules(spark, sf_dir).withColumnRenamed("is_mule", "pu_label"))


def seeds(spark, sf_dir):
    return epoch_batches(spark, sf_dir).withColumnRenamed("batch", "batch_id")


REL_SQL = """rel AS (SELECT 'HAS_PAID' AS k, src AS f, dst AS t FROM hp UNION SELECT 'Account_Account', a, b FROM aa UNION SELECT 'Account_Account', b, a FROM aa
  UNION SELECT 'Account_Party', account, party FROM owners UNION SELECT 'Party_Account', party, account FROM owners
  UNION SELECT 'Party_Entity', party, party // 2 FROM owners UNION SELECT 'Entity_Party', party // 2, party FROM owners),
  ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY md5('7|' || k || '|' || f || '|' || t), t) AS r FROM rel)"""


def _khop_sql(gate: str = "", head: str = GRAPH) -> str:
    """``gate``: a query of the accounts that no step may reach."""
    q, frontier = f"{head},\n{BATCH_SQL},\n{REL_SQL}", "SELECT batch_id, id FROM seeds"
    parts = []
    for r in range(2):
        def step(name, src, k):
            g = f" AND t NOT IN ({gate})" if gate and sampling.TYPES[k][1] == "Account" else ""
            parts.append(name)
            return f",\n{name} AS MATERIALIZED (SELECT DISTINCT batch_id, f AS from_id, t AS to_id, k AS e_type FROM ranked JOIN ({src}) x ON f = x.id WHERE k = '{k}' AND r <= {sampling.FANOUTS[k][r]}{g})"
        to = lambda p: f"SELECT DISTINCT batch_id, to_id AS id FROM {p}"
        q += step(f"pa{r}", frontier, "HAS_PAID") + step(f"si{r}", frontier, "Account_Account") + step(f"ap{r}", frontier, "Account_Party")
        q += step(f"pe{r}", to(f"ap{r}"), "Party_Entity") + step(f"ep{r}", to(f"pe{r}"), "Entity_Party") + step(f"pc{r}", to(f"ep{r}"), "Party_Account")
        frontier = f"{to(f'pa{r}')} UNION {to(f'si{r}')} UNION {to(f'pc{r}')}"
    return q + ",\nsampled AS MATERIALIZED (" + " UNION ".join(f"SELECT * FROM {p}" for p in parts) + ")"


def _relations(spark, sf_dir):
    flows = hp(spark, sf_dir)
    return sampling.relations(flows, flow.account_edges(flows), fx.owners(spark, sf_dir), entities(spark, sf_dir))


def _khop(spark, sf_dir, gated=None):
    return sampling.khop(seeds(spark, sf_dir), _relations(spark, sf_dir), gated=gated)


@query(f"{_khop_sql()} SELECT * FROM sampled")
def khop_edges(spark, sf_dir):
    return _khop(spark, sf_dir)


_KIND = lambda i: "CASE e_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in sampling.TYPES.items()) + " END"
NODES_SQL = f"""{_khop_sql()},
nodes AS MATERIALIZED (SELECT batch_id, {_KIND(0)} AS node_type, from_id AS id FROM sampled UNION SELECT batch_id, {_KIND(1)}, to_id FROM sampled UNION SELECT batch_id, 'Account', id FROM seeds)"""
INDEX_SQL = NODES_SQL + """,
idx AS MATERIALIZED (SELECT n.batch_id, n.node_type, n.id, row_number() OVER (PARTITION BY n.batch_id, n.node_type ORDER BY
    CASE WHEN slot IS NULL THEN 1 ELSE 0 END, slot, n.id) - 1 AS local_id
  FROM nodes n LEFT JOIN seeds s ON n.node_type = 'Account' AND s.id = n.id AND s.batch_id = n.batch_id)"""


@query(f"{NODES_SQL} SELECT * FROM nodes")
def khop_nodes(spark, sf_dir):
    return sampling.khop_nodes(seeds(spark, sf_dir), _khop(spark, sf_dir))


@query(f"{INDEX_SQL} SELECT * FROM idx")
def local_index(spark, sf_dir):
    return sampling.local_index(khop_nodes(spark, sf_dir), seeds(spark, sf_dir))


@query(f"{GRAPH} SELECT 'Account' AS node_type, id, row_number() OVER (ORDER BY id) - 1 AS local_id FROM accounts")
def whole_index(spark, sf_dir):
    """Local ids of one batch of all accounts."""
    every = fx.accounts(spark, sf_dir)
    return sampling.local_index(every.select(F.lit("Account").alias("node_type"), "id"), every)


@query(f"""{INDEX_SQL} SELECT sampled.batch_id, e_type, x.local_id AS row, y.local_id AS col FROM sampled JOIN idx x ON x.batch_id = sampled.batch_id AND x.node_type = {_KIND(0)} AND x.id = from_id
JOIN idx y ON y.batch_id = sampled.batch_id AND y.node_type = {_KIND(1)} AND y.id = to_id""")
def local_edges(spark, sf_dir):
    e = _khop(spark, sf_dir)
    return sampling.local_edges(e, sampling.local_index(sampling.khop_nodes(seeds(spark, sf_dir), e), seeds(spark, sf_dir)))


@query(f"{GRAPH},\n{BATCH_SQL} SELECT x.batch_id, src, dst, total_amount, txn_count FROM hp JOIN seeds x ON x.id = src JOIN seeds y ON y.id = dst AND x.batch_id = y.batch_id")
def inbatch_edges(spark, sf_dir):
    return sampling.inbatch_edges(hp(spark, sf_dir), seeds(spark, sf_dir)).select("batch_id", "src", "dst", "total_amount", "txn_count")


@query(f"""{GRAPH} SELECT id, is_mule AS pu_label FROM mules WHERE is_mule = 1
UNION ALL (SELECT id, is_mule FROM mules WHERE is_mule = 0 ORDER BY md5('5|val|' || id), id LIMIT 10000)""")
def validation_sample(spark, sf_dir):
    return sampling.validation_sample(fx.mules(spark, sf_dir).withColumnRenamed("is_mule", "pu_label"))


def start_of(vertices, key="id"):
    """The key a tenth down the order, behind which the sample pages begin; none in an empty table."""
    n = vertices.count()
    row = numbered(vertices.select(key), [F.col(key)], "place").where(F.col("place") == n // 10).first()
    return row and row[0]


def _start_sql(vertices: str) -> str:
    return f"(SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM ({vertices})) WHERE r = n // 10)"


_VERTEX_SQL = {
    "Account": "SELECT id FROM accounts", "Party": "SELECT DISTINCT party AS id FROM owners", "Entity": "SELECT DISTINCT party // 2 AS id FROM owners"}


@query(f"""{GRAPH},
{cf.MONEY_SQL}, page AS (SELECT id, in_degree, out_degree FROM money_flow WHERE id > {_start_sql(_VERTEX_SQL['Account'])} ORDER BY id LIMIT 50)
SELECT page.*, (SELECT max(id) FROM page) AS next_cursor FROM page""")
def vertex_page(spark, sf_dir):
    accounts = cf.money_flow(spark, sf_dir).select("id", "in_degree", "out_degree")
    return export.vertex_page(accounts, start_of(fx.accounts(spark, sf_dir)), 50)


@query(f"""{GRAPH}, paged AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS page FROM accounts),
ends AS (SELECT page, max(id) AS next_cursor, count(*) AS n FROM paged GROUP BY page)
SELECT page, lag(next_cursor) OVER (ORDER BY page) AS cursor, next_cursor, n FROM ends""")
def vertex_pages(spark, sf_dir):
    """The cursors of all pages of accounts."""
    return export.page_index(fx.accounts(spark, sf_dir), 20)


def _ends(spark, sf_dir):
    party = fx.owners(spark, sf_dir).select(F.col("party").alias("id")).distinct()
    entity = entities(spark, sf_dir).select(F.col("entity").alias("id")).distinct()
    return {"Account": fx.accounts(spark, sf_dir), "Party": party, "Entity": entity}


def _page_sql(kind: str) -> str:
    every = _VERTEX_SQL[sampling.TYPES[kind][0]]
    return f"""{GRAPH},
{REL_SQL}, page AS (SELECT id FROM ({every}) WHERE id > {_start_sql(every)} ORDER BY id LIMIT 20),
last AS (SELECT max(id) AS next_cursor FROM page)
SELECT f AS from_id, t AS to_id, next_cursor FROM last
LEFT JOIN (SELECT f, t FROM rel WHERE k = '{kind}' AND f IN (SELECT id FROM page)) ON true WHERE next_cursor IS NOT NULL"""


def _page_of(kind: str):
    def page(spark, sf_dir):
        vertices = _ends(spark, sf_dir)[sampling.TYPES[kind][0]]
        return export.edge_page(_relations(spark, sf_dir)[kind], start_of(vertices), 20, vertices)

    page.__name__ = f"edge_page_{kind.lower()}"
    page.__doc__ = f"A page of {kind} edges: 20 vertices of the source's type from a tenth of their order on."
    return page


for _kind in sampling.TYPES:
    query(_page_sql(_kind))(_page_of(_kind))


@query(f"""{GRAPH},
{REL_SQL}, kinds(k, type) AS (VALUES {', '.join(f"('{k}', '{v[0]}')" for k, v in sampling.TYPES.items())}),
every AS ({' UNION ALL '.join(f"SELECT '{k}' AS type, id FROM ({v})" for k, v in _VERTEX_SQL.items())}),
paged AS (SELECT type, id, (row_number() OVER (PARTITION BY type ORDER BY id) - 1) // 20 AS page FROM every),
ends AS (SELECT type, page, max(id) AS next_cursor FROM paged GROUP BY type, page),
hit AS (SELECT rel.k, type, page, f, t FROM rel JOIN kinds USING (k) JOIN paged USING (type) WHERE f = id)
SELECT kinds.k AS e_type, ends.page, next_cursor, f AS from_id, t AS to_id FROM ends JOIN kinds USING (type)
LEFT JOIN hit ON hit.k = kinds.k AND hit.page = ends.page""")
def edge_pages(spark, sf_dir):
    """All pages of all six relations: every vertex of a source's type is on one page, edges or not."""
    ends, found = _ends(spark, sf_dir), []
    for kind, edges in _relations(spark, sf_dir).items():
        paged = export.edge_pages(edges, ends[sampling.TYPES[kind][0]], 20)
        found.append(paged.select(F.lit(kind).alias("e_type"), "page", "next_cursor", "from_id", "to_id"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query(f"""{GRAPH}, page AS (SELECT DISTINCT src FROM hp WHERE src > {_start_sql('SELECT DISTINCT src AS id FROM hp')} ORDER BY src LIMIT 20)
SELECT src AS from_id, dst AS to_id, (SELECT max(src) FROM page) AS next_cursor FROM hp WHERE src IN (SELECT src FROM page)""")
def edge_page(spark, sf_dir):
    e = hp(spark, sf_dir).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    return export.edge_page(e, start_of(e.select("from_id").distinct(), "from_id"), 20)


@query(f"""{GRAPH}, page AS (SELECT id FROM accounts WHERE id > {_start_sql(_VERTEX_SQL['Account'])} ORDER BY id LIMIT 20)
SELECT src, count(*) AS n_edges, string_agg(dst || ':' || printf('%.2f', total_amount) || ':' || txn_count, ';' ORDER BY dst) AS edges,
  (SELECT max(id) FROM page) AS next_cursor FROM hp
WHERE src IN (SELECT id FROM page) GROUP BY src""")
def has_paid_page(spark, sf_dir):
    accounts = fx.accounts(spark, sf_dir)
    d = export.has_paid_page(hp(spark, sf_dir), start_of(accounts), 20, accounts)

    def line(e):
        return F.concat_ws(":", e["dst"].cast("string"), F.format_string("%.2f", e["total_amount"]), e["txn_count"].cast("string"))

    lines = F.array_join(F.transform("edges", line), ";")
    return d.select("src", F.size("edges").cast("long").alias("n_edges"), lines.alias("edges"), "next_cursor")


@query(f"""{GRAPH} SELECT (SELECT count(*) FROM accounts) AS n_accounts, (SELECT count(*) FROM hp) AS n_edges, (SELECT count(DISTINCT src) FROM hp) AS n_sources""")
def export_counts(spark, sf_dir):
    e = hp(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_sources"))
    return fx.accounts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_accounts")).join(F.broadcast(e))


@query(f"""{GRAPH}, rare AS (SELECT DISTINCT account, kind, value FROM owners JOIN identities USING (party)),
deg AS (SELECT kind, value, count(*) AS d FROM rare GROUP BY ALL HAVING count(*) > 1 AND count(*) < 40),
cand AS (SELECT DISTINCT x.account AS a, y.account AS b FROM rare x JOIN rare y ON x.kind = y.kind AND x.value = y.value
    AND x.account < y.account JOIN deg ON deg.kind = x.kind AND deg.value = x.value),
heavy AS (SELECT a, b, weight FROM aa WHERE weight >= 2)
SELECT 'account_edges' AS fn, a, b, weight AS n FROM heavy
UNION ALL SELECT 'account_degrees', id, count(*), 0 FROM (SELECT a AS id FROM heavy UNION ALL SELECT b FROM heavy) GROUP BY id
UNION ALL SELECT 'vertices_between', id, 0, 0 FROM accounts WHERE id > 5 AND id <= 90
UNION ALL SELECT 'split_members', id, 0, 0 FROM mules WHERE is_mule = 1
UNION ALL SELECT 'party_candidates', a, b, 0 FROM cand""")
def table_functions(spark, sf_dir):
    """Operators called by name from SQL, with parameters other than their defaults."""
    held = fx.owners(spark, sf_dir).join(fx.identities(spark, sf_dir), "party").select(F.col("account").alias("party"), "kind", "value")
    tables.register(spark, flows=hp(spark, sf_dir), accounts=fx.accounts(spark, sf_dir), pii=held,
                    splits=fx.mules(spark, sf_dir).select("id", F.col("is_mule").alias("split")))
    return spark.sql("""
        SELECT 'account_edges' AS fn, a, b, weight AS n FROM account_edges(min_weight => 2)
        UNION ALL SELECT 'account_degrees', id, degree, 0 FROM account_degrees(2)
        UNION ALL SELECT 'vertices_between', id, 0, 0 FROM vertices_between(5, last => 90)
        UNION ALL SELECT 'split_members', id, 0, 0 FROM split_members('val')
        UNION ALL SELECT 'party_candidates', a, b, 0 FROM party_candidates(candidate_degree => 40)""")
