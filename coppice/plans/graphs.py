"""Structure graphs from line items, dependency problems from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import strip_markers
from ..operators import problems as P
from ..operators import reading
from ..operators import structure as S
from .common import bound, plain, query, table

CATEGORIES = ["Item", "Shelf", "Aisle", "Store"]
LINES = """SELECT l_partkey AS problem_id, CAST(l_linenumber - 1 AS INT) AS n0, CAST(CAST(l_quantity AS INT) % 3 AS INT) AS n1,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS n2, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS n3 FROM {lineitem}"""
NODES = f"""SELECT DISTINCT problem_id, li, ni, c || ' ' || ni AS name FROM (
  SELECT problem_id, 0 AS li, n0 AS ni, 'Item' AS c FROM ({LINES}) UNION ALL SELECT problem_id, 1, n1, 'Shelf' FROM ({LINES})
  UNION ALL SELECT problem_id, 2, n2, 'Aisle' FROM ({LINES}) UNION ALL SELECT problem_id, 3, n3, 'Store' FROM ({LINES}))"""
EDGES = f"""SELECT problem_id, li, ni, lj, nj, CAST(count(*) % 5 + 1 AS BIGINT) AS quantity FROM (
  SELECT problem_id, 0 AS li, n0 AS ni, 1 AS lj, n1 AS nj FROM ({LINES}) UNION ALL SELECT problem_id, 1, n1, 2, n2 FROM ({LINES})
  UNION ALL SELECT problem_id, 2, n2, 3, n3 FROM ({LINES})) GROUP BY problem_id, li, ni, lj, nj"""
GRAPH = f"WITH nodes AS ({plain(NODES)}), edges AS ({plain(EDGES)})"
IID = "'i:' || {li} || '.' || {ni} || '-' || {lj} || '.' || {nj}"
AID = "'a:' || {li} || '-' || {lj} || '.' || {nj}"
PARAMS = GRAPH + f""", ip AS (SELECT e.problem_id, {IID.format(li='e.li', ni='e.ni', lj='e.lj', nj='e.nj')} AS param_id, 'each ' || u.name || '''s ' || l.name AS name, e.*
  EXCLUDE (problem_id) FROM edges e JOIN nodes l ON l.problem_id = e.problem_id AND l.li = e.li AND l.ni = e.ni
  JOIN nodes u ON u.problem_id = e.problem_id AND u.li = e.lj AND u.ni = e.nj),
ap AS (SELECT problem_id, {AID.format(li='k', lj='li', nj='ni')} AS param_id, k AS li, li AS lj, ni AS nj,
  'each ' || name || '''s ' || ['Item', 'Shelf', 'Aisle', 'Store'][k + 1] AS name FROM nodes, range(3) x(k) WHERE k < li),
rk AS (SELECT *, row_number() OVER (PARTITION BY problem_id, lj, nj ORDER BY ni) - 1 AS r FROM edges),
pp AS (SELECT a.problem_id, a.param_id AS child, r * CASE WHEN a.lj - a.li > 1 THEN 2 ELSE 1 END AS pos,
   {IID.format(li='r.li', ni='r.ni', lj='r.lj', nj='r.nj')} AS parent, 'instance' AS parent_kind FROM ap a JOIN rk r ON r.problem_id = a.problem_id AND r.lj = a.lj AND r.nj = a.nj
  UNION ALL SELECT a.problem_id, a.param_id, r * 2 + 1, {AID.format(li='a.li', lj='r.li', nj='r.ni')}, 'abstract'
   FROM ap a JOIN rk r ON r.problem_id = a.problem_id AND r.lj = a.lj AND r.nj = a.nj WHERE a.lj - a.li > 1)"""


def graph_lines(spark, sf_dir):
    """The distinct lines of every part with their count ``n``, those of a part in one partition.

    Lines are narrow, what they unfold to is not: they are counted where their own values lead them, so a part with many
    lines is spread, and the few that are left are brought together once for all nodes and edges.
    """
    lines = bound(spark, sf_dir, LINES)
    counted = lines.repartition(*lines.columns).groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.repartition("problem_id")


def graph_nodes(spark, sf_dir):
    """The nodes of every part's graph from one scan."""
    layers = F.array(*[F.struct(F.lit(i).alias("li"), F.col(f"n{i}").alias("ni")) for i in range(len(CATEGORIES))])
    nodes = graph_lines(spark, sf_dir).select("problem_id", F.explode(layers).alias("x")).select("problem_id", "x.li", "x.ni").distinct()
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("li") + 1)
    return nodes.select("problem_id", "li", "ni", F.concat_ws(" ", category, "ni").alias("name"))


def graph_edges(spark, sf_dir):
    """The edges between neighbouring layers, with their quantity, from one scan."""
    steps = F.array(*[F.struct(F.lit(i).alias("li"), F.col(f"n{i}").alias("ni"), F.lit(i + 1).alias("lj"), F.col(f"n{i + 1}").alias("nj")) for i in range(3)])
    edges = graph_lines(spark, sf_dir).select("problem_id", "n", F.explode(steps).alias("x")).groupBy("problem_id", "x.li", "x.ni", "x.lj", "x.nj")
    return edges.agg((F.sum("n") % 5 + 1).alias("quantity"))


def graph(spark, sf_dir):
    return graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir)


def parents(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return S.param_parents(S.abstract_params(nodes, CATEGORIES), edges)


@query("instance_params", PARAMS + " SELECT problem_id, param_id, name FROM ip")
def instance_params(spark, sf_dir):
    return S.instance_params(*graph(spark, sf_dir)).select("problem_id", "param_id", "name")


@query("abstract_params", PARAMS + " SELECT problem_id, param_id, name FROM ap")
def abstract_params(spark, sf_dir):
    return S.abstract_params(graph_nodes(spark, sf_dir), CATEGORIES).select("problem_id", "param_id", "name")


@query("difficulty_level", PARAMS + " SELECT problem_id, param_id, CAST(lj - li AS INT) AS d_level FROM ap UNION ALL SELECT problem_id, param_id, -1 FROM ip")
def difficulty_level(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    params = S.instance_params(nodes, edges).unionByName(S.abstract_params(nodes, CATEGORIES))
    return params.select("problem_id", "param_id", S.difficulty_level(F.col("kind"), F.col("li"), F.col("lj")).cast("int").alias("d_level"))


@query("param_parent_join", PARAMS + " SELECT * FROM pp")
def param_parent_join(spark, sf_dir):
    return parents(spark, sf_dir)


@query("abstract_equation", PARAMS + """ SELECT problem_id, child AS param_id, CASE WHEN max(parent_kind) FILTER (parent_kind = 'abstract') IS NULL
 THEN string_agg(chr(123) || pos || chr(125), ' + ' ORDER BY pos)
 ELSE string_agg(chr(123) || pos || chr(125) || ' * ' || chr(123) || (pos + 1) || chr(125), ' + ' ORDER BY pos) FILTER (pos % 2 = 0) END AS equation FROM pp GROUP BY ALL""")
def abstract_equation(spark, sf_dir):
    return S.abstract_equations(parents(spark, sf_dir))


@query("hierarchy_rollup", GRAPH + """, l1 AS (SELECT problem_id, li, lj, nj, sum(quantity) AS v FROM edges GROUP BY ALL),
l2 AS (SELECT e.problem_id, b.li, e.lj, e.nj, sum(e.quantity * b.v) AS v FROM edges e JOIN l1 b ON b.problem_id = e.problem_id AND b.lj = e.li AND b.nj = e.ni GROUP BY ALL),
l3 AS (SELECT e.problem_id, b.li, e.lj, e.nj, sum(e.quantity * b.v) AS v FROM edges e JOIN l2 b ON b.problem_id = e.problem_id AND b.lj = e.li AND b.nj = e.ni GROUP BY ALL)
SELECT problem_id, li, lj, nj, CAST(v AS BIGINT) AS total FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""")
def hierarchy_rollup(spark, sf_dir):
    return S.hierarchy_rollup(graph_edges(spark, sf_dir), "quantity").select("problem_id", "li", "lj", "nj", "total")


USED = "SELECT problem_id, param_id FROM ip WHERE quantity >= 3"


def used_params(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    kept = edges.where("quantity >= 3")
    return S.instance_params(nodes, kept).select("problem_id", "param_id")


@query("unused_params", PARAMS + f" SELECT problem_id, param_id FROM ip EXCEPT {USED}")
def unused_params(spark, sf_dir):
    params = S.instance_params(*graph(spark, sf_dir)).select("problem_id", "param_id")
    return S.unused_params(params, used_params(spark, sf_dir))


@query("candidate_nodes", PARAMS + f" SELECT problem_id, param_id FROM ip WHERE lj = 1 AND quantity >= 3")
def candidate_nodes(spark, sf_dir):
    low = S.instance_params(*graph(spark, sf_dir)).where("lj = 1").select("problem_id", "param_id")
    return S.candidate_nodes(low, used_params(spark, sf_dir), ["problem_id", "param_id"])


@query("computable_params", PARAMS + f" SELECT problem_id, child AS param_id FROM pp GROUP BY ALL HAVING count(*) FILTER ((problem_id, parent) NOT IN ({USED})) = 0")
def computable_params(spark, sf_dir):
    return S.computable_params(parents(spark, sf_dir), used_params(spark, sf_dir))


CLOSURE = PARAMS.replace("WITH", "WITH RECURSIVE", 1) + """, cl AS (SELECT problem_id, param_id AS root, param_id AS node FROM ap WHERE lj - li = 3
 UNION SELECT cl.problem_id, root, parent FROM cl JOIN pp ON pp.problem_id = cl.problem_id AND pp.child = cl.node)"""


@query("ancestor_closure", CLOSURE + """, n AS (SELECT problem_id, child AS node, count(*) AS d FROM pp GROUP BY ALL)
SELECT problem_id, root, CAST(sum(greatest(1, coalesce(d, 0) - 1)) AS BIGINT) AS new_ops, CASE WHEN sum(greatest(1, coalesce(d, 0) - 1)) + 5 <= 60 THEN 1 ELSE 0 END AS accepted,
 count(*) AS n_nodes FROM cl LEFT JOIN n USING (problem_id, node) GROUP BY problem_id, root""")
def ancestor_closure(spark, sf_dir):
    up = parents(spark, sf_dir)
    roots = S.abstract_params(graph_nodes(spark, sf_dir), CATEGORIES).where("lj - li = 3").select("problem_id", F.col("param_id").alias("node"))
    closure = S.ancestor_closure(roots, up, max_depth=3)
    degree = up.groupBy("problem_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return S.closure_budget(closure, degree, used_ops=5, max_ops=60, size="n_nodes").where("problem_id IS NOT NULL")


# ---------------------------------------------------------------- dependency problems
DEP = """SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS problem_id, CAST(o_orderkey % 12 AS INT) AS node, o_custkey AS h, o_orderkey AS k,
  CAST(CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE least(o_orderkey % 12, o_custkey % 3 + 1) END AS INT) AS np FROM {orders}"""
DEP_NODES = f"""SELECT problem_id, node, node AS ord, 'instance' AS kind, 'each Box ' || node || chr(39) || 's Coin ' || (h % 5) AS name,
  CASE WHEN node = 0 OR k % 2 = 0 THEN CAST(h % 10 AS BIGINT) END AS rng, CASE WHEN k % 3 = 0 THEN '*' ELSE '+' END AS rng_op,
  CASE WHEN h % 2 = 0 THEN '-' ELSE '+' END AS inner_op FROM ({DEP})"""
DEP_EDGES = f"""SELECT problem_id, node AS child, 0 AS pos, CAST(h % node AS INT) AS parent FROM ({DEP}) WHERE np > 0
  UNION ALL SELECT problem_id, node, 1, CAST((h + 1) % node AS INT) FROM ({DEP}) WHERE np > 1
  UNION ALL SELECT problem_id, node, 2, CAST((h + 2) % node AS INT) FROM ({DEP}) WHERE np > 2"""
LAST = "max(node) AS node"
DSQL = f"WITH RECURSIVE dn AS ({plain(DEP_NODES)}), de AS ({plain(DEP_EDGES)}), q AS (SELECT problem_id, max(node) AS node FROM dn GROUP BY problem_id), " \
       "need AS (SELECT problem_id, node FROM q UNION SELECT n.problem_id, e.parent FROM need n JOIN de e ON e.problem_id = n.problem_id AND e.child = n.node)"
SOLVE = DSQL + """, pl AS (SELECT problem_id, child, list(parent ORDER BY pos) AS ps FROM de GROUP BY ALL),
full_n AS (SELECT dn.*, coalesce(ps, []) AS ps FROM dn LEFT JOIN pl ON pl.problem_id = dn.problem_id AND pl.child = dn.node),
sv AS (SELECT problem_id, 0 AS k, CAST([] AS BIGINT[]) AS vals FROM q
  UNION ALL SELECT sv.problem_id, k + 1, list_append(vals, CASE WHEN len(ps) = 0 THEN rng ELSE
   (CASE WHEN rng IS NOT NULL AND rng_op = '*' THEN rng ELSE 1 END) * (CASE WHEN len(ps) = 2 AND inner_op = '-' THEN vals[ps[1] + 1] - vals[ps[2] + 1] ELSE CAST(list_sum([vals[p + 1] for p in ps]) AS BIGINT) END)
   + (CASE WHEN rng IS NOT NULL AND rng_op = '+' THEN rng ELSE 0 END) END) FROM sv JOIN full_n f ON f.problem_id = sv.problem_id AND f.node = sv.k),
val AS (SELECT f.*, s.vals, s.vals[f.node + 1] AS value FROM full_n f JOIN (SELECT problem_id, arg_max(vals, k) AS vals FROM sv GROUP BY problem_id) s USING (problem_id))"""


def dependency(spark, sf_dir):
    return bound(spark, sf_dir, DEP_NODES), bound(spark, sf_dir, DEP_EDGES)


def all_needed(spark, sf_dir):
    """Solved problems with every node stated and answered."""
    nodes, edges = dependency(spark, sf_dir)
    return P.solve(P.gather_problems(nodes.withColumn("necessary", F.lit(1)), edges))


def with_redundant(spark, sf_dir):
    """Solved problems whose question is the last node; what it does not need is redundant."""
    return P.solve(P.gather_problems(*dependency(spark, sf_dir)))


@query("degrees", DSQL + """ SELECT problem_id, node, (SELECT count(*) FROM de WHERE de.problem_id = dn.problem_id AND de.child = dn.node) AS in_degree,
(SELECT count(*) FROM de WHERE de.problem_id = dn.problem_id AND de.parent = dn.node) AS out_degree FROM dn""")
def degrees(spark, sf_dir):
    return S.degrees(*dependency(spark, sf_dir))


@query("op_count", DSQL + """, d AS (SELECT dn.problem_id, dn.node, count(de.child) AS n FROM dn LEFT JOIN de ON de.problem_id = dn.problem_id AND de.child = dn.node GROUP BY ALL)
SELECT problem_id, CAST(sum(greatest(1, n - 1)) AS BIGINT) AS num_ops FROM d GROUP BY problem_id""")
def op_count(spark, sf_dir):
    return S.op_count(*dependency(spark, sf_dir))


@query("topo_levels", DSQL + """, lv AS (SELECT problem_id, node, 0 AS level FROM dn WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.problem_id = dn.problem_id AND de.child = dn.node)
 UNION SELECT lv.problem_id, de.child, level + 1 FROM lv JOIN de ON de.problem_id = lv.problem_id AND de.parent = lv.node)
SELECT problem_id, node, max(level) AS level FROM lv GROUP BY ALL""")
def topo_levels(spark, sf_dir):
    return S.topo_levels(*dependency(spark, sf_dir))


@query("necessary_vs_redundant", DSQL + " SELECT problem_id, node, CASE WHEN (problem_id, node) IN (SELECT (problem_id, node) FROM need) THEN 1 ELSE 0 END AS necessary FROM dn")
def necessary_vs_redundant(spark, sf_dir):
    nodes, edges = dependency(spark, sf_dir)
    questions = nodes.groupBy("problem_id").agg(F.max("node").alias("node"))
    return S.necessary_nodes(questions, edges, nodes).select("problem_id", "node", "necessary")


@query("solve_problems", SOLVE + " SELECT problem_id, node, name, value FROM val")
def solve_problems(spark, sf_dir):
    return P.node_values(all_needed(spark, sf_dir))


CONDITION = """'The number of ' || name || ' equals' || CASE WHEN rng IS NULL THEN '' ELSE ' ' || rng || CASE WHEN len(ps) = 0 THEN '' WHEN rng_op = '*' THEN ' times' ELSE ' more than' END END ||
 CASE len(ps) WHEN 0 THEN '' WHEN 1 THEN ' ' || pn[1] WHEN 2 THEN ' the ' || CASE WHEN inner_op = '-' THEN 'difference' ELSE 'sum' END || ' of ' || pn[1] || ' and ' || pn[2]
 ELSE ' the sum of ' || pn[1] || ', ' || pn[2] || ' and ' || pn[3] END"""
NAMED = SOLVE + """, nm AS (SELECT problem_id, list(name ORDER BY node) AS names FROM dn GROUP BY problem_id),
w AS (SELECT val.*, [names[p + 1] for p in ps] AS pn FROM val JOIN nm USING (problem_id))"""


@query("render_condition", NAMED + f" SELECT problem_id, node, {CONDITION} AS condition FROM w")
def render_condition(spark, sf_dir):
    rows = P.node_rows(all_needed(spark, sf_dir))
    return rows.select("problem_id", F.col("n.node").alias("node"), "condition")


@query("render_question", NAMED + f""" SELECT problem_id, string_agg({CONDITION}, '.' || chr(10) ORDER BY md5('5|' || problem_id || '|' || node)) || '.' || chr(10) ||
 max('How many ' || split_part(name, '''s ', 2) || ' does ' || split_part(name, '''s ', 1) || ' have?') FILTER (node = (SELECT node FROM q WHERE q.problem_id = w.problem_id)) AS query FROM w GROUP BY problem_id""")
def render_question(spark, sf_dir):
    return P.render_problem(P.node_rows(all_needed(spark, sf_dir)), seed=5)


LETTERED = NAMED + """, lt AS (SELECT problem_id, list(c ORDER BY md5('5|' || problem_id || '|' || c)) AS letters FROM q, (SELECT unnest(range(52)) AS i) z,
  LATERAL (SELECT chr(CAST(CASE WHEN i < 26 THEN 97 + i ELSE 39 + i END AS INT)) AS c) y GROUP BY problem_id),
eq AS (SELECT w.*, letters[node + 1] AS v, [letters[p + 1] for p in ps] AS pv, [CAST(vals[p + 1] AS VARCHAR) for p in ps] AS px FROM w JOIN lt USING (problem_id))"""


def _inner(p):
    body = f"CASE WHEN len({p}) = 2 AND inner_op = '-' THEN array_to_string({p}, ' - ') ELSE array_to_string({p}, ' + ') END"
    return f"CASE WHEN rng IS NULL THEN {body} ELSE rng || ' ' || rng_op || ' ' || CASE WHEN len({p}) > 1 THEN '(' || {body} || ')' ELSE {body} END END"


@query("render_answer_plain", LETTERED + f""", ln AS (SELECT problem_id, node, value, 'Define ' || name || ' as ' || v || '. So ' || v || CASE WHEN len(ps) = 0 THEN '' ELSE ' = ' || {_inner('pv')} ||
 CASE WHEN regexp_matches({_inner('px')}, '[-+*]') THEN ' = ' || {_inner('px')} ELSE '' END END || ' = ' || value || '.' AS line FROM eq)
SELECT problem_id, '<think>' || chr(10) || 'Let''s compute the answer step by step.' || chr(10) || string_agg(line, chr(10) ORDER BY node) || chr(10) || 'Thus, the answer is ' || arg_max(value, node) || '.' || chr(10) ||
 '</think>' || chr(10) || '<answer>' || chr(10) || 'The final answer is ' || chr(92) || 'boxed' || chr(123) || arg_max(value, node) || chr(125) || '.' || chr(10) || '</answer>' AS response FROM ln GROUP BY problem_id""")
def render_answer_plain(spark, sf_dir):
    return P.render_plain_answer(P.node_rows(all_needed(spark, sf_dir), seed=5))


@query("analysis_level", DSQL + """ SELECT problem_id, node, p FROM (SELECT problem_id, node, problem_id % 5 AS lvl, (SELECT count(*) FROM de WHERE de.problem_id = dn.problem_id AND de.child = dn.node)
 + CASE WHEN rng IS NULL THEN 0 ELSE 1 END AS n FROM dn), LATERAL (SELECT CAST(CASE lvl WHEN 0 THEN 0 WHEN 4 THEN CASE WHEN n > 0 THEN 1 ELSE 0 END
 ELSE [0, 0, 0.1, 0.4, 0.8, 1, 1, 1][CASE WHEN n = 0 THEN 1 ELSE n + lvl END] END AS DOUBLE) AS p)""")
def analysis_level(spark, sf_dir):
    rows = all_needed(spark, sf_dir).select("problem_id", F.explode_outer("nodes").alias("n"))
    inputs = F.size("n.parents") + F.when(F.col("n.rng").isNotNull(), 1).otherwise(0)
    return rows.select("problem_id", "n.node", P.analysis_probability(F.col("problem_id") % 5, inputs).alias("p"))


def unit(*parts):
    return "('0x' || substr(md5('5|' || " + " || '|' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


EVENTS = LETTERED + f""", ps AS (SELECT dn.problem_id, dn.node, dn.name, CASE WHEN (dn.problem_id, dn.node) IN (SELECT (problem_id, node) FROM need) THEN 0 ELSE 1 END AS late FROM dn),
pl2 AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY late, node) - 1 AS place FROM ps),
pe AS (SELECT c.problem_id, c.place, list(p.place ORDER BY de.pos) AS pa FROM pl2 c JOIN de ON de.problem_id = c.problem_id AND de.child = c.node
  JOIN pl2 p ON p.problem_id = c.problem_id AND p.node = de.parent GROUP BY ALL),
pr AS (SELECT problem_id, count(*) AS n, count(*) FILTER (late = 0) AS nn, list(coalesce(pa, []) ORDER BY place) AS parents, list(node ORDER BY place) AS node_ids,
  list(name ORDER BY place) AS at_names FROM pl2 LEFT JOIN pe USING (problem_id, place) GROUP BY problem_id),
st AS (SELECT problem_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cur, false AS ok, CAST([] AS BIGINT[]) AS solved, CAST([] AS BIGINT[]) AS denoted, CAST(NULL AS BIGINT) AS ev,
   false AS was_denoted, CAST([] AS BIGINT[]) AS unk FROM pr
  UNION ALL SELECT problem_id, i, CASE WHEN reflect THEN cur ELSE cur + 1 END, CASE WHEN seen THEN ok WHEN reflect THEN len(unk) = 0 ELSE true END,
   CASE WHEN NOT seen AND len(unk) = 0 THEN list_append(solved, tgt) ELSE solved END, CASE WHEN seen THEN denoted ELSE list_append(denoted, tgt) END,
   CASE WHEN NOT seen THEN tgt END, list_contains(denoted, tgt), unk
  FROM (SELECT *, list_contains(solved, tgt) AS seen, [p for p in parents[tgt + 1] if NOT list_contains(solved, p)] AS unk
   FROM (SELECT *, CASE WHEN NOT reflect THEN cur WHEN n > nn AND dk < 0.3 THEN nn + CAST(floor(dt * (n - nn)) AS BIGINT) ELSE cur + 1 + CAST(floor(dt * (nn - 1 - cur)) AS BIGINT) END AS tgt
    FROM (SELECT *, cur > 0 AND cur < nn - 1 AND ok AND i < 3 * n AND dr < 0.3 AS reflect
     FROM (SELECT st.problem_id, st.i + 1 AS i, cur, ok, solved, denoted, n, nn, parents, {unit('problem_id', '(st.i + 1)', "'reflect'")} AS dr,
       {unit('problem_id', '(st.i + 1)', "'kind'")} AS dk, {unit('problem_id', '(st.i + 1)', "'target'")} AS dt FROM st JOIN pr USING (problem_id) WHERE cur < nn))))),
evs AS (SELECT problem_id, row_number() OVER (PARTITION BY problem_id ORDER BY i) - 1 AS line_no, ev, was_denoted, unk FROM st WHERE ev IS NOT NULL),
ee AS (SELECT evs.*, node_ids[ev + 1] AS node, len(unk) = 0 AS correct, [at_names[u + 1] for u in unk] AS un, parents[ev + 1] AS pa, nn, node_ids, at_names FROM evs JOIN pr USING (problem_id))"""


def choose(templates, tag):
    texts = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    text = f"[{texts}][1 + CAST(floor({unit('problem_id', 'line_no', repr(tag))} * {len(templates)}) AS INT)]"
    for slot, column in (("{n}", "name"), ("{v}", "v"), ("{x}", "CAST(value AS VARCHAR)"), ("{u}", "array_to_string(un, ', ')"), ("{be}", "be")):
        text = f"replace({text}, '{slot}', {column})"
    return text


COT = EVENTS + f""", ln AS (SELECT ee.problem_id, line_no, was_denoted, correct, un, CASE WHEN len(un) = 1 THEN 'is' ELSE 'are' END AS be, nn, ev, w.name, w.rng, w.rng_op, w.inner_op, w.ps, w.pn, w.value,
  letters[ev + 1] AS v, [letters[p + 1] for p in pa] AS pv, [CAST(w.vals[node_ids[p + 1] + 1] AS VARCHAR) for p in pa] AS px FROM ee JOIN w ON w.problem_id = ee.problem_id AND w.node = ee.node JOIN lt ON lt.problem_id = ee.problem_id),
tx AS (SELECT *, CASE WHEN len(ps) = 0 THEN {choose(P.DIRECT, 'direct')} || ' ' || {choose(P.DEFINE_AFTER_SELECT, 'define')} || ' So ' || v || ' = ' || value || '.'
  ELSE CASE WHEN was_denoted THEN {choose(P.SELECT, 'select')} || ' Remember that it has been denoted as ' || v || '.'
    WHEN {unit('problem_id', 'line_no', "'form'")} < 0.5 THEN {choose(P.SELECT, 'select')} || ' ' || {choose(P.DEFINE_AFTER_SELECT, 'define')} ELSE {choose(P.DEFINE_ALONE, 'alone')} END
   || CASE WHEN {unit('problem_id', 'line_no', "'analysis'")} < [0, 0.1, 0.4, 0.8, 1, 1][1 + len(ps) + CASE WHEN rng IS NULL THEN 0 ELSE 1 END]
      THEN ' We know that it equals' || split_part({CONDITION}, ' equals', 2) || '.' ELSE '' END || ' ' ||
   CASE WHEN correct THEN 'Then ' || v || ' = ' || {_inner('pv')} || ' = ' || {_inner('px')} || CASE WHEN {_inner('px')} <> CAST(value AS VARCHAR) THEN ' = ' || value ELSE '' END || '.'
    ELSE {choose(P.UNKNOWN, 'unknown')} END END AS line FROM ln)
SELECT problem_id, '<think>' || chr(10) || 'Let''s compute the answer step by step.' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY line_no) || chr(10) || 'Thus, the answer is ' ||
 max(value) FILTER (ev = nn - 1) || '.' || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || 'The final answer is ' || chr(92) || 'boxed' || chr(123) || max(value) FILTER (ev = nn - 1) || chr(125) || '.' ||
 chr(10) || '</answer>' AS response FROM tx GROUP BY problem_id"""


@query("render_answer_cot", COT)
def render_answer_cot(spark, sf_dir):
    return P.render_cot_answer(with_redundant(spark, sf_dir), seed=5, reflection_prob=0.3, detailed=False)


@query("render_answer_cot_marked", COT)
def render_answer_cot_marked(spark, sf_dir):
    """The marked text without its marks is the plain answer."""
    marked = P.render_cot_answer(with_redundant(spark, sf_dir), seed=5, reflection_prob=0.3, detailed=False, wrap=True)
    return marked.select("problem_id", strip_markers(F.col("response_with_mask")).alias("response"))


@query("inject_reflection", EVENTS + """ SELECT problem_id, line_no, node, CASE WHEN correct THEN 1 ELSE 0 END AS correct, CASE WHEN was_denoted THEN 1 ELSE 0 END AS denoted,
 array_to_string(un, ',') AS unknown FROM ee""")
def inject_reflection(spark, sf_dir):
    events = P.attempt_events(with_redundant(spark, sf_dir), 0.3, seed=5)
    lines = events.select("problem_id", "nodes", F.posexplode_outer("events").alias("line_no", "e"))
    return lines.select("problem_id", F.col("line_no").cast("bigint").alias("line_no"), F.expr("get(nodes, e.node).node").alias("node"),
                        F.col("e.correct").cast("int").alias("correct"), F.col("e.denoted").cast("int").alias("denoted"),
                        F.expr("array_join(transform(e.unknown, p -> get(nodes, p).name), ',')").alias("unknown"))


# ---------------------------------------------------------------- reading texts back
@query("parse_conditions", NAMED + """ SELECT problem_id, name, rng, CASE WHEN rng IS NOT NULL AND len(ps) > 0 THEN rng_op END AS rng_op,
 CASE WHEN len(ps) = 2 THEN inner_op WHEN len(ps) > 2 THEN '+' END AS inner_op, array_to_string(pn, ';') AS parents, 0 AS is_question FROM w
UNION ALL SELECT problem_id, name, NULL, NULL, NULL, '', 1 FROM w WHERE (problem_id, node) IN (SELECT (problem_id, node) FROM q)""")
def parse_conditions(spark, sf_dir):
    read = reading.parse_conditions(P.render_problem(P.node_rows(all_needed(spark, sf_dir)), seed=5))
    return read.select("problem_id", "name", "rng", "rng_op", "inner_op", F.array_join("parents", ";").alias("parents"), "is_question")


@query("trace_steps", LETTERED + f""" SELECT problem_id, CAST(node AS INT) AS line_no, name, v AS var, CAST(value AS VARCHAR) AS value,
 1 + CASE WHEN len(ps) > 0 THEN 1 + CASE WHEN regexp_matches({_inner('px')}, '[-+*]') THEN 1 ELSE 0 END ELSE 0 END AS n_parts FROM eq""")
def trace_steps(spark, sf_dir):
    steps = reading.trace_steps(P.render_plain_answer(P.node_rows(all_needed(spark, sf_dir), seed=5)))
    return steps.select("problem_id", "line_no", "name", "var", F.element_at("parts", -1).alias("value"), F.size("parts").alias("n_parts"))


@query("trace_audit", DSQL + """ SELECT problem_id, CAST(count(*) - CASE WHEN problem_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS n_steps,
 CAST(CASE WHEN problem_id % 7 <> 0 AND problem_id % 3 = 1 THEN (SELECT count(DISTINCT child) FROM de JOIN dn c ON c.problem_id = de.problem_id AND c.node = child
  WHERE de.problem_id = dn.problem_id AND parent = 0 AND NOT coalesce(c.rng_op = '*' AND c.rng = 0, false)) ELSE 0 END AS INT) AS n_broken,
 CAST(CASE WHEN problem_id % 7 = 0 THEN (SELECT count(DISTINCT child) FROM de WHERE de.problem_id = dn.problem_id AND parent = 0) ELSE 0 END AS INT) AS n_undefined,
 CASE WHEN problem_id % 5 = 0 THEN 0 ELSE 1 END AS final_ok FROM dn GROUP BY problem_id""")
def trace_audit(spark, sf_dir):
    """Every seventh answer lacks its first step, every third states another value there, every fifth boxes another number."""
    answers = P.render_plain_answer(P.node_rows(all_needed(spark, sf_dir), seed=5))
    first = F.when(F.col("problem_id") % 7 == 0, F.regexp_replace("response", r"step\.\nDefine .*\n", "step.\n")).when(
        F.col("problem_id") % 3 == 1, F.regexp_replace("response", r"(step\.\nDefine [^\n]* So [a-zA-Z] = -?\d+)\.", "$11.")).otherwise(F.col("response"))
    changed = F.when(F.col("problem_id") % 5 == 0, F.replace(first, F.lit("boxed{"), F.lit("boxed{1"))).otherwise(first)
    return reading.trace_audit(answers.withColumn("response", changed))


@query("behaviour_counts", COT[: COT.index(",\ntx AS")] + f""" SELECT problem_id, CAST(count(*) AS INT) AS n_goals, CAST(count(*) FILTER (NOT correct AND len(ps) > 0) AS INT) AS n_reflections,
 CAST(count(*) FILTER (len(ps) > 0 AND {unit('problem_id', 'line_no', "'analysis'")} < [0, 0.1, 0.4, 0.8, 1, 1][1 + len(ps) + CASE WHEN rng IS NULL THEN 0 ELSE 1 END]) AS INT) AS n_analyses,
 CAST(count(*) FILTER (was_denoted AND len(ps) > 0) AS INT) AS n_reminders FROM ln GROUP BY problem_id""")
def behaviour_counts(spark, sf_dir):
    return reading.behaviour_counts(P.render_cot_answer(with_redundant(spark, sf_dir), seed=5, reflection_prob=0.3, detailed=False))


QUESTIONS = NAMED + f""", rq AS (SELECT problem_id, list({CONDITION} ORDER BY md5('5|' || problem_id || '|' || node)) AS cs,
 max('How many ' || split_part(name, '''s ', 2) || ' does ' || split_part(name, '''s ', 1) || ' have?') FILTER (node = (SELECT node FROM q WHERE q.problem_id = w.problem_id)) AS ask FROM w GROUP BY problem_id)"""


@query("augment_question_order", QUESTIONS + """, x AS (SELECT problem_id, ask, copy, c, i - 1 AS i FROM (SELECT problem_id, ask, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM rq), range(3) z(copy))
SELECT problem_id, CAST(copy AS INT) AS copy, string_agg(c, '.' || chr(10) ORDER BY CASE WHEN copy = 0 THEN printf('%04d', i) ELSE md5('8|' || problem_id || '|' || copy || '|' || i) END) || '.' || chr(10) || max(ask) AS query FROM x GROUP BY problem_id, copy""")
def augment_question_order(spark, sf_dir):
    raw = P.render_problem(P.node_rows(all_needed(spark, sf_dir)), seed=5)
    return P.shuffle_conditions(raw, "problem_id", 3, seed=8).select("problem_id", "copy", "query")


ORDERS = DSQL + """, ix AS (SELECT problem_id, node, row_number() OVER (PARTITION BY problem_id ORDER BY node) - 1 AS i FROM need),
cd AS (SELECT ix.problem_id, ix.node, ix.i, coalesce(list(de.parent) FILTER (de.parent IS NOT NULL), []) AS ps FROM ix LEFT JOIN de ON de.problem_id = ix.problem_id AND de.child = ix.node GROUP BY ALL),
wk AS (SELECT problem_id, copy, 0 AS k, CAST([] AS INT[]) AS o FROM q, range(1, 4) z(copy)
  UNION ALL SELECT wk.problem_id, wk.copy, wk.k + 1, list_append(any_value(wk.o), arg_min(cd.node, md5('8|' || wk.problem_id || '|' || wk.copy || '|' || cd.i)))
  FROM wk JOIN cd ON cd.problem_id = wk.problem_id WHERE NOT list_contains(wk.o, cd.node) AND len([x for x in cd.ps if NOT list_contains(wk.o, x)]) = 0 GROUP BY wk.problem_id, wk.copy, wk.k),
last AS (SELECT problem_id, copy, arg_max(o, k) AS o FROM wk GROUP BY ALL)
SELECT l.problem_id, CAST(l.copy AS INT) AS copy, array_to_string(list_append([x for x in o if x <> q.node], q.node), ',') AS "order" FROM last l JOIN q USING (problem_id)"""


@query("augment_answer_order", ORDERS)
def augment_answer_order(spark, sf_dir):
    orders = P.answer_orders(P.gather_problems(*dependency(spark, sf_dir)), 3, seed=8)
    return orders.select("problem_id", "copy", F.expr("array_join(transform(order, i -> get(nodes, i).node), ',')").alias("order"))


@query("augment_dataset")
def augment_dataset(spark, sf_dir):
    solved = with_redundant(spark, sf_dir)
    questions = P.render_problem(P.node_rows(solved), seed=5)
    raw = questions.join(P.render_cot_answer(solved, seed=5), "problem_id")
    by_question = P.augment_dataset(solved, raw, "problem_id", question_aug=3, seed=8).withColumn("kind", F.lit("question"))
    by_answer = P.augment_dataset(solved, raw, "problem_id", answer_aug=3, seed=8).withColumn("kind", F.lit("answer"))
    return by_question.unionByName(by_answer)
