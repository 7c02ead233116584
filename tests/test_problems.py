import re

import pytest
from pyspark.sql import functions as F

from coppice.functions.tokens import strip_markers
from coppice.operators import problems as P
from coppice.operators import structure as S

NODE = "problem_id bigint, node int, ord int, kind string, name string, rng bigint, rng_op string, inner_op string"
EDGE = "problem_id bigint, child int, pos int, parent int"
# a worked problem: (kind, name, rng, rng_op, inner_op, parents); the last needed node is the question
WORKED = [
    ("instance", "each P Room's C Pack", 1, None, None, []), ("instance", "each O School's P Room", 5, "*", None, [0]),
    ("instance", "each D Room's D Bag", 0, "+", None, [1]), ("instance", "each O School's G Studio", 8, "+", None, [2]),
    ("instance", "each O School's D Room", 6, None, None, []), ("abstract", "each O School's Classroom", None, None, None, [3, 1, 4]),
    ("instance", "each R School's P Room", 2, "*", None, [5]), ("abstract", "each R School's Classroom", None, None, None, [6]),
    ("instance", "each G Studio's M Pack", None, None, "-", [7, 5]), ("instance", "each C School's D Room", 5, None, None, []),
    ("instance", "each D Room's M Pack", 9, "+", "+", [2, 9, 0])]


def worked(spark, problem=7):
    nodes = [(problem, i, i, k, n, r, ro, io) for i, (k, n, r, ro, io, _) in enumerate(WORKED)]
    edges = [(problem, i, p, parent) for i, w in enumerate(WORKED) for p, parent in enumerate(w[5])]
    marked = spark.createDataFrame(nodes, NODE).withColumn("necessary", (F.col("node") <= 8).cast("int"))
    return marked, spark.createDataFrame(edges, EDGE)


def test_worked_problem_values_and_plain_answer(spark):
    solved = P.solve(P.gather_problems(*worked(spark)))
    values = {r.node: r.value for r in P.node_values(solved).collect()}
    assert values == {0: 1, 1: 5, 2: 5, 3: 13, 4: 6, 5: 24, 6: 48, 7: 48, 8: 24, 9: 5, 10: 20}
    rows = P.node_rows(solved, seed=1)
    text = P.render_plain_answer(rows).first().response
    assert text.endswith("Thus, the answer is 24.\n</think>\n<answer>\nThe final answer is \\boxed{24}.\n</answer>")
    assert re.search(r"Define each O School's Classroom as (\w)\. So \1 = \w \+ \w \+ \w = 13 \+ 5 \+ 6 = 24\.", text)
    assert re.search(r"Define each R School's Classroom as (\w)\. So \1 = \w = 48\.", text)
    query = P.render_problem(rows, seed=1).first().query.split(".\n")
    assert query[-1] == "How many M Pack does each G Studio have?"
    assert "The number of each D Room's M Pack equals 9 more than the sum of each D Room's D Bag, each C School's D Room and each P Room's C Pack" in query
    assert "The number of each R School's P Room equals 2 times each O School's Classroom" in query
    assert "The number of each G Studio's M Pack equals the difference of each R School's Classroom and each O School's Classroom" in query
    assert len(query) == 10


def test_products_modulo_and_unresolved(spark):
    nodes = [(1, 0, 0, "instance", "a's x", 3, None, None), (1, 1, 1, "abstract", "a's y", 4, None, None), (1, 2, 2, "abstract", "a's z", None, None, None),
             (1, 3, 3, "instance", "a's w", 2, "+", None)]
    edges = [(1, 2, 0, 0), (1, 2, 1, 1), (1, 3, 0, 44)]
    df = spark.createDataFrame(nodes, NODE).withColumn("necessary", F.lit(1))
    gathered = P.gather_problems(df, spark.createDataFrame(edges, EDGE))
    assert [r.value for r in P.node_values(P.solve(gathered)).orderBy("node").collect()] == [3, 4, 12, None]
    assert P.solve(gathered, modulo=5).first()["values"][2] == 2


def test_redundant_nodes_are_found_in_the_row(spark):
    nodes, edges = worked(spark)
    only = nodes.where("node <= 8 or node = 9").withColumn("ord", F.when(F.col("node") == 9, 0).otherwise(F.col("ord") + 1)).drop("necessary")
    row = P.gather_problems(only, edges.where("child <= 8")).first()
    assert row.n_needed == 9 and [n.node for n in row.nodes] == list(range(9)) + [9]


def test_too_many_nodes(spark):
    """Only texts need letters: a problem of more nodes, or of any ids, is solved."""
    df = spark.createDataFrame([(1, 100 + i, i, "instance", "a's b", i, None, None) for i in range(60)], NODE)
    solved = P.solve(P.gather_problems(df, spark.createDataFrame([(1, 159, 0, 101)], EDGE)))
    assert {r.node: r.value for r in P.node_values(solved).collect()}[100] == 0
    with pytest.raises(Exception, match="variable names"):
        P.node_rows(solved).collect()


@pytest.mark.parametrize("seed", range(6))
def test_reflection_invariants(spark, seed):
    events = P.attempt_events(P.solve(P.gather_problems(*worked(spark))), 0.9, seed).first().events
    solved, failed_before = set(), False
    for e in events:
        parents = WORKED[e.node][5]
        assert sorted(e.unknown) == sorted(p for p in parents if p not in solved)
        assert e.correct == (not e.unknown) and not (failed_before and not e.correct)
        assert e.node not in solved
        if e.correct:
            solved.add(e.node)
        failed_before = not e.correct
    assert set(range(9)) <= solved and events[-1].node == 8


def test_cot_text(spark):
    solved = P.solve(P.gather_problems(*worked(spark)))
    plain = P.render_cot_answer(solved, seed=2, reflection_prob=0.0, analysis_level=4).first().response
    assert re.search(r"We know that it equals 5 times each P Room's C Pack\. Then (\w) = 5 \* \w = 5 \* 1 = 5\.", plain)
    assert re.search(r"= 13 \+ 5 \+ 6 = 18 \+ 6 = 24\.", plain) and plain.count("\n- ") == 9
    short = P.render_cot_answer(solved, seed=2, reflection_prob=0.0, detailed=False).first().response
    assert "18 + 6" not in short
    wrapped = P.render_cot_answer(solved, seed=2, reflection_prob=0.0, analysis_level=4, wrap=True).first()
    assert wrapped.response == plain and "<<each O School's Classroom>>" in wrapped.response_with_mask
    reflected = P.render_cot_answer(solved, seed=4, reflection_prob=0.95).first().response
    assert re.search(r"unknown|haven't calculated|don't know", reflected)


def test_answer_orders_are_topological(spark):
    for row in P.answer_orders(P.gather_problems(*worked(spark)), 5, seed=3).collect():
        assert sorted(row.order) == list(range(9)) and row.order[-1] == 8
        at = {n: i for i, n in enumerate(row.order)}
        assert all(at[p] < at[c] for c in range(9) for p in WORKED[c][5])
    marked = spark.createDataFrame([(1, i, i, "instance", "a's b", 1, None, None) for i in range(2)], NODE).withColumn("necessary", F.lit(1))
    loop = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 0)], EDGE)
    with pytest.raises(Exception, match="cycle"):
        P.answer_orders(P.gather_problems(marked, loop), 1).collect()


def test_reordered_answer_keeps_values(spark):
    solved = P.solve(P.gather_problems(*worked(spark)))
    raw = P.render_cot_answer(solved, seed=5).withColumn("query", F.lit("q"))
    out = P.augment_dataset(solved, raw, "problem_id", answer_aug=4, seed=5).collect()
    assert len(out) == 4 and all("boxed{24}" in r.response for r in out)
    marked = raw.drop("response").join(P.render_cot_answer(solved, seed=5, wrap=True), "problem_id")
    both = P.augment_dataset(solved, marked, "problem_id", answer_aug=3, seed=5, wrap=True)
    assert all(r.response == r.clean for r in both.withColumn("clean", strip_markers(F.col("response_with_mask"))).collect())
    with pytest.raises(ValueError):
        P.augment_dataset(solved, raw, "problem_id", question_aug=2, answer_aug=2)
    with pytest.raises(ValueError):
        P.augment_dataset(solved, raw, "problem_id", answer_aug=2, use_cot=False)


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (1, 2, 1, 0), (2, 0, 0, 1), (2, 1, 0, 0), (2, 2, 0, 0), (2, 2, 1, 3)], EDGE)
    nodes = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(4)], "problem_id bigint, node int")
    got = {(r.problem_id, r.node): r.level for r in S.topo_levels(nodes, edges).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): 0, (1, 1): 1, (1, 2): 2}
    assert got[(2, 3)] == 0 and got[(2, 0)] is None and got[(2, 1)] is None


def test_rollup_covers_every_layer(spark):
    edges = spark.createDataFrame([(1, i, 0, i + 1, 0, 2) for i in range(5)], "problem_id bigint, li int, ni int, lj int, nj int, q int")
    got = {(r.li, r.lj): r.total for r in S.hierarchy_rollup(edges, "q").collect()}
    assert got == {(i, j): 2 ** (j - i) for j in range(1, 6) for i in range(j)}
    with pytest.raises(Exception, match="number of layers"):
        S.hierarchy_rollup(edges, "q", layers=4).collect()


def test_closure_refuses_ancestors_beyond_its_depth(spark):
    _, edges = worked(spark)
    roots = spark.createDataFrame([(7, 8)], "problem_id bigint, node int")
    with pytest.raises(Exception, match="max_depth"):
        S.ancestor_closure(roots, edges, max_depth=1).collect()


def test_closure_modes_agree_and_stop_at_present_nodes(spark):
    nodes, edges = worked(spark)
    roots = spark.createDataFrame([(7, 8)], "problem_id bigint, node int")
    loop = {r.node for r in S.ancestor_closure(roots, edges).collect()}
    lazy = {r.node for r in S.ancestor_closure(roots, edges, max_depth=9).collect()}
    assert loop == lazy == set(range(9))
    known = spark.createDataFrame([(7, 5)], "problem_id bigint, node int")
    assert {r.node for r in S.ancestor_closure(roots, edges, present=known).collect()} == {8, 7, 6}
