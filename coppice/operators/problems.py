"""Problems as rows: solving, rendering and augmenting dependency graphs.

Node table: problem_id, node, ord, kind (instance | abstract), name, rng, rng_op, inner_op, necessary.
Edge table: problem_id, child, pos, parent (the parents of a node in the order its equation uses them).

Gathering a problem into one row costs one shuffle; every later step is row-local. Texts name nodes by letters, so a
problem that is rendered has at most 52 nodes, which is checked where letters are given out; solving has no limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import simplify_steps
from ..functions.rewards import let
from ..functions.tokens import strip_markers
from .ordered import seeded_key

# Variable letters of a problem, so also the largest number of nodes.
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(ord("A"), ord("Z") + 1)]
# Probability of restating a node's condition, by analysis level, then by number of inputs.
ANALYSIS_LEVELS = [
    [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [0.0, 0.0, 0.1, 0.4, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    [0.0, 0.1, 0.4, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    [0.0, 0.4, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
]
# Fixed value: share of premature attempts that go to a redundant node.
REDUNDANT_SHARE = 0.3
# The wordings of an answer line ({n} name, {v} variable, {x} value, {u} unknown parents, {be} verb).
DIRECT = ["According to the information given, the number of {n} is {x}.", "The number of {n} is {x}."]
SELECT = ["We can then calculate the number of {n}.", "Now, we can find the number of {n}."]
DEFINE_AFTER_SELECT = ["Let it be {v}.", "Let's denote it as {v}.", "Let's call it {v}."]
DEFINE_ALONE = ["Next, let {v} represent the number of {n}.", "Then, let's denote the number of {n} as {v}.",
                "Next, let's define the number of {n} as {v}."]
DENOTED = "Remember that it has been denoted as {v}."
UNKNOWN = ["Wait, the number of {u} {be} unknown, so we cannot compute it.",
           "However, we don't know the number of {u}, thus we cannot calculate it now.",
           "But we haven't calculated the number of {u} yet, thus the value of {v} is still unknown."]
OPENING = ["<think>", "Let's compute the answer step by step."]


def analysis_probability(level: Column, n_inputs: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(p) for p in row]) for row in ANALYSIS_LEVELS])
    return F.element_at(F.element_at(table, level.cast("int") + 1), n_inputs.cast("int") + 1)


# Arrays are exploded with the outer form: they are never empty, and the plain form makes the optimizer copy the
# whole row-local computation into a size check below the projections.
def _once(value: str, name: str, body: str) -> str:
    """Bind a value inside an expression. A plain column that a lambda uses once may be inlined by the
    optimizer and then runs for every element; a lambda variable never is."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def gather_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per problem: nodes in solving order (redundant ones last) with parent positions.

    Without a ``necessary`` column the last node in order is the question, and what it does not depend on is
    redundant: found with one backward pass over the row.
    """
    marked = "necessary" in nodes.columns
    late = (1 - F.col("necessary")).cast("int") if marked else F.lit(0)
    node = F.struct(late.alias("late"), F.col("ord").cast("int").alias("ord"), F.col("node").cast("int").alias("node"),
                    "kind", "name", F.col("rng").cast("bigint").alias("rng"), "rng_op", "inner_op")
    edge = F.struct(F.col("child").cast("int").alias("child"), F.col("pos").cast("int").alias("pos"), F.col("parent").cast("int").alias("parent"))
    as_node = nodes.select("problem_id", node.alias("n"))
    both = as_node.unionByName(edges.select("problem_id", edge.alias("e")), allowMissingColumns=True)
    rows = both.groupBy("problem_id").agg(F.sort_array(F.collect_list("n")).alias("ns"), F.sort_array(F.collect_list("e")).alias("es"))
    if not marked:
        needed = """aggregate(reverse(ns), array(element_at(ns, -1).node), (acc, n) -> IF(array_contains(acc, n.node),
            array_union(acc, transform(filter(es, e -> e.child = n.node), e -> e.parent)), acc))"""
        rows = rows.withColumn("ns", F.expr(_once(needed, "needed", """sort_array(transform(ns, n -> struct(
            IF(array_contains(needed, n.node), 0, 1) AS late, n.ord, n.node, n.kind, n.name, n.rng, n.rng_op, n.inner_op)))""")))
    return rows.withColumn("ids", F.expr("transform(ns, n -> n.node)")).select(
        "problem_id", F.expr("""transform(ns, n -> struct(n.late, n.ord, n.node, n.kind, n.name, n.rng, n.rng_op, n.inner_op,
        transform(filter(es, e -> e.child = n.node), e -> IF(array_contains(ids, e.parent), cast(array_position(ids, e.parent) - 1 as int), NULL)) AS parents,
        transform(filter(es, e -> e.child = n.node), e -> get(ns, cast(array_position(ids, e.parent) - 1 as int)).kind) AS kinds))""").alias("nodes"),
        F.expr("cast(size(filter(ns, n -> n.late = 0)) as int)").alias("n_needed"))


_PRODUCTS = "(n.kind = 'abstract' AND get(n.kinds, 1) = 'abstract')"
_INNER_VALUE = f"""CASE WHEN {_PRODUCTS} THEN aggregate(sequence(0, cast(size(v) / 2 as int) - 1), 0L, (s, i) -> s + get(v, 2 * i) * get(v, 2 * i + 1))
  WHEN size(v) = 2 AND n.inner_op = '-' THEN get(v, 0) - get(v, 1) ELSE aggregate(v, 0L, (s, x) -> s + x) END"""
_VALUE = f"""CASE WHEN size(v) = 0 THEN n.rng WHEN n.rng IS NULL THEN {_INNER_VALUE} WHEN n.rng_op = '*' THEN n.rng * ({_INNER_VALUE})
  ELSE n.rng + ({_INNER_VALUE}) END"""


def solve(problems: DataFrame, modulo: int | None = None) -> DataFrame:
    """``values`` per node, in solving order; null where a parent is missing or comes later."""
    value = f"pmod({_VALUE}, {int(modulo)}L)" if modulo else _VALUE
    return problems.withColumn("values", F.expr(f"""aggregate(nodes, cast(array() as array<bigint>), (vals, n) -> array_append(vals,
        element_at(transform(array(transform(n.parents, p -> get(vals, p))), v -> {value}), 1)))"""))


def node_values(solved: DataFrame) -> DataFrame:
    """(problem_id, node, name, value): one row per node."""
    return solved.select("problem_id", F.explode_outer(F.arrays_zip("nodes", "values")).alias("z")).select(
        "problem_id", F.col("z.nodes.node").alias("node"), F.col("z.nodes.name").alias("name"), F.col("z.values").alias("value"))


def variable_letters(problem: Column, seed: object, size: Column | None = None) -> Column:
    """The letters in a seeded order per problem; an error when it has more nodes (``size``) than there are letters."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    if size is not None:
        letters = F.when(size <= len(LETTERS), letters).otherwise(F.split(F.raise_error(
            F.lit("not enough variable names: a problem has at most 52 nodes")).cast("string"), ","))
    keyed = F.transform(letters, lambda c: F.struct(seeded_key(seed, problem, c).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def _equation(parts: str) -> str:
    inner = f"""CASE WHEN {_PRODUCTS} THEN array_join(transform(sequence(0, cast(size({parts}) / 2 as int) - 1), i -> concat(get({parts}, 2 * i), ' * ', get({parts}, 2 * i + 1))), ' + ')
      WHEN size({parts}) = 2 AND n.inner_op = '-' THEN concat(get({parts}, 0), ' - ', get({parts}, 1)) ELSE array_join({parts}, ' + ') END"""
    return f"""CASE WHEN n.rng IS NULL THEN {inner} WHEN size({parts}) = 0 THEN cast(n.rng as string)
      ELSE concat(cast(n.rng as string), ' ', n.rng_op, ' ', IF(size({parts}) > 1, concat('(', {inner}, ')'), {inner})) END"""


_CONDITION = """concat('The number of ', n.name, ' equals', IF(n.rng IS NULL, '', concat(' ', n.rng)),
  CASE WHEN n.rng IS NULL OR size(pnames) = 0 THEN '' WHEN n.rng_op = '*' THEN ' times' ELSE ' more than' END,
  CASE WHEN size(pnames) = 0 THEN '' WHEN size(pnames) = 1 THEN concat(' ', get(pnames, 0))
   WHEN size(pnames) = 2 THEN concat(' the ', IF(n.inner_op = '-', 'difference', 'sum'), ' of ', get(pnames, 0), ' and ', get(pnames, 1))
   ELSE concat(' the sum of ', array_join(slice(pnames, 1, size(pnames) - 1), ', '), ' and ', element_at(pnames, -1)) END)"""


def node_rows(solved: DataFrame, seed: object = 0, keep: Sequence[str] = ()) -> DataFrame:
    """One row per node with its variable, value, equations and condition text."""
    lettered = solved.withColumn("letters", variable_letters(F.col("problem_id"), seed, F.size("nodes")))
    rows = lettered.select("problem_id", "n_needed", "nodes", "values", "letters", *keep, F.posexplode_outer("nodes").alias("at", "n"))
    return _describe(rows)


def _describe(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("pnames", F.expr("transform(n.parents, p -> get(nodes, p).name)"))
            .withColumn("pvars", F.expr("transform(n.parents, p -> get(letters, p))"))
            .withColumn("pvals", F.expr("transform(n.parents, p -> cast(get(values, p) as string))"))
            .withColumn("var", F.expr("get(letters, at)")).withColumn("value", F.expr("get(values, at)"))
            .withColumn("eq_vars", F.expr(_equation("pvars"))).withColumn("eq_values", F.expr(_equation("pvals")))
            .withColumn("condition", F.when(F.col("n.kind") == "instance", F.expr(_CONDITION))))


def render_question(name: Column) -> Column:
    """How many B does A have? from the name "A's B"."""
    parts = F.split(name, "'s ")
    return F.concat(F.lit("How many "), F.get(parts, F.lit(1)), F.lit(" does "), F.get(parts, F.lit(0)), F.lit(" have?"))


def render_problem(rows: DataFrame, seed: object = 0, redundant: bool = True, shuffled: bool = True) -> DataFrame:
    """The query of every problem: its conditions (seeded order) and the question last."""
    stated = F.col("condition").isNotNull()
    if not redundant:
        stated = stated & (F.col("n.late") == 0)
    order = seeded_key(seed, F.col("problem_id"), F.col("at")) if shuffled else F.lpad(F.col("at").cast("string"), 4, "0")
    items = F.collect_list(F.when(stated, F.struct(order.alias("k"), F.col("condition").alias("c"))))
    question = F.max(F.when(F.col("at") == F.col("n_needed") - 1, render_question(F.col("n.name"))))
    return rows.groupBy("problem_id").agg(F.sort_array(items).alias("cs"), question.alias("q")).select(
        "problem_id", F.array_join(F.concat(F.transform("cs", lambda x: x["c"]), F.array("q")), ".\n").alias("query"))


def _wrap_up(lines: DataFrame, order: str, out: str = "response") -> DataFrame:
    """Lines of a problem between the opening and the boxed answer."""
    body = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    final = F.max("final_value").cast("string")
    closing = F.array(F.concat(F.lit("Thus, the answer is "), final, F.lit(".")), F.lit("</think>"),
                      F.concat(F.lit("<answer>\nThe final answer is \\boxed{"), final, F.lit("}.\n</answer>")))
    opening = F.array(*[F.lit(t) for t in OPENING])
    return lines.groupBy("problem_id").agg(F.array_join(F.concat(opening, body, closing), "\n").alias(out))


def render_plain_answer(rows: DataFrame) -> DataFrame:
    """Definition line per needed node: Define X as v. So v = equation = numbers = value."""
    needed = rows.where(F.col("n.late") == 0)
    equation = F.concat(F.col("var"), F.lit(" = "), F.col("eq_vars"))
    value = F.col("value").cast("string")
    solution = (F.when(F.size("pnames") == 0, F.concat(F.col("var"), F.lit(" = "), value))
                .when(F.rlike("eq_values", F.lit("[-+*]")), F.concat_ws(" = ", equation, "eq_values", value))
                .otherwise(F.concat_ws(" = ", equation, value)))
    lines = needed.select("problem_id", "at", F.concat(F.lit("Define "), F.col("n.name"), F.lit(" as "), F.col("var"), F.lit(". So "), solution, F.lit(".")).alias("line"),
                          F.when(F.col("at") == F.col("n_needed") - 1, F.col("value")).alias("final_value"))
    return _wrap_up(lines, "at")


def _unit(tag: str, seed: object, *parts: str) -> str:
    key = ", '|', ".join([f"'{seed}'", *parts, f"'{tag}'"])
    return f"(cast(conv(substring(md5(concat({key})), 1, 8), 16, 10) as bigint) / 4294967296D)"


def attempt_events(problems: DataFrame, reflection_prob: float, seed: object = 0) -> DataFrame:
    """``events`` of an answer in order: (node, correct, denoted, unknown parents).

    Needed nodes are solved in order. After a solved node, with probability ``reflection_prob``, one attempt
    goes to a redundant or a later node first; what it still lacks is its unknown parents, and when nothing is
    lacking it counts as solved. A failed attempt is always followed by the next needed node.
    """
    who = "cast(problem_id as string)"
    draw = {t: _unit(t, seed, who, "cast(i as string)") for t in ("reflect", "kind", "target")}
    n = "size(nodes)"
    reflect = f"(s.cur > 0 AND s.cur < n_needed - 1 AND s.ok AND i < 3 * {n} AND {draw['reflect']} < {float(reflection_prob)}D)"
    redundant = f"({n} > n_needed AND {draw['kind']} < {REDUNDANT_SHARE}D)"
    target = f"""IF({reflect}, IF({redundant}, n_needed + cast(floor({draw['target']} * ({n} - n_needed)) as int),
        s.cur + 1 + cast(floor({draw['target']} * (n_needed - 1 - s.cur)) as int)), s.cur)"""
    unknown = "filter(get(nodes, t.at).parents, p -> NOT array_contains(s.solved, p))"
    skip = "IF(t.reflect, s, named_struct('cur', s.cur + 1, 'ok', s.ok, 'solved', s.solved, 'denoted', s.denoted, 'events', s.events))"
    attempt = f"""element_at(transform(array({unknown}), u -> named_struct(
        'cur', IF(t.reflect, s.cur, s.cur + 1), 'ok', IF(t.reflect, size(u) = 0, true),
        'solved', IF(size(u) = 0, array_append(s.solved, t.at), s.solved), 'denoted', array_append(s.denoted, t.at),
        'events', array_append(s.events, named_struct('node', t.at, 'correct', size(u) = 0, 'denoted', array_contains(s.denoted, t.at), 'unknown', u)))), 1)"""
    step = f"""IF(s.cur >= n_needed, s, element_at(transform(array(named_struct('reflect', {reflect}, 'at', {target})),
        t -> IF(array_contains(s.solved, t.at), {skip}, {attempt})), 1))"""
    start = """named_struct('cur', 0, 'ok', false, 'solved', cast(array() as array<int>), 'denoted', cast(array() as array<int>),
        'events', cast(array() as array<struct<node:int,correct:boolean,denoted:boolean,unknown:array<int>>>))"""
    return problems.withColumn("events", F.expr(f"aggregate(sequence(0, 4 * {n} + 8), {start}, (s, i) -> {step}, s -> s.events)"))


def cot_lines(eventful: DataFrame, seed: object = 0, analysis_level: int = 2, detailed: bool = True,
              wrap: bool = False) -> DataFrame:
    """One line per event, worded by seeded choice."""
    rows = (eventful.withColumn("letters", variable_letters(F.col("problem_id"), seed, F.size("nodes")))
            .select("problem_id", "n_needed", "nodes", "values", "letters", F.posexplode_outer("events").alias("line_no", "e"))
            .withColumn("at", F.col("e.node")).withColumn("n", F.expr("get(nodes, at)")))
    rows = _describe(rows).withColumn("unknown", F.expr("transform(e.unknown, p -> get(nodes, p).name)"))

    def draw(tag):
        return F.expr(_unit(tag, seed, "cast(problem_id as string)", "cast(line_no as string)"))

    correct = F.col("e.correct")
    name = F.when(correct, F.concat(F.lit("<<"), F.col("n.name"), F.lit(">>"))).otherwise(F.col("n.name")) if wrap else F.col("n.name")
    words = {"{n}": name, "{v}": F.col("var"), "{x}": F.col("value").cast("string"), "{u}": F.array_join("unknown", ", "),
             "{be}": F.when(F.size("unknown") == 1, "is").otherwise("are")}

    def say(template):
        text = F.lit(template)
        for slot, value in words.items():
            if slot in template:
                text = F.replace(text, F.lit(slot), value)
        return text

    def pick(templates, tag):
        def worded(at):  # only the chosen wording is filled in
            chosen = F.when(at == 0, say(templates[0]))
            for i, template in enumerate(templates[1:-1], 1):
                chosen = chosen.when(at == i, say(template))
            return chosen.otherwise(say(templates[-1]))
        return let(F.floor(draw(tag) * len(templates)).cast("int"), worded)

    sources = F.size("pnames")
    inputs = sources + F.when(F.col("n.rng").isNotNull(), 1).otherwise(0)
    value = F.col("value").cast("string")
    equation = F.when(correct & (sources > 0), F.col("eq_values"))
    if detailed:
        steps = simplify_steps(equation)
    else:
        steps = F.when(F.trim(equation) != value, F.array(equation, value)).otherwise(F.array(equation))
    rows = rows.withColumn("steps", steps)
    var, eq = F.col("var"), F.col("eq_vars")
    if wrap:
        middle = F.array_join(F.slice("steps", F.lit(2), F.size("steps") - 2), " = ")
        long = F.concat(F.lit("Then "), var, F.lit(" = <<"), eq, F.lit(" = "), F.get("steps", F.lit(0)), F.lit(" =>> "), middle, F.lit(" = <<"), value, F.lit(">>."))
        short = F.concat(F.lit("Then "), var, F.lit(" = <<"), eq, F.lit(" = "), F.array_join("steps", " = "), F.lit(">>."))
        then = F.when(F.size("steps") >= 3, long).otherwise(short)
        so = F.concat(F.lit("So "), var, F.lit(" = <<"), value, F.lit(">>."))
    else:
        then = F.concat(F.lit("Then "), var, F.lit(" = "), eq, F.lit(" = "), F.array_join("steps", " = "), F.lit("."))
        so = F.concat(F.lit("So "), var, F.lit(" = "), value, F.lit("."))
    intro = (F.when(F.col("e.denoted"), F.concat_ws(" ", pick(SELECT, "select"), say(DENOTED)))
             .when(draw("form") < 0.5, F.concat_ws(" ", pick(SELECT, "select"), pick(DEFINE_AFTER_SELECT, "define")))
             .otherwise(pick(DEFINE_ALONE, "alone")))
    restated = F.concat(F.lit("We know that it equals"), F.substring_index("condition", " equals", -1), F.lit("."))
    analysis = F.when((F.col("n.kind") == "instance") & (draw("analysis") < analysis_probability(F.lit(analysis_level), inputs)), restated)
    outcome = F.when(correct, then).otherwise(pick(UNKNOWN, "unknown"))
    line = F.when(sources == 0, F.concat_ws(" ", F.lit("-"), pick(DIRECT, "direct"), pick(DEFINE_AFTER_SELECT, "define"), so)).otherwise(
        F.concat_ws(" ", F.lit("-"), intro, analysis, outcome))
    return rows.select("problem_id", "line_no", "e", line.alias("line"),
                       F.when(F.col("at") == F.col("n_needed") - 1, F.col("value")).alias("final_value"))


def render_cot_answer(solved: DataFrame, seed: object = 0, reflection_prob: float = 0.3, analysis_level: int = 2,
                      detailed: bool = True, wrap: bool = False) -> DataFrame:
    """Worked answer per problem; with ``wrap`` also the marked text next to the clean one."""
    lines = cot_lines(attempt_events(solved, reflection_prob, seed), seed, analysis_level, detailed, wrap)
    if not wrap:
        return _wrap_up(lines, "line_no")
    marked = _wrap_up(lines, "line_no", "response_with_mask")
    return marked.withColumn("response", strip_markers(F.col("response_with_mask")))


# ---------------------------------------------------------------- augmentation
def shuffle_conditions(df: DataFrame, row_id: str, copies: int, seed: object = 0, query: str = "query") -> DataFrame:
    """``copies`` rows per problem: the query as it is, then seeded orders of its conditions, question last."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    parts = F.split(query, r"\.\n")
    conditions = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keyed = F.transform(conditions, lambda c, i: F.struct(seeded_key(seed, F.col(row_id), F.col("copy"), i).alias("k"), c.alias("c")))
    mixed = F.array_join(F.concat(F.transform(F.array_sort(keyed), lambda x: x["c"]), F.slice(parts, -1, 1)), ".\n")
    return out.withColumn(query, F.when(F.col("copy") == 0, F.col(query)).otherwise(mixed))


def answer_orders(problems: DataFrame, copies: int, seed: object = 0) -> DataFrame:
    """``copies`` seeded topological orders of the needed nodes, the question node last."""
    out = problems.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    key = "md5(concat_ws('|', '{}', problem_id, copy, i))".format(seed)
    ranks = f"transform(sequence(0, n_needed - 1), i -> {key})"
    ready = """filter(sequence(0, n_needed - 1), i -> NOT array_contains(o, i) AND
        forall(get(nodes, i).parents, p -> p IS NULL OR p >= n_needed OR array_contains(o, p)))"""
    chosen = f"array_min(transform({ready}, i -> named_struct('k', get(ranks, i), 'i', i))).i"
    walk = f"aggregate(sequence(1, n_needed), cast(array() as array<int>), (o, r) -> array_append(o, {chosen}))"
    out = out.withColumn("o", F.expr(_once(ranks, "ranks", walk)))
    whole = F.expr("NOT exists(o, x -> x IS NULL)")
    order = F.expr("array_append(array_remove(o, n_needed - 1), n_needed - 1)")
    return out.withColumn("order", F.when(whole, order).otherwise(
        F.from_json(F.raise_error(F.lit("the dependency graph has a cycle")).cast("string"), "array<int>"))).drop("o")


def reorder_problem(ordered: DataFrame) -> DataFrame:
    """Problems with their needed nodes laid out in ``order``; redundant nodes keep their places."""
    spots = ordered.withColumn("spots", F.expr("IF(size(nodes) > n_needed, concat(order, sequence(n_needed, size(nodes) - 1)), order)"))
    moved = F.expr("""transform(spots, at -> struct(get(nodes, at).late AS late, get(nodes, at).ord AS ord, get(nodes, at).node AS node, get(nodes, at).kind AS kind,
        get(nodes, at).name AS name, get(nodes, at).rng AS rng, get(nodes, at).rng_op AS rng_op, get(nodes, at).inner_op AS inner_op,
        transform(get(nodes, at).parents, p -> cast(array_position(spots, p) - 1 as int)) AS parents, get(nodes, at).kinds AS kinds))""")
    return spots.withColumn("nodes", moved).drop("spots", "order", "values")


def augment_dataset(problems: DataFrame, raw: DataFrame, row_id: str, question_aug: int = 0, answer_aug: int = 0,
                    use_cot: bool = True, seed: object = 0, **render) -> DataFrame:
    """Expand accepted problems by question or by answer augmentation (one of them; answers need worked text)."""
    if question_aug > 0 and answer_aug > 0:
        raise ValueError("question and answer augmentation exclude each other")
    if answer_aug > 0 and not use_cot:
        raise ValueError("answer augmentation needs worked answers")
    if question_aug > 0:
        return shuffle_conditions(raw, row_id, question_aug, seed)
    original = raw.withColumn("copy", F.lit(0))
    if answer_aug <= 1:
        return original
    extra = answer_orders(problems, answer_aug - 1, seed)
    keyed = reorder_problem(extra).withColumn("base", F.col("problem_id")).withColumn(
        "problem_id", F.concat_ws("#", F.col("problem_id").cast("string"), F.col("copy").cast("string")))
    written = ["response", "response_with_mask"] if render.get("wrap") else ["response"]
    answers = render_cot_answer(solve(keyed), seed, **render).select(
        F.regexp_extract("problem_id", "(?s)^(.*)#", 1).cast(raw.schema[row_id].dataType).alias(row_id),
        F.substring_index("problem_id", "#", -1).cast("int").alias("copy"), *written)
    others = raw.drop(*written)
    return original.unionByName(answers.join(others, row_id).select(*original.columns))
