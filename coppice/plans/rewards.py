"""Rule rewards over completions built from table rows, whole texts included."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import rewards as R
from ..functions import tokens as K
from ..operators import scoring
from .common import bound, plain, query, table

VALUE = "CAST(p_size % 9 + 1 AS STRING)"


def sql_text(template: str, value: str = VALUE) -> str:
    """SQL for a text with ``@`` standing for the row's digit; special characters are spelled with chr()."""
    parts = []
    for piece in re.split(r"([@\\{}\n'])", template):
        if piece == "@":
            parts.append(value)
        elif piece in ("\\", "{", "}", "\n", "'"):
            parts.append(f"chr({ord(piece)})")
        elif piece:
            parts.append(f"'{piece}'")
    return " || ".join(parts) or "''"


def case(templates, key="p_partkey"):
    whens = " ".join(f"WHEN {i} THEN {sql_text(t)}" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {whens} END"


def numbers(values, key="p_partkey"):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def rows(**columns):
    cols = ", ".join(f"{case(t)} AS {n}" for n, t in columns.items())
    return f"SELECT p_partkey, {cols} FROM {{part}}"


def expected(**columns):
    cols = ", ".join(f"{case(t) if isinstance(t[0], str) else numbers(t)} AS {n}" for n, t in columns.items())
    return f"SELECT p_partkey, {cols} FROM part"


def shown(c):
    return F.coalesce(c, F.lit("FAIL"))


# ---------------------------------------------------------------- boxed answers
DOC = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN body || 'The final answer is ' || box || '.' || nl || '</answer>'
 WHEN 1 THEN body || box || '</answer> trailing' WHEN 2 THEN body || 'nothing</answer>'
 WHEN 3 THEN body || chr(92) || 'boxed' || chr(123) || chr(125) || ' then ' || box || '</answer>'
 WHEN 4 THEN text || '</think> between <answer>' || box || '</answer>' ELSE body || box || '</answer>' || nl || 'more' END AS completion,
 CAST(n_chars % 50 + doc_id % 2 AS STRING) AS truth
 FROM (SELECT doc_id, text, n_chars, chr(10) AS nl, text || '</think>' || chr(10) || '<answer>' AS body,
  chr(92) || 'boxed' || chr(123) || (n_chars % 50) || chr(125) AS box FROM {documents})"""
BOX_RE = r"\\boxed\{([^}]*)\}"
BOXED = f"CASE WHEN regexp_matches(completion, '{BOX_RE}') THEN regexp_extract(completion, '{BOX_RE}', 1) ELSE 'none' END"
LAYOUT = "CASE WHEN regexp_matches('<think>' || completion, '(?sm)\\A<think>.*?</think>\\s*<answer>.*?</answer>$') THEN 1.0::DOUBLE ELSE 0 END"


@query("extract_boxed_first", f"SELECT doc_id, {BOXED} AS answer FROM ({plain(DOC)})")
def extract_boxed_first(spark, sf_dir):
    return bound(spark, sf_dir, DOC).select("doc_id", F.coalesce(R.extract_boxed_first(F.col("completion")), F.lit("none")).alias("answer"))


@query("format_reward", f"SELECT doc_id, {LAYOUT} AS reward FROM ({plain(DOC)})")
def format_reward(spark, sf_dir):
    return bound(spark, sf_dir, DOC).select("doc_id", R.format_reward(F.col("completion")).alias("reward"))


@query("score_boxed", f"""SELECT doc_id, CASE WHEN {BOXED} = truth THEN 1.0::DOUBLE ELSE 0 END + 0.25::DOUBLE * {LAYOUT} AS score,
CASE WHEN {BOXED} = truth THEN 1.0::DOUBLE ELSE 0 END AS plain FROM ({plain(DOC)})""")
def score_boxed(spark, sf_dir):
    c, t = F.col("completion"), F.col("truth")
    return bound(spark, sf_dir, DOC).select("doc_id", R.score_boxed(c, t, 0.25).alias("score"), R.score_boxed(c, t).alias("plain"))


REWARDED = f"""WITH r AS (SELECT d.doc_id, d.source, CASE WHEN {BOXED} = truth THEN 1.0::DOUBLE ELSE 0 END + 0.25::DOUBLE * {LAYOUT} AS rule FROM ({plain(DOC)}) c JOIN documents d ON d.doc_id = c.doc_id),
n AS (SELECT doc_id, len([w for w in regexp_split_to_array(text, '[ \\t\\r\\n]+') if w <> '']) AS n FROM documents)"""


def rewarded(spark, sf_dir, show=0):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", K.ones(K.word_tokens(F.col("text"))).alias("mask"))
    model = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), F.col("quality").alias("model"))
    rows = bound(spark, sf_dir, DOC).join(docs, F.col("doc_id") == F.col("key")).join(model, F.col("doc_id") == F.col("labelled"), "left")
    scorers = {f"src{i}": lambda text, truth, extra: R.score_boxed(text, truth, 0.25) + F.when(extra == "none", 0.5).otherwise(0.0) for i in range(20)}
    return scoring.manage_rewards(rows.withColumn("extra", F.lit("some")), "source", "completion", "truth", "mask", show, "doc_id",
                                  model_score="model", extra="extra", scorers=scorers)


@query("reward_manager", REWARDED + """ SELECT doc_id, CAST(coalesce(quality, rule) AS DOUBLE) AS score, CASE WHEN n > 0 THEN CAST(n - 1 AS INT) END AS at,
CAST(CASE WHEN n > 0 THEN coalesce(quality, rule) ELSE 0 END AS DOUBLE) AS placed FROM r JOIN n USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def reward_manager(spark, sf_dir):
    scored, _ = rewarded(spark, sf_dir)
    placed = F.aggregate("token_rewards", F.lit(0.0), lambda s, x: s + x)
    return scored.select("doc_id", "score", scoring.reward_position(F.col("mask")).alias("at"), placed.alias("placed"))


@query("reward_manager_examples", REWARDED + """ SELECT source, doc_id, score FROM (SELECT source, doc_id, CAST(coalesce(quality, rule) AS DOUBLE) AS score,
row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM r LEFT JOIN labels USING (doc_id)) WHERE k <= 2""")
def reward_manager_examples(spark, sf_dir):
    return rewarded(spark, sf_dir, show=2)[1].select("source", "doc_id", "score")


EVALUATED = """SELECT p_partkey, p_brand AS set_name, p_name AS query, CAST(p_size % 7 AS VARCHAR) AS ground_truth FROM part"""


@query("evaluate_named_sets", f"""WITH e AS (SELECT set_name, CASE WHEN (p_partkey + s) % 7 = CAST(ground_truth AS INT) THEN 1.0 ELSE 0 END AS reward,
 length('<think>' || query || '</think> \\boxed' || chr(123) || ((p_partkey + s) % 7) || chr(125)) AS n FROM ({EVALUATED}), range(3) z(s))
SELECT set_name, round(sum(reward), 6)::DOUBLE AS correct, count(*) AS total, round(avg(reward), 6)::DOUBLE AS accuracy, round(avg(n), 6) AS mean_length FROM e GROUP BY set_name""")
def evaluate_named_sets(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    prompts = parts.select("p_partkey", F.col("p_brand").alias("set_name"), F.col("p_name").alias("query"), (F.col("p_size") % 7).cast("string").alias("ground_truth"))
    said = parts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(2))))
    answer = F.concat(F.lit("<think>"), "p_name", F.lit("</think> \\boxed{"), ((F.col("p_partkey") + F.col("sample")) % 7).cast("string"), F.lit("}"))
    scored = scoring.evaluate_sets(prompts, said.select("p_partkey", "sample", answer.alias("completion")), "p_partkey", 3, R.score_boxed)
    table_of = scoring.accuracy_by(scored, ["set_name"], "reward", "response_length")
    return table_of.select("set_name", *[F.round(c, 6).alias(c) for c in ("correct", "accuracy", "mean_length")], "total")


# ---------------------------------------------------------------- final numbers
GSM = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'so #### 1,' || (c_custkey % 900 + 100) || ' dollars'
 WHEN 1 THEN 'we get #### -' || c_custkey || '. Done 5.' WHEN 2 THEN 'no mark, only 3 and 4,' WHEN 3 THEN 'words only ' || c_mktsegment
 WHEN 4 THEN 'dots . and .' ELSE '#### ' || c_acctbal || ' or #### 7' END AS text,
 CASE c_custkey % 6 WHEN 0 THEN '1' || (c_custkey % 900 + 100) WHEN 1 THEN '5.' ELSE '7' END AS truth FROM {customer}"""
STRICT = "CASE WHEN regexp_matches(text, '#### (-?[0-9\\.,]+)') THEN replace(regexp_extract(text, '#### (-?[0-9\\.,]+)', 1), ',', '') ELSE 'none' END"
NUMS = "regexp_extract_all(text, '(-?[0-9\\.,]+)', 1)"
FLEX = f"coalesce([x for x in {NUMS} if x <> '.'][-1], {NUMS}[1], 'none')"


@query("extract_gsm_strict", f"SELECT c_custkey, {STRICT} AS answer FROM ({plain(GSM)})")
def extract_gsm_strict(spark, sf_dir):
    return bound(spark, sf_dir, GSM).select("c_custkey", F.coalesce(R.extract_gsm(F.col("text")), F.lit("none")).alias("answer"))


@query("extract_gsm_flexible", f"SELECT c_custkey, {FLEX} AS answer FROM ({plain(GSM)})")
def extract_gsm_flexible(spark, sf_dir):
    return bound(spark, sf_dir, GSM).select("c_custkey", F.coalesce(R.extract_gsm(F.col("text"), "flexible"), F.lit("none")).alias("answer"))


@query("score_gsm", f"""SELECT c_custkey, CASE WHEN {STRICT} = 'none' THEN 0 WHEN {STRICT} = truth THEN 1 ELSE 0.1::DOUBLE END AS strict,
CASE WHEN {FLEX} = 'none' THEN 0 WHEN {FLEX} = truth THEN 2 ELSE 0::DOUBLE END AS flexible FROM ({plain(GSM)})""")
def score_gsm(spark, sf_dir):
    x, t = F.col("text"), F.col("truth")
    return bound(spark, sf_dir, GSM).select("c_custkey", R.score_gsm(x, t, format_score=0.1).alias("strict"),
                                            R.score_gsm(x, t, "flexible", score=2.0).alias("flexible"))


# ---------------------------------------------------------------- boxed LaTeX answers
BOXES = [("so \\boxed{@}.", "@"), ("first \\boxed{1} then \\boxed{\\frac{@}{7}} end", "\\frac{@}{7}"), ("no box @", "FAIL"),
         ("we get $\\boxed @ apples$ ok", "@ apples"), ("\\fbox{@}", "FAIL"), ("\\boxed{open @", "FAIL"), ("\\boxed{a{b}{c@}}}", "a{b}{c@}")]


@query("extract_boxed_last", expected(answer=[b for _, b in BOXES], boxed_string=[
    "\\boxed{@}", "\\boxed{\\frac{@}{7}}", "FAIL", "\\boxed @ apples", "\\fbox{@}", "FAIL", "\\boxed{a{b}{c@}}"]))
def extract_boxed_last(spark, sf_dir):
    x = F.col("text")
    return bound(spark, sf_dir, rows(text=[a for a, _ in BOXES])).select(
        "p_partkey", shown(R.extract_boxed_last(x)).alias("answer"), shown(R.last_boxed_string(x)).alias("boxed_string"))


CLEANUPS = [("\\frac12", "\\frac{1}{2}"), ("  @ \\text{ cm}", "@"), ("x=@", "@"), ("0.5", "\\frac{1}{2}"), ("@/7", "\\frac{@}{7}"),
            ("\\sqrt@", "\\sqrt{@}"), ("\\frac@{72}", "\\frac{@}{72}"), (".2@", "0.2@"), ("\\left( @ \\right)", "(@)"), ("@^\\circ", "@"),
            ("@^{\\circ}\\%", "@"), ("\\tfrac{@}{3}\\!", "\\frac{@}{3}"), ("\\$@", "@"), ("abc = @", "abc=@"), ("a\nb@", "ab@"),
            ("\\text{ a}\\text{ b}@", "FAIL"), ("x/@", "FAIL"), ("\\frac@", "\\frac@"), ("{.@}", "{0.@}"), ("1\\\\@", "1\\@"),
            ("", ""), ("\\frac", "FAIL"), ("\\sqrt", "FAIL"), ("2/@/3", "2/@/3"), ("02/@", "02/@"), ("\\dfrac{@}2", "\\frac{@}2")]


@query("normalize_math", expected(strict=[b for _, b in CLEANUPS], lenient=[
    "x/@" if a == "x/@" else b for a, b in CLEANUPS]))
def normalize_math(spark, sf_dir):
    x = F.col("text")
    return bound(spark, sf_dir, rows(text=[a for a, _ in CLEANUPS])).select(
        "p_partkey", shown(R.normalize_math(x)).alias("strict"), shown(R.normalize_math(x, lenient=True)).alias("lenient"))


MATH = [("so \\boxed{@/7}", "\\frac{@}{7}", 1), ("so \\boxed{@}", "@0", 0), ("none", "@", 0), ("\\boxed{x/@}", "x/@", 1),
        ("\\boxed{0.5}", "\\frac12", 1), ("\\fbox{@}", "@", 0), ("\\boxed{\\text{ a}\\text{ b}}", "b", 0)]


@query("score_math", expected(score=[s for _, _, s in MATH]).replace("END AS score", "END::DOUBLE AS score"))
def score_math(spark, sf_dir):
    df = bound(spark, sf_dir, rows(text=[a for a, _, _ in MATH], truth=[b for _, b, _ in MATH]))
    return df.select("p_partkey", R.score_math(F.col("text"), F.col("truth")).alias("score"))


@query("score_by_source", f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {numbers([s for _, _, s in MATH])} ELSE CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END END::DOUBLE
AS score FROM part""")
def score_by_source(spark, sf_dir):
    text = case([a for a, _, _ in MATH])
    truth = case([b for _, b, _ in MATH])
    df = bound(spark, sf_dir, f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lighteval/MATH' ELSE 'openai/gsm8k' END AS source,
      CASE WHEN p_size % 2 = 0 THEN {text} ELSE '#### ' || p_size END AS text,
      CASE WHEN p_size % 2 = 0 THEN {truth} WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) ELSE 'x' END AS truth FROM {{part}}""")
    return df.select("p_partkey", R.score_by_source(F.col("source"), F.col("text"), F.col("truth")).alias("score"))


# ---------------------------------------------------------------- free-text answers
ANSWERS = [("Step 1. The answer is @.", "@.", 1), ("We get x. Therefore the answer: \\boxed{ @ }", "@", 1), ("So the total is @ apples", "@ apples", 1),
           ("No digits at all is here", "here", 0), ("@ is the answer", "@", 1), ("Values are 1 and @. Then stop", "1 and @", 1),
           ("ANSWER IS 3. then the answer: @\n", "@", 1), ("it can be\n@", "@", 1)]


@query("match_answer", expected(answer=[b for _, b, _ in ANSWERS], matched=[m for _, _, m in ANSWERS]))
def match_answer(spark, sf_dir):
    found = R.match_answer(F.col("text"))
    return bound(spark, sf_dir, rows(text=[a for a, _, _ in ANSWERS])).select(
        "p_partkey", found["answer"].alias("answer"), found["matched"].cast("int").alias("matched"))


WORDED = [("\\text{Yes}", "yes"), ("@ cm", "@"), ("\\$1,23@", "123@"), ("@ or 3", "@ , 3"), ("@ million", "@ *10^6"), ("{@}", "@"),
          ("7 @/4", "7+@/4"), ("ABC", "abc"), ("@.0", "@"), ("- @", "-@"), ("@ degrees", "@"), ("@%", "@"), ("@ meters^2", "@"),
          ("1,234,56@", "123456@"), ("1,234,567,89@", "1,234,567,89@"), ("x and y", "x , y"), ("@e3", "@000")]


@query("normalize_text_answer", expected(answer=[b for _, b in WORDED]))
def normalize_text_answer(spark, sf_dir):
    return bound(spark, sf_dir, rows(text=[a for a, _ in WORDED])).select("p_partkey", shown(R.normalize_text_answer(F.col("text"))).alias("answer"))


TUPLES = [("(1, @)", "1|@"), ("[ 1,@)", "1|@"), ("((1,2),@)", "((1,2),@)"), ("1,@", "1,@"), ("(1,00@)", "100@"), ("", ""), ("()", "()")]


@query("split_tuple", expected(parts=[b for _, b in TUPLES]))
def split_tuple(spark, sf_dir):
    return bound(spark, sf_dir, rows(text=[a for a, _ in TUPLES])).select("p_partkey", F.array_join(R.split_tuple(F.col("text")), "|").alias("parts"))


NUMERIC = [("50%", "0.5", 1), ("@", "@.00001", 1), ("$@", "@", 1), ("1,00@", "100@", 1), ("1@_8", "1@", 1), ("2\\pi", "6.2831853", 1),
           ("abc", "1", -1), ("3@", "9@9", 0), ("{,}1{,}00@", "100@", 1), ("@\\%", "@", 1), ("\\pi/2", "1.5707963", 1)]


@query("numeric_equal", expected(equal=[e for _, _, e in NUMERIC]))
def numeric_equal(spark, sf_dir):
    df = bound(spark, sf_dir, rows(a=[x for x, _, _ in NUMERIC], b=[y for _, y, _ in NUMERIC]))
    return df.select("p_partkey", F.coalesce(R.numeric_equal(F.col("a"), F.col("b")).cast("int"), F.lit(-1)).alias("equal"))


INTERVALS = [("Interval(1, @)", "[1, @]", 1), ("Interval.open(1,@)", "(1, @)", 1), ("(1, 2@)", "(2@, 1)", 0), ("[1.0, @]", "[1, @.0]", 1),
             ("1, @", "1.0,@", 1), ("{@}", "@", 1), ("Point(1, @)", "(1.0, @)", 0), ("[1, @]", "(1, @)", 0), ("Interval.Lopen(0, @)", "(0,@]", 1),
             ("[@]", "@", 1), ("x", "y", 0), ("((1),@)", "((1.0),@)", 1)]


@query("interval_equal", expected(equal=[e for _, _, e in INTERVALS]))
def interval_equal(spark, sf_dir):
    df = bound(spark, sf_dir, rows(a=[x for x, _, _ in INTERVALS], b=[y for _, y, _ in INTERVALS]))
    return df.select("p_partkey", F.coalesce(R.math_equal(F.col("a"), F.col("b")).cast("int"), F.lit(-1)).alias("equal"))


GRADES = [("@/8", "@/8", 1), ("2/4", "1/2", 0), ("0.5", "\\frac{1}{2}", 1), ("@.0", "@", 1), ("(1, @)", "(1,@)", 1), ("@.5", "@", 0), ("x+@", "x+@ ", 1),
          ("1@", "@2@", 0), ("(1.50, x)", "(1.5,x)", 1), ("[1, @]", "(1, @)", 0), ("Blue", "blue", 1), ("", "@", 0), ("abcd/2", "abce/2", 0)]


@query("grade_answer", expected(correct=[e for _, _, e in GRADES]))
def grade_answer(spark, sf_dir):
    df = bound(spark, sf_dir, rows(a=[x for x, _, _ in GRADES], b=[y for _, y, _ in GRADES]))
    return df.select("p_partkey", R.grade_answer(F.col("a"), F.col("b")).cast("int").alias("correct"))


GUARDS = [("x+y+@", 1), ("x+y+z", 0), ("2^{@}", 0), ("x^1@", 0), ("sqrt(x)+y", 1), ("2^3^@", 0), ("x^@", 1), ("2^(@)", 0)]


@query("symbolic_guard", expected(allowed=[e for _, e in GUARDS]))
def symbolic_guard(spark, sf_dir):
    return bound(spark, sf_dir, rows(text=[x for x, _ in GUARDS])).select("p_partkey", R.symbolic_guard(F.col("text")).cast("int").alias("allowed"))


LADDER = [("Step 2: so \\boxed{@}", "@", 1, 1), ("The answer is @0%", "0.@", 1, 0), ("the answer is @", "9@9", 0, 0), ("Step 2: it is \\boxed{7@7}", "@", 0, 1),
          ("we get 2\\pi", "6.2831853", 1, 0), ("so x is (1, @)", "(1.0,@)", 1, 1), ("the answer is 2_a @", "3@3", 0, 0), ("area is 3.14159\\pi", "9.86959", 1, 0)]


@query("score_math_ladder", expected(score=[s for _, _, s, _ in LADDER], format_ok=[f for _, _, _, f in LADDER])
    .replace("END AS score", "END::DOUBLE AS score"))
def score_math_ladder(spark, sf_dir):
    df = bound(spark, sf_dir, rows(a=[x for x, _, _, _ in LADDER], b=[y for _, y, _, _ in LADDER]))
    # a small file is one split and a row takes long; a given number is not put together again to fewer tasks than cores
    dealt = df.repartition(4 * spark.sparkContext.defaultParallelism, *df.columns)
    graded = dealt.select("p_partkey", R.math_verdict(F.col("a"), F.col("b")).alias("v"))
    return graded.select("p_partkey", F.col("v.correct").cast("double").alias("score"), F.col("v.format_ok").cast("int").alias("format_ok"))


EQUATIONS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_linenumber || ' * (' || CAST(l_quantity AS BIGINT)
 || ' - ' || (l_suppkey % 50) || ' + ' || (l_partkey % 30) || ') + ' || (l_orderkey % 9) AS equation FROM {lineitem}"""


@query("simplify_steps", f"""SELECT l_orderkey, equation, n * (q - l_suppkey % 50 + l_partkey % 30) + l_orderkey % 9 AS value,
CASE WHEN q - l_suppkey % 50 < 0 THEN 1 ELSE 0 END AS negative_partial FROM ({plain(EQUATIONS)})""")
def simplify_steps(spark, sf_dir):
    steps = bound(spark, sf_dir, EQUATIONS).withColumn("steps", arithmetic.simplify_steps(F.col("equation")))
    return steps.select("l_orderkey", "equation", F.element_at("steps", -1).cast("bigint").alias("value"),
                        F.when(F.rlike(F.get("steps", F.lit(1)), F.lit(r"\(-")), 1).otherwise(0).alias("negative_partial"))


LONG_EQUATIONS = """SELECT o_orderkey, o_custkey, o_orderkey || lpad(CAST(o_custkey AS STRING), 12, '0') || ' * ' || o_custkey || lpad(CAST(o_orderkey AS STRING), 12, '0')
 || ' - 12345678901234567890' AS equation FROM {orders}"""


@query("simplify_steps_long", f"""SELECT o_orderkey, equation, CAST((o_orderkey::HUGEINT * 1000000000000 + o_custkey) * (o_custkey::HUGEINT * 1000000000000 + o_orderkey)
 - 12345678901234567890::HUGEINT AS VARCHAR) AS value FROM ({plain(LONG_EQUATIONS)})""")
def simplify_steps_long(spark, sf_dir):
    """Products of 30 digits and more, beyond 64 bits at every step."""
    steps = bound(spark, sf_dir, LONG_EQUATIONS).select("o_orderkey", "equation", arithmetic.simplify_steps(F.col("equation")).alias("steps"))
    return steps.select("o_orderkey", "equation", F.element_at("steps", -1).alias("value"))
