"""Reading rendered problems back: conditions, worked steps, audits and behaviour counts. Row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import simplify_steps
from ..functions.rewards import extract_boxed_first

# The wordings that the renderers use.
CONDITION = r"(?s)^The number of (.*?) equals(?: (-?\d+))?(?: (times|more than))?(?: the (sum|difference) of (.+)| (.+))?$"
QUESTION = r"(?s)^How many (.*) does (.*) have\?$"
STEP = r"^(?:Define (.*) as [a-zA-Z]\. So|- .*?number of (.*?)(?: is .*?| as .*?)?\. .*?(?:So|Then)) ([a-zA-Z] = .*)\.$"
UNKNOWN = r"(?m)^- .*(?:Wait, the number of|However, we don't know|But we haven't calculated)"
ANALYSIS, REMINDER, GOAL = r"We know that it equals", r"Remember that it has been denoted as", r"(?m)^- "
DIGIT = r"[0-9]"


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def parse_conditions(problems: DataFrame, query: str = "query") -> DataFrame:
    """One row per sentence of a query: at, name, rng, rng_op, inner_op, parents and whether it is the question.

    A sentence of another form has no name. Other columns are kept.
    """
    text = F.col("sentence")
    rows = problems.select(*[c for c in problems.columns if c != query], F.posexplode(F.split(query, r"\.\n")).alias("at", "sentence"))
    listed = _part(text, CONDITION, 5)
    asked = F.when(F.rlike(text, F.lit(QUESTION)), F.concat(F.regexp_extract(text, QUESTION, 2), F.lit("'s "), F.regexp_extract(text, QUESTION, 1)))
    parents = F.when(listed.isNotNull(), F.split(listed, ", | and ")).when(_part(text, CONDITION, 6).isNotNull(), F.array(_part(text, CONDITION, 6)))
    operation = F.when(_part(text, CONDITION, 3) == "times", "*").when(_part(text, CONDITION, 3) == "more than", "+")
    inner = F.when(_part(text, CONDITION, 4) == "difference", "-").when(_part(text, CONDITION, 4) == "sum", "+")
    return rows.select(*[c for c in rows.columns if c != "sentence"], F.coalesce(asked, _part(text, CONDITION, 1)).alias("name"),
                       _part(text, CONDITION, 2).cast("bigint").alias("rng"), operation.alias("rng_op"), inner.alias("inner_op"),
                       F.coalesce(parents, F.array().cast("array<string>")).alias("parents"), asked.isNotNull().cast("int").alias("is_question"))


def steps_of(response: Column) -> Column:
    """The step lines of an answer in order: (name, var, parts of its chain of equal expressions)."""
    lines = F.filter(F.split(response, "\n"), lambda x: F.rlike(x, F.lit(STEP)))

    def read(line):
        chain = F.split(F.regexp_extract(line, STEP, 3), " = ")
        return F.struct(F.concat(F.regexp_extract(line, STEP, 1), F.regexp_extract(line, STEP, 2)).alias("name"), F.get(chain, F.lit(0)).alias("var"),
                        F.slice(chain, F.lit(2), F.size(chain) - 1).alias("parts"))

    return F.transform(lines, read)


def trace_steps(answers: DataFrame, response: str = "response") -> DataFrame:
    """One row per step line: line_no, name, var and parts. Lines that calculate nothing are left out."""
    kept = [c for c in answers.columns if c != response]
    return answers.select(*kept, F.posexplode(steps_of(F.col(response))).alias("line_no", "s")).select(*kept, "line_no", "s.name", "s.var", "s.parts")


def with_values(part: Column, known: Column) -> Column:
    """The part with every variable that ``known`` (variable to value) holds replaced by its value."""
    pieces = F.regexp_extract_all(part, F.lit("([a-zA-Z]|[^a-zA-Z]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")


def trace_audit(answers: DataFrame, response: str = "response") -> DataFrame:
    """Per answer: steps, chains that do not give their value, steps that use a variable no earlier step defined, and
    whether the boxed answer is the last step's value.

    The steps are folded in order with the values stated so far. Every part of a chain, its variables replaced by the
    values earlier steps state for them (the latest counts), must come to the chain's own stated value; a part with an
    unknown variable only counts as undefined. A step without a stated number is broken. Numbers may have any length.
    """
    kept = [c for c in answers.columns if c != response]
    rows = answers.select(*kept, steps_of(F.col(response)).alias("steps"), extract_boxed_first(F.col(response)).alias("boxed"))
    start = F.struct(F.expr("cast(map() as map<string, string>)").alias("known"), F.lit(0).alias("broken"), F.lit(0).alias("undefined"))

    def step(acc, s):
        value = F.element_at(F.filter(s["parts"], lambda p: ~F.rlike(p, F.lit("[a-zA-Z]"))), -1)
        filled = F.transform(s["parts"], lambda p: with_values(p, acc["known"]))
        complete = F.filter(filled, lambda p: ~F.rlike(p, F.lit("[a-zA-Z]")))
        wrong = F.coalesce(F.exists(complete, lambda p: F.element_at(simplify_steps(p), -1) != value), F.lit(True))
        unknown = F.exists(filled, lambda p: F.rlike(p, F.lit("[a-zA-Z]")))
        others = F.map_filter(acc["known"], lambda k, _: k != s["var"])
        known = F.when(value.isNull(), acc["known"]).otherwise(F.map_concat(others, F.create_map(s["var"], value)))
        return F.struct(known.alias("known"), (acc["broken"] + wrong.cast("int")).alias("broken"), (acc["undefined"] + unknown.cast("int")).alias("undefined"))

    last = F.element_at(F.element_at("steps", -1)["parts"], -1)
    audited = rows.withColumn("audit", F.aggregate("steps", start, step))
    return audited.select(*kept, F.size("steps").alias("n_steps"), F.col("audit.broken").alias("n_broken"), F.col("audit.undefined").alias("n_undefined"),
                          F.coalesce(F.col("boxed") == last, F.lit(False)).cast("int").alias("final_ok"))


def behaviour_counts(answers: DataFrame, response: str = "response") -> DataFrame:
    """Per answer: lines taken up, premature attempts, restated conditions and reminders of a variable."""
    text = F.col(response)
    return answers.select(*[c for c in answers.columns if c != response], *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in (
        ("n_goals", GOAL), ("n_reflections", UNKNOWN), ("n_analyses", ANALYSIS), ("n_reminders", REMINDER))])
