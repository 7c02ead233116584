"""Rule rewards: answer extraction, normalisation and comparison as Spark expressions.

A value used several times is bound once with ``let`` (a one-element transform), so long clean-up chains stay
linear in size. A step that cannot be done gives null, which the callers treat as "normalisation failed".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Python-style strip removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008" \
             "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the layout a completion must have once the opening tag is put in front.
FORMAT_LAYOUT = r"(?smdU)\A<think>.*?</think>\s*<answer>.*?</answer>$"
# Phrases that introduce or follow an answer, in the order they are tried.
ANSWER_OPENERS = ["answer:", "answer is", "answers are"]
ANSWER_CLOSERS = ["is answer", "is the answer", "are answers", "are the answers"]
VALUE_OPENERS = ["be ", "is ", "are ", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
# Units dropped from a text answer, in the order they are tried.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year",
         "foot", "feet", "inch", "yard", "liter"]
# The two readings of pi an answer may use.
PI_VALUES = ["3.141592653589793", "3.14"]
# LaTeX symbols and how they read in a plain answer.
LATEX_SYMBOLS = [("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")]
# Data sources and the scorer of each.
GSM_SOURCES = ["openai/gsm8k"]
MATH_SOURCES = ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"]

_INT = r"(?U)^\s*[+-]?\d+(_\d+)*\s*\z"
_CANONICAL_INT = r"^(0|-?[1-9][0-9]*)\z"
_FLOAT = (r"(?iU)^\s*[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*\z")
_DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array_repeat(value, 1), body), 1)  # one value: array() copies its items twice


def let_each(step: Callable[[Column], Column], a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``step`` written once and applied to both values, then ``body`` of the two results."""
    return let(F.transform(F.array(a, b), lambda x: step(x)), lambda v: body(F.get(v, F.lit(0)), F.get(v, F.lit(1))))


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps applied in order, each result bound once."""
    for step in steps:
        value = let(value, step)
    return value


def strip(x: Column) -> Column:
    """Without white space at both ends; looked at first, since a trim compares each end with every such character."""
    return F.when(F.rlike(x, F.lit(r"(?s)^[!-~](.*[!-~])?\z")), x).otherwise(F.btrim(x, F.lit(WHITESPACE)))


def drop(x: Column, *texts: str) -> Column:
    for text in texts:
        x = F.replace(x, F.lit(text), F.lit(""))
    return x


def swap(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def has(x: Column, text: str) -> Column:
    return F.contains(x, F.lit(text))


def occurrences(x: Column, text: str) -> Column:
    return (F.length(x) - F.length(drop(x, text))) / F.lit(len(text))


def char(x: Column, i: int) -> Column:
    return F.substr(x, F.lit(i), F.lit(1))


def rest(x: Column, i: int) -> Column:
    return F.substr(x, F.lit(i))


def prefer_model_score(model: Column, rule: Column) -> Column:
    """A reward-model score replaces the rule score."""
    return F.coalesce(model, rule)


# ---------------------------------------------------------------- boxed integer answers
def extract_boxed_first(text: Column) -> Column:
    """First \\boxed{...} up to the first closing brace; null when there is none."""
    pattern = r"\\boxed\{([^}]*)\}"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def format_reward(completion: Column, prefix: str = "<think>") -> Column:
    return F.when(F.rlike(F.concat(F.lit(prefix), completion), F.lit(FORMAT_LAYOUT)), 1.0).otherwise(0.0)


def score_boxed(completion: Column, truth: Column, format_scale: float = 0.0) -> Column:
    """Exact match of the boxed text, plus a scaled format bonus (also for wrong answers)."""
    hit = F.coalesce((extract_boxed_first(completion) == truth.cast("string")).cast("double"), F.lit(0.0))
    return hit + F.lit(format_scale) * format_reward(completion) if format_scale > 0 else hit


# ---------------------------------------------------------------- final-number answers
def extract_gsm(text: Column, method: str = "strict") -> Column:
    """``strict``: the number after the first ``#### ``. ``flexible``: the last number-like token."""
    if method == "strict":
        pattern = r"#### (\-?[0-9\.\,]+)"
        return F.when(F.rlike(text, F.lit(pattern)), F.translate(F.regexp_extract(text, pattern, 1), ",$", ""))
    if method != "flexible":
        raise ValueError(f"unknown extraction {method!r}")
    tokens = F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    return let(tokens, lambda found: F.coalesce(
        F.try_element_at(F.filter(found, lambda t: t != "."), F.lit(-1)), F.try_element_at(found, F.lit(1))))


def score_gsm(text: Column, truth: Column, method: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    return let(extract_gsm(text, method), lambda a: F.when(a.isNull(), 0.0).when(a == truth, score).otherwise(format_score))


# ---------------------------------------------------------------- balanced braces
def _closing_length(tail: Column) -> Column:
    """Length of ``tail`` up to the brace that closes its first group; null when it never closes."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s, piece):
        close = F.endswith(piece, F.lit("}"))
        depth = s["d"] + F.when(close, -1).otherwise(1)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("d"), (s["n"] + F.length(piece)).alias("n"),
                                                       (close & (depth == 0)).alias("done")))

    return F.aggregate(F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0)), start, step,
                       lambda s: F.when(s["done"], s["n"]))


def _box_tail(text: Column) -> Column:
    def tail(mark):
        return F.concat(F.lit(mark), F.substring_index(text, mark, -1))
    return F.when(has(text, "\\boxed"), tail("\\boxed")).when(has(text, "\\fbox"), tail("\\fbox"))


def last_boxed_string(text: Column) -> Column:
    """The last \\boxed or \\fbox with its balanced group; the ``\\boxed `` form runs to the next ``$``."""
    balanced = let(_box_tail(text), lambda t: F.substr(t, F.lit(1), _closing_length(t)))
    spaced = F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1))
    return F.when(has(text, "\\boxed "), spaced).otherwise(balanced)


def unbox(boxed: Column) -> Column:
    """Content of a boxed string; null when it is not of a \\boxed form."""
    spaced = F.when(F.startswith(boxed, F.lit("\\boxed ")), rest(boxed, 8))
    braced = F.when(F.startswith(boxed, F.lit("\\boxed{")) & F.endswith(boxed, F.lit("}")),
                    F.substr(boxed, F.lit(8), F.length(boxed) - 8))
    return F.when(has(boxed, "\\boxed "), spaced).otherwise(braced)


def extract_boxed_last(text: Column) -> Column:
    return let(last_boxed_string(text), unbox)


def boxed_group(text: Column) -> Column:
    """Content of the first balanced group after the last box mark, stripped; null when there is none."""
    def inside(t):
        return let(F.substr(t, F.lit(1), _closing_length(t)), lambda s: strip(
            F.substr(s, F.instr(s, "{") + 1, F.length(s) - F.instr(s, "{") - 1)))
    return let(_box_tail(text), inside)


# ---------------------------------------------------------------- LaTeX clean-up
def fix_sqrt(x: Column) -> Column:
    return F.when(~has(x, "\\sqrt"), x).when(F.rlike(x, F.lit(r"\\sqrt(\\sqrt|\z)")), F.lit(None)).otherwise(
        F.regexp_replace(x, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}"))


def fix_fracs(x: Column) -> Column:
    """\\frac1b and friends get braces. An empty tail fails; a one-character tail leaves the text as it is."""
    def braces(p):
        head = F.concat(F.lit("{"), char(p, 1), F.lit("}"))
        return (F.when(F.startswith(p, F.lit("{")), p)
                .when(char(p, 2) == "{", F.concat(head, rest(p, 2)))
                .otherwise(F.concat(head, F.lit("{"), char(p, 2), F.lit("}"), rest(p, 3))))

    def rebuild(parts):
        tails = F.slice(parts, F.lit(2), F.size(parts))
        short = F.try_element_at(F.filter(tails, lambda p: (F.length(p) < 2) & (p != "{")), F.lit(1))
        fixed = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(tails, braces)), "\\frac")
        return F.when(short.isNull(), fixed).when(short == "", F.lit(None)).otherwise(x)

    return F.when(has(x, "\\frac"), let(F.split(x, r"\\frac", -1), rebuild)).otherwise(x)


def fix_a_slash_b(x: Column, lenient: bool = False) -> Column:
    """a/b of two integers as \\frac{a}{b}. Non-integers fail, or pass through when ``lenient``."""
    a, b = F.substring_index(x, "/", 1), F.substring_index(x, "/", -1)
    canonical = F.rlike(a, F.lit(_CANONICAL_INT)) & F.rlike(b, F.lit(_CANONICAL_INT))
    integers = F.rlike(a, F.lit(_INT)) & F.rlike(b, F.lit(_INT))
    frac = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
    return (F.when(occurrences(x, "/") != 1, x).when(canonical, frac)
            .when(integers | F.lit(lenient), x))


def normalize_math(text: Column, lenient: bool = False) -> Column:
    """LaTeX answer clean-up; null when a step fails."""
    def prefix(x):
        return F.when((occurrences(x, "=") == 1) & (F.length(F.substring_index(x, "=", 1)) <= 2),
                      F.substring_index(x, "=", -1)).otherwise(x)

    def after_units(x):
        filled = chain(
            x,
            lambda s: F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s),
            prefix, fix_sqrt, lambda s: drop(s, " "), fix_fracs,
            lambda s: F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s),
            lambda s: fix_a_slash_b(s, lenient))
        return F.when(x == "", F.lit("")).otherwise(filled)

    return chain(
        text,
        lambda s: swap(drop(s, "\n", "\\!"), "\\\\", "\\"),
        lambda s: drop(swap(swap(s, "tfrac", "frac"), "dfrac", "frac"), "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"),
        lambda s: F.when(occurrences(s, "\\text{ ") <= 1, F.substring_index(s, "\\text{ ", 1)),
        lambda s: swap(swap(drop(s, "\\%"), " .", " 0."), "{.", "{0."),
        after_units)


def math_equivalent(a: Column, b: Column) -> Column:
    """Equal after clean-up; raw equality when a clean-up fails; two nulls are equal, one null is not."""
    def compare(p, q):
        return let_each(normalize_math, p, q, lambda np, nq: F.when(p.isNull() & q.isNull(), True)
                        .when(p.isNull() | q.isNull(), False)
                        .when(np.isNull() | nq.isNull(), p == q).otherwise(np == nq))
    return let_each(lambda x: x, a, b, compare)


def score_math(text: Column, truth: Column) -> Column:
    return let(extract_boxed_last(text), lambda a: F.when(a.isNotNull() & math_equivalent(a, truth), 1.0).otherwise(0.0))


# ---------------------------------------------------------------- scorer registry
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(source: str, scorer: Callable[[Column, Column], Column]) -> None:
    """Plug in a scorer (text, truth) -> score for a data source; native columns or a pandas UDF."""
    SCORERS[source] = scorer


for _source in GSM_SOURCES:
    register_scorer(_source, score_gsm)
for _source in MATH_SOURCES:
    register_scorer(_source, score_math)


def score_by_source(source: Column, text: Column, truth: Column,
                    scorers: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """Score by data source; an unknown source is an error."""
    out = None
    for name, scorer in (scorers or SCORERS).items():
        value = scorer(text, truth).cast("double")
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), source)).cast("double"))


def reward_manager(name: str, format_scale: float = 0.0) -> Callable[..., Column]:
    """Scorer family by name, called with (text, truth, source). Validation uses ``format_scale=0``."""
    # fixed values: the family names
    families = {
        "naive": lambda text, truth, source: score_by_source(source, text, truth),
        "igsm": lambda text, truth, source=None: score_boxed(text, truth, format_scale),
        "eurus2": lambda text, truth, source=None: score_math_ladder(text, truth),
    }
    if name not in families:
        raise NotImplementedError(f"unknown reward manager {name!r}")
    return families[name]


# ---------------------------------------------------------------- free-text answers
def match_answer(response: Column) -> dict[str, Column]:
    """Where the answer of a free-text response is: {matched, answer}."""
    def cut_at(s, marks, kept):
        """Mark by mark; a text without the mark goes on as it is."""
        def cut(v, mark):
            behind = F.length(F.call_function("substring_index", v["l"], mark, F.lit(-1)))
            return F.when(F.contains(v["l"], mark), _state(strip(kept(v, mark, behind)), F.lit(True))).otherwise(v)
        return F.aggregate(F.array(*[F.lit(mark) for mark in marks]), s, cut)

    def after(s, marks):
        return cut_at(s, marks, lambda v, mark, behind: F.substr(v["r"], F.length(v["r"]) - behind + 1))

    def before(s, marks):
        return cut_at(s, marks, lambda v, mark, behind: F.substr(v["r"], F.lit(1), F.length(v["l"]) - behind - F.length(mark)))

    def box(v):
        return F.when(has(v["r"], "\\boxed") | has(v["r"], "\\fbox"), let(boxed_group(v["r"]), lambda b: (
            F.when(F.length(b) > 0, _state(b, F.lit(True))).otherwise(v)))).otherwise(v)

    def sentence(v):
        kept = F.length(v["r"]) - F.length(F.substring_index(v["r"], ". ", -1)) - 2
        return F.when(has(v["r"], ". "), _state(strip(F.substr(v["r"], F.lit(1), kept)), v["m"])).otherwise(v)

    state = before(after(_state(response, F.lit(False)), ANSWER_OPENERS), ANSWER_CLOSERS)
    state = after(_bind(_bind(state, box), sentence), VALUE_OPENERS)
    matched = let(state, lambda v: F.when(v["r"].isNotNull(), v["m"] & F.rlike(v["r"], F.lit(_DIGIT))))
    return {"matched": matched, "answer": state["r"]}


def _state(text: Column, matched: Column) -> Column:
    """Text, its lower case (looked at for every mark) and whether a mark was found."""
    return F.struct(text.alias("r"), F.lower(text).alias("l"), matched.alias("m"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return let(value, lambda v: body(v))


def py_float(x: Column) -> Column:
    """Number as a lenient float parser reads it; null when it is not one."""
    return let(x, lambda s: F.when(F.rlike(s, F.lit(_FLOAT)), drop(strip(s), "_").try_cast("double")))


def _near_int(x: Column) -> Column:
    finite = F.abs(x) < F.lit(float("inf"))
    return F.coalesce(finite & (F.abs(x - F.rint(x)) <= 1e-7), F.lit(False))


def _int_text(x: Column) -> Column:
    """Whole number as text; beyond 38 digits the shortest digits of the double, filled up with zeros."""
    wide = F.when(F.abs(x) < F.lit(float("inf")), F.format_string("%.0f", x))
    return F.coalesce(x.try_cast("decimal(38,0)").cast("string"), wide)


def strip_commas(x: Column) -> Column:
    """Drop thousands commas pass by pass until nothing changes (a pass eats the character after the group)."""
    passes = F.sequence(F.lit(0), occurrences(x, ",").cast("int"))
    return F.when(has(x, ","), F.aggregate(
        passes, x, lambda s, _: F.regexp_replace(s, r"(?Ud)(\d)(,)(\d\d\d)($|\D)", "$1$3$4"))).otherwise(x)


def is_int_text(x: Column) -> Column:
    return let(py_float(strip_commas(x)), _near_int)


def is_fraction(x: Column) -> Column:
    return F.rlike(x, F.lit(r"(?d)^-?[0-9]+.?/0*[1-9][0-9]*.?$"))


def unwrap_text(x: Column) -> Column:
    pattern = r"(?d)^\\text\{(.+?)\}$"
    return F.when(F.startswith(x, F.lit("\\text{")) & F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, 1)).otherwise(x)


def normalize_answer(x: Column) -> Column:
    """Strip, unwrap \\text{} and clean up leniently; a failed clean-up keeps the unwrapped text."""
    return chain(strip(x), lambda s: let(unwrap_text(s), lambda u: F.when(u == s, s).otherwise(strip(u))),
                 lambda s: F.coalesce(normalize_math(s, lenient=True), s))


def plain_latex(x: Column) -> Column:
    """Simple LaTeX as plain text: fractions, roots and the symbols an answer uses; null when more is left."""
    def symbols(s):
        for written, read in LATEX_SYMBOLS:
            s = swap(s, written, read)
        return F.when(~has(s, "\\"), strip(drop(s, "{", "}")))

    return chain(
        x,
        lambda s: F.regexp_replace(s, r"\\[td]?frac\{([^{}]*)\}\{([^{}]*)\}", " $1/$2"),
        lambda s: F.regexp_replace(s, r"\\sqrt\{([^{}]*)\}", "sqrt($1)"), symbols)


def normalize_text_answer(x: Column, latex_to_text: Callable[[Column], Column] = plain_latex) -> Column:
    """Normal form of a worded answer. ``latex_to_text`` turns remaining LaTeX into plain text, null to leave it."""
    def without_units(s):
        for unit in UNITS:
            s = F.regexp_replace(s, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
        return F.regexp_replace(s, r"\^ *\\circ", "")

    def units(s):  # one look for any of them; most answers have none
        return F.when(F.rlike(s, F.lit("|".join([*UNITS, r"\^ *\\circ"]))), without_units(s)).otherwise(s)

    def braces(s):
        return F.when(F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)

    def whole(s):
        return let(py_float(s), lambda v: F.when(_near_int(v), let(F.rint(v), _int_text)).otherwise(s))

    def latex(s):
        return F.when(has(s, "\\"), F.coalesce(latex_to_text(s), s)).otherwise(s)

    def integer(s):
        return F.when(is_int_text(s), let(let(py_float(drop(s, ",")), _truncate), _int_text)).otherwise(s)

    return chain(
        x, unwrap_text,
        lambda s: drop(swap(swap(s, "\\%", "%"), "\\$", "$"), "$", "%"),
        lambda s: swap(swap(s, " or ", " , "), " and ", " , "),
        lambda s: swap(swap(swap(s, "million", "*10^6"), "billion", "*10^9"), "trillion", "*10^12"),
        units, braces, lambda s: F.when(has(s, ",\\!"), F.regexp_replace(s, r",\\! *", "")).otherwise(s), whole, latex,
        lambda s: F.when(has(s, " "), F.regexp_replace(F.regexp_replace(s, "- *", "-"), "([0-9]) +([0-9])", "$1+$2")).otherwise(s),
        F.lower, integer)


def _truncate(x: Column) -> Column:
    whole = F.when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))
    return F.when(F.abs(x) < F.lit(2.0**53), whole).otherwise(x)  # larger doubles are whole, and past 2^63 a long is not


def split_tuple(x: Column) -> Column:
    """Elements of a bracketed tuple without inner brackets; anything else is one element."""
    def parts(s):
        inner = F.substr(s, F.lit(2), F.length(s) - 2)
        bracketed = (F.length(s) > 2) & F.rlike(s, F.lit(r"(?s)^[()\[\]].*[()\[\]]\z")) & ~F.rlike(inner, F.lit(r"[()\[\]]"))
        return (F.when(s == "", F.array().cast("array<string>"))
                .when(bracketed, F.transform(F.split(inner, ",", -1), strip)).otherwise(F.array(s)))
    return let(strip_commas(x), parts)


# ---------------------------------------------------------------- numeric and structural comparison
def digit_value(x: Column) -> Column:
    return py_float(F.when(has(x, "{,}"), drop(x, "{,}")).otherwise(drop(x, ",")))


def close(a: Column, b: Column, rel_tol: float = 1e-4) -> Column:
    return (a == b) | ((F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)))
                       & (F.abs(a - b) < F.lit(float("inf"))))


_PLAIN_NUMBER = r"~?(?:\d+(?:\.\d*)?|\.\d+)"


def _flat_arithmetic(x: Column) -> Column:
    """Value of sums of products, quotients and powers of numbers without parentheses; ``~`` is a number's own minus."""
    power = rf"(?:{_PLAIN_NUMBER})(?:\s*\^\s*(?:{_PLAIN_NUMBER}))?"
    shape = rf"^\s*-?\s*{power}(?:\s*[*/+-]\s*{power})*\s*\z"
    factors = rf"([*/]?)\s*({_PLAIN_NUMBER})(?:\s*\^\s*({_PLAIN_NUMBER}))?"

    def number(v):
        return F.replace(v, F.lit("~"), F.lit("-")).cast("double")

    def term(t):
        body = F.regexp_replace(t, r"^\s*[+-]", "")
        sign = F.when(F.rlike(t, F.lit(r"^\s*-")), -1.0).otherwise(1.0)
        parts = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(factors), F.lit(g)).alias(n) for g, n in ((1, "o"), (2, "v"), (3, "e"))])
        steps = F.transform(parts, lambda f: F.struct(f["o"].alias("o"), F.when(f["e"] == "", number(f["v"])).otherwise(
            F.pow(number(f["v"]), number(f["e"]))).alias("v")))
        product = F.aggregate(steps, F.lit(1.0), lambda s, f: F.when(f["o"] == "/", F.try_divide(s, f["v"])).otherwise(s * f["v"]))
        return sign * product

    terms = F.transform(F.regexp_extract_all(x, F.lit(r"(\s*[+-]?[^+-]+)"), F.lit(1)), term)
    return F.when(F.rlike(x, F.lit(shape)), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


def plain_arithmetic(x: Column) -> Column:
    """Value of an expression of plain numbers with + - * / ^ and parentheses; null for anything else.

    Parentheses are replaced by their values from the innermost out, one a pass.
    """
    def fold(s, _):
        parts = F.split(F.regexp_replace(s, r"(?s)^(.*)\(([^()]*)\)(.*)$", "$1\u0001$2\u0001$3"), "\u0001", -1)

        def put(p):
            value = _flat_arithmetic(F.get(p, F.lit(1)))
            text = F.concat(F.when(value < 0, "~").otherwise(""), F.format_string("%.15f", F.abs(value)))
            return F.when(F.size(p) == 3, F.coalesce(F.concat(F.get(p, F.lit(0)), text, F.get(p, F.lit(2))), F.lit("?"))).otherwise(F.get(p, F.lit(0)))

        return F.when(has(s, "("), let(parts, put)).otherwise(s)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(occurrences(x, "(").cast("int"), F.lit(1))), x, fold)
    return F.when(~has(x, "~") & ~has(x, "\u0001"), let(F.when(has(x, "("), folded).otherwise(x), _flat_arithmetic))


def _with_pi(x: Column, pi: Column) -> Column:
    """\\pi as a factor: after a digit it multiplies, elsewhere it stands for 1 times pi."""
    written = F.regexp_replace(F.regexp_replace(x, F.lit(r"(?U)(?<=\d)\\pi"), F.concat(F.lit("*"), pi)),
                               F.lit(r"\\pi"), F.concat(F.lit("1*"), pi))
    return F.when(has(x, "\\pi"), let(written, lambda s: F.coalesce(plain_arithmetic(s).cast("string"), s))).otherwise(x)


def normalize_number(x: Column, pi: Column | None = None) -> Column:
    """Dollar and percent signs, base suffix and pi; null when a base suffix follows a non-number."""
    def base(s):
        return let(py_float(F.substring_index(s, "_", 1)), lambda v: _int_text(_truncate(v)))
    return (F.when(F.rlike(x, F.lit(r"(?U)^\$\d+(\.\d+)?")), rest(x, 2))
            .when(F.rlike(x, F.lit(r"(?Ud)^\d+(\.\d+)?\\?%$")), drop(x, "\\%", "%"))
            .when(has(x, "_"), base(x)).otherwise(_with_pi(x, F.lit(PI_VALUES[0]) if pi is None else pi)))


def numeric_equal(prediction: Column, reference: Column, pi: Column | None = None, percentage: bool = True) -> Column:
    """Both numbers and close to each other, allowing a factor of 100 either way; null when one is no number."""
    return let_each(lambda x: digit_value(normalize_number(x, pi)), prediction, reference,
                    lambda p, r: _close_numbers(p, r, percentage))


def _close_numbers(p: Column, r: Column, percentage: bool = True) -> Column:
    scales = F.array(*[F.lit(k) for k in ((1.0, 0.01, 100.0) if percentage else (1.0,))])
    return F.when(p.isNotNull() & r.isNotNull(), F.exists(scales, lambda k: close(F.when(k == 0.01, r / 100).otherwise(r * k), p)))


def format_interval(x: Column) -> Column:
    """Interval(...), .open, .Lopen, .Ropen as bracket text."""
    out = None
    for name, left, right in (("Interval", "[", "]"), ("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"),
                              ("Interval.open", "(", ")")):
        pattern = "(?d)^" + name.replace(".", r"\.") + r"\((.*)\)$"
        value = F.concat(F.lit(left), F.regexp_extract(x, pattern, 1), F.lit(right))
        hit = F.rlike(x, F.lit(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(F.startswith(x, F.lit("Interval")), out.otherwise(x)).otherwise(x)


def math_equal(prediction: Column, reference: Column, pi: Column | None = None, depth: int = 1,
               symbolic: Callable[[Column, Column], Column] | None = None) -> Column:
    """Text, numeric and structural equality; ``symbolic`` may decide the rest (default: not equal).

    Null when a number normalisation fails. Elements hold no commas after one split, so what nesting is left is layers of
    equal brackets, which are taken off together however many there are.
    """
    return let_each(lambda x: normalize_number(x, pi), prediction, reference,
                    lambda p, r: _rungs(p, r, depth, symbolic))


def _rungs(p, r, depth, symbolic):
    text = (F.lower(strip(p)) == F.lower(strip(r))) | (drop(p, " ") == drop(r, " "))
    numeric = let_each(digit_value, p, r, _close_numbers)
    shape = F.struct(let(strip(p), format_interval).alias("p"), strip(r).alias("r"))
    structural = let(shape, lambda s: _structure(s["p"], s["r"], depth, symbolic))
    return F.when(p.isNull() | r.isNull(), F.lit(None)).when(text, True).otherwise(
        F.coalesce(numeric, F.when(p == "", False).otherwise(structural)))


def _structure(p, r, depth, symbolic):
    def starts(x, t):
        return F.startswith(x, F.lit(t))

    def ends(x, t):
        return F.endswith(x, F.lit(t))

    def bare(x):
        return drop(x, "{", "}", "(", ")")

    def trimmed(x):
        return F.btrim(x, F.lit("[]()"))

    unbracket = (starts(p, "[") & ends(p, "]") & ~starts(r, "(")) | (starts(p, "(") & ends(p, ")") & ~starts(r, "["))
    same = F.when(unbracket, bare(trimmed(p)) == bare(trimmed(r))).otherwise(bare(p) == bare(r))
    if depth == 0:
        leaf = same | F.coalesce(_layers_equal(p, r), F.lit(False))
        return leaf if symbolic is None else leaf | symbolic(p, r)

    def inner(x):
        return F.split(F.substr(x, F.lit(2), F.length(x) - 2), ",", -1)

    def all_equal(pair):
        each = F.zip_with(pair["a"], pair["b"], lambda x, y: F.coalesce(
            math_equal(x, y, depth=depth - 1, symbolic=symbolic), F.lit(False)))
        return F.when(F.size(pair["a"]) == F.size(pair["b"]), F.forall(each, lambda v: v))

    def pair_when(condition, a, b):
        return F.when(condition, F.struct(a.alias("a"), b.alias("b")))

    bracketed = (F.rlike(p, F.lit(r"(?s)^[(\[].*[)\]]\z")) & (char(p, 1) == char(r, 1)) & (F.right(p, F.lit(1)) == F.right(r, F.lit(1))))
    elements = [F.transform(F.split(x, ",", -1), strip) for x in (p, r)]
    point_parts = F.split(F.substr(p, F.instr(p, "(") + 1, F.length(p) - F.instr(p, "(") - 1), ",", -1)
    # one element-wise comparison over the three ways to take the answers apart
    ways = F.array(pair_when(bracketed, inner(p), inner(r)),
                   pair_when(has(p, ",") & has(r, ","), *elements),
                   pair_when(starts(p, "Point") & starts(r, "(") & ends(r, ")"), point_parts, inner(r)))
    last = F.lit(False) if symbolic is None else symbolic(p, r)
    return F.when(same, True).otherwise(let(F.transform(ways, all_equal), lambda v: (
        F.when(F.get(v, F.lit(0)), True).when(F.get(v, F.lit(1)).isNotNull(), F.get(v, F.lit(1)))
        .when(F.get(v, F.lit(2)), True).otherwise(last))))


def _layers_equal(p: Column, r: Column) -> Column:
    """Numbers inside the same layers of brackets are close."""
    def layers(x):
        text = drop(x, " ")
        return F.struct(F.regexp_extract(text, r"^[(\[]*", 0).alias("a"), F.regexp_extract(text, r"[)\]]*$", 0).alias("z"),
                        F.btrim(text, F.lit("()[]")).alias("core"))

    return let_each(layers, p, r, lambda x, y: F.when((x["a"] == y["a"]) & (x["z"] == y["z"]) & (F.length(x["a"]) == F.length(x["z"])),
                                                      let_each(digit_value, x["core"], y["core"], _close_numbers)))


# ---------------------------------------------------------------- grading ladder
def symbolic_guard(x: Column) -> Column:
    """Whether an expression is simple enough for a symbolic check: at most two letters, no odd powers."""
    letters = F.array_distinct(F.regexp_extract_all(drop(x, "sqrt", "frac"), F.lit(r"(\p{L})"), F.lit(1)))
    odd = has(x, "^{") | has(x, "^(") | F.rlike(x, F.lit(r"\^[0-9]+\^|\^[0-9][0-9]+"))
    return (F.size(letters) <= 2) & ~odd


def grade_answer(given: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None = None) -> Column:
    """Normal forms equal, or element-wise: fractions as text, an integer truth exactly, else symbolically.

    Without a ``symbolic`` plug-in the last rung accepts equal text and equal plain arithmetic.
    """
    def element(t, g):
        equal = (t == g) | F.coalesce(let_each(plain_arithmetic, t, g, lambda x, y: x == y), F.lit(False))
        if symbolic is not None:
            equal = equal | symbolic(t, g)
        guard = symbolic_guard(F.concat(F.lit("("), t, F.lit(")-("), g, F.lit(")")))
        return (F.when(is_fraction(t) & is_fraction(g), t == g)
                .when(let_each(is_int_text, t, g, lambda x, y: x != y), False).otherwise(guard & equal))

    def by_elements(t, g):
        def check(ts, gs):
            edges = (char(t, 1) != char(g, 1)) | (F.right(t, F.lit(1)) != F.right(g, F.lit(1)))
            return (F.when((F.size(ts) > 1) & edges, False).when(F.size(ts) != F.size(gs), False)
                    .otherwise(F.forall(F.zip_with(ts, gs, element), lambda v: v)))
        return let_each(split_tuple, t, g, check)

    simple = let_each(normalize_answer, truth, given, lambda t, g: t == g)
    full = let_each(normalize_text_answer, truth, given, lambda t, g: F.when(t == g, True).when(g == "", False)
                    .otherwise(by_elements(t, g)))
    return F.coalesce(F.when(given.isNull(), False).when(simple, True).otherwise(full), F.lit(False))


def math_verdict(text: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct(correct, format_ok, answer) of a free-text solution. Take its fields in a later projection: a column that is
    read field by field in the same one is worked out once a field."""
    truth = truth.cast("string")

    def grade(a):
        readings = F.array(*[F.lit(v) for v in PI_VALUES])
        tried = F.when(has(a, "\\pi") | has(truth, "\\pi"), readings).otherwise(F.slice(readings, 1, 1))
        compared = F.exists(tried, lambda pi: F.coalesce(math_equal(a, truth, pi=pi, symbolic=symbolic), F.lit(False)))
        laid_out = has(text, "Step 2:") & has(text, "\\box")
        rung = F.when(grade_answer(a, truth, symbolic), 2).when(compared, 1).otherwise(0)  # graded once for both fields
        return let(rung, lambda n: F.struct((n > 0).alias("correct"), (laid_out | (n == 2)).alias("format_ok"), a.alias("answer")))

    return let(match_answer(text)["answer"], grade)


def evaluate_math(text: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None = None) -> dict[str, Column]:
    """The fields of ``math_verdict`` by name."""
    result = math_verdict(text, truth, symbolic)
    return {name: result[name] for name in ("correct", "format_ok", "answer")}


def score_math_ladder(text: Column, truth: Column, symbolic: Callable[[Column, Column], Column] | None = None) -> Column:
    return evaluate_math(text, truth, symbolic)["correct"].cast("double")
