"""Quality rules and robust multivariate outliers.

Text statistics are computed row by row. Per language and source, location and scatter of the transformed statistics
are estimated by the minimum covariance determinant: from a start of medians and median deviations, concentration
steps refit mean and covariance to the ``SUPPORT`` share of rows with the smallest Mahalanobis distances, each of
which lowers the determinant. Rows beyond ``CUT`` are rejected. Only counts and sums per group are ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, whole_text, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a group's rows that the concentration steps fit, number of steps, fewest rows for an estimate of its own.
SUPPORT, STEPS, MIN_ROWS = 0.75, 4, 200
#: Squared distance beyond which a row is rejected (chi-squared, 4 degrees of freedom, about 1 in 10^8).
CUT = 42.0
CHI2_MEDIAN = 3.3567
#: Transformed statistics and the smallest standard deviation each can have.
STATS = {"s_length": 0.5, "s_word": 0.15, "s_symbols": 0.15, "s_repeats": 0.25}
BINS_PER_UNIT = 64
DISTANCE_BINS_PER_UNIT = 32


def with_text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_lines. Row-local.

    Null is empty text; a text without words has zeros. Repeated windows are found by sorting 64-bit window hashes.
    """
    words = F.array_remove(F.split(F.col("__text"), SPACE), "")
    a = df.withColumn("__text", whole_text(text)).withColumn("__words", words)
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    a = (a.withColumn("n_words", F.size("__words").cast("long"))
         .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
         .withColumn("n_symbols", F.regexp_count(F.col("__text"), F.lit(r"[#*$%&|<>]")).cast("long"))
         .withColumn("__lines", lines)
         .withColumn("n_lines", F.size("__lines").cast("long"))
         .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")))
    hashes = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    a = a.withColumn("__hash", hashes)
    ordered = F.when(F.size(F.array_distinct("__hash")) < F.size("__hash"), F.sort_array(
        F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    a = a.withColumn("__sorted", ordered)
    twice = F.filter("__sorted", lambda s, i: F.coalesce(F.get("__sorted", i - 1)["h"] == s["h"], F.lit(False))
                     | F.coalesce(F.get("__sorted", i + 1)["h"] == s["h"], F.lit(False)))
    a = a.withColumn("__starts", F.sort_array(F.transform(twice, lambda s: s["i"])))
    covered = F.aggregate(F.transform("__starts", lambda p, i: F.coalesce(
        F.least(F.lit(WINDOW), F.get("__starts", i + 1) - p), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "__text", "__words", "__lines", "__hash", "__sorted", "__starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def with_vector(df: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of length, word length, symbols and repetition per word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (df.withColumn("s_length", F.log1p(F.col("n_words").cast("double")))
            .withColumn("s_word", F.log1p(F.col("word_chars") / n))
            .withColumn("s_symbols", F.log1p(F.col("n_symbols") * 10.0 / n))
            .withColumn("s_repeats", F.log1p(F.col("n_repeat_words") * 10.0 / n)))


def with_group(df: DataFrame, source: str, lang: str, min_rows: int) -> DataFrame:
    """``__group``: language and source where they have ``min_rows`` sound rows, else the language, else everything.

    ``__fits`` lists the groups whose estimate a row belongs to: its own, and its language's and everything's where some
    group falls back on them, so that a fallback rests on all sound rows of its level.
    """
    sizes = df.groupBy(lang, source).agg(F.count_if(~F.col("base_failed")).alias("__n"))
    by_lang = Window.partitionBy(lang)
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    own, of_lang, of_all = name(F.col(lang).alias("a"), F.col(source).alias("b")), name(F.col(lang).alias("a")), F.lit("all")
    sized = sizes.withColumn("__m", F.sum("__n").over(by_lang)).withColumn("__level", F.when(F.col("__n") >= min_rows, 0).when(F.col("__m") >= min_rows, 1).otherwise(2))
    sized = written(sized.withColumn("__lends", F.max(F.col("__level") == 1).over(by_lang)), "quality-levels")
    falls = sized.agg(F.max("__level")).first()[0] == 2
    fits = F.array_compact(F.array(F.when(F.col("__level") == 0, own), F.when(F.col("__lends"), of_lang), F.lit("all" if falls else None).cast("string")))
    chosen = sized.select(F.struct(F.col(lang).alias("a"), F.col(source).alias("b")).alias("__of"),
                          F.when(F.col("__level") == 0, own).when(F.col("__level") == 1, of_lang).otherwise(of_all).alias("__group"), fits.alias("__fits"))
    chosen = written(chosen, "quality-groups")
    keyed = df.withColumn("__key", F.struct(F.col(lang).alias("a"), F.col(source).alias("b")))
    return keyed.join(chosen, F.col("__key") == F.col("__of")).drop("__key", "__of")


def group_quantile(rows: DataFrame, keys: Sequence[str], bin_column: str, share: float) -> DataFrame:
    """Lowest bin (``cut``) below or in which ``share`` of a group's rows lie; exact over the bins."""
    counts = rows.groupBy(*keys, bin_column).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys)
    running = F.sum("__c").over(group.orderBy(bin_column).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("__run", running).withColumn("__all", F.sum("__c").over(group))
    return reached.where(F.col("__run") >= F.col("__all") * share).groupBy(*keys).agg(F.min(bin_column).alias("cut"))


def medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Median of every value per group, to 1/``BINS_PER_UNIT``: one row (__group, map of names)."""
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.round(v * BINS_PER_UNIT).cast("long").alias("bin")) for k, v in values.items()])
    long = rows.select("__group", F.explode(listed).alias("v")).select("__group", "v.k", "v.bin")
    cuts = group_quantile(long, ["__group", "k"], "bin", 0.5)
    return cuts.groupBy("__group").pivot("k", list(values)).agg(F.first(F.col("cut") / float(BINS_PER_UNIT)))


def cholesky(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the factor l_i_j of the covariance c_i_j, column by column."""
    for j, _ in enumerate(names):
        for i in range(j, len(names)):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}"))
    keep = ["__group", *[f"m_{i}" for i in range(len(names))], *[f"l_{i}_{j}" for j in range(len(names)) for i in range(j, len(names))]]
    return params.select(F.col("__group").alias("__of"), *keep[1:])


def with_distance(rows: DataFrame, factors: DataFrame, names: Sequence[str], out: str, how: str = "inner", *more: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution; ``more`` names further columns of ``factors`` to keep."""
    joined = rows.join(factors, F.col("__group") == F.col("__of"), how)
    total = F.lit(0.0)
    for i, name in enumerate(names):
        z = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            z = z - F.col(f"l_{i}_{j}") * F.col(f"__z{j}")
        joined = joined.withColumn(f"__z{i}", z / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"__z{i}") * F.col(f"__z{i}")
    return joined.withColumn(out, total).select(*rows.columns, out, *more)


def distance_bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * DISTANCE_BINS_PER_UNIT)


def moments(rows: DataFrame, names: Sequence[str], floors: Sequence[float]) -> DataFrame:
    """Mean and covariance per group; the floors keep it positive definite."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)]]
    sums += [F.sum(F.col(a) * F.col(names[j])).alias(f"q{i}_{j}") for i, a in enumerate(names) for j in range(i + 1)]
    table = rows.groupBy("__group").agg(*sums)
    for i in range(len(names)):
        table = table.withColumn(f"m_{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(len(names)):
        for j in range(i + 1):
            c = F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
            table = table.withColumn(f"c_{i}_{j}", F.greatest(c, F.lit(0.0)) + floors[i] ** 2 if i == j else c)
    return table


def fit_scatter(rows: DataFrame, floors: dict[str, float], support: float, steps: int) -> DataFrame:
    """Robust location and scatter of every ``__group``: (__of, m_i, l_i_j, scale), one narrow row a group."""
    names, least = list(floors), list(floors.values())
    middle = written(medians(rows, {n: F.col(n) for n in names}), "quality-median").select(
        F.col("__group").alias("__of"), *[F.col(n).alias(f"__m{i}") for i, n in enumerate(names)])
    centred = rows.join(middle, F.col("__group") == F.col("__of")).drop("__of")
    spread = medians(centred, {n: F.abs(F.col(n) - F.col(f"__m{i}")) for i, n in enumerate(names)})
    spread = spread.join(middle, F.col("__group") == F.col("__of"))
    start = spread.select("__group", *[F.col(f"__m{i}").alias(f"m_{i}") for i in range(len(names))], *[
        (F.pow(F.col(names[i]) * 1.4826, F.lit(2.0)) + least[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}")
        for i in range(len(names)) for j in range(i + 1)])
    factors = written(cholesky(start, names), "quality-factor")
    for _ in range(steps):
        near = with_distance(rows, factors, names, "__d2").withColumn("__bin", distance_bin(F.col("__d2")))
        cuts = written(group_quantile(near, ["__group"], "__bin", support), "quality-cut").withColumnRenamed("__group", "__in")
        inner = near.join(cuts, F.col("__group") == F.col("__in")).where(F.col("__bin") <= F.col("cut"))
        factors = written(cholesky(moments(inner, names, least), names), "quality-factor")
    measured = with_distance(rows, factors, names, "__d2").withColumn("__bin", distance_bin(F.col("__d2")))
    half = group_quantile(measured, ["__group"], "__bin", 0.5)
    # the scatter of the inner rows is widened so that the median distance is that of a normal sample, never narrowed
    widened = half.select("__group", F.least(CHI2_MEDIAN / F.pow(F.lit(2.0), (F.col("cut") + 1) / float(DISTANCE_BINS_PER_UNIT)),
                                             F.lit(1.0)).alias("scale"))
    return written(factors.join(widened, F.col("__group") == F.col("__of")).drop("__group"), "quality-scatter")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
          support: float = SUPPORT, steps: int = STEPS, min_rows: int = MIN_ROWS, cut: float = CUT) -> DataFrame:
    """Per row: key, the statistics, ``distance``, ``base_failed`` and ``kept``.

    Null text is empty; null source or language is a group of its own; groups under ``min_rows`` sound
    rows use the estimate of all sound rows of their language or of everything. Rows that fail a base rule stay out of the estimates and are
    never kept. Repeated rows count as often as they occur. Other columns are ignored. An empty table gives none.
    """
    named = only(df, key, text, source, lang).toDF("__id", "__body", "__source", "__lang")
    stats = written(with_text_stats(named, "__body").drop("__body").withColumn("base_failed", base_failed()), "quality-stats")
    rows = with_vector(with_group(stats, "__source", "__lang", min_rows))
    names = list(STATS)
    sound = rows.where(~F.col("base_failed")).select(F.explode("__fits").alias("__group"), *names)
    scatter = fit_scatter(sound, STATS, support, steps)
    scored = with_distance(rows.drop("__fits"), scatter, names, "__d2", "left", "scale").withColumn("distance", F.col("__d2") * F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return scored.withColumn("kept", kept).select(F.col("__id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                  "n_repeat_words", "n_lines", "distance", "base_failed", "kept")
