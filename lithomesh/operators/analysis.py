"""Comparison of benchmark results: joins, outliers, summaries and significance tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithomesh.functions.distributions import chi2_tail, normal_quantile, normal_tail, t_two_sided
from lithomesh.plans.storage import materialise


def drop_columns(results: DataFrame, algorithms: list[str], features: list[str]) -> DataFrame:
    """Without the columns feature_algorithm."""
    return results.drop(*[f"{f}_{a}" for f in features for a in algorithms])


def rename_columns(results: DataFrame, names: dict[str, str], features: list[str]) -> DataFrame:
    """Columns feature_old to feature_new."""
    return results.withColumnsRenamed({f"{f}_{a}": f"{f}_{b}" for f in features for a, b in names.items()})


def join_results(left: DataFrame, right: DataFrame, on: str = "Name", suffixes: tuple[str, str] = ("_P", "_M")) -> DataFrame:
    """Inner join with suffixes for the columns that both have."""
    both = (set(left.columns) & set(right.columns)) - {on}
    marked = [frame.withColumnsRenamed({c: c + s for c in both}) for frame, s in zip((left, right), suffixes)]
    return marked[0].join(marked[1], on)


def common_scenes(first: DataFrame, second: DataFrame, on: str = "Name", order: str = "ID") -> DataFrame:
    """Of scenes in both frames the first row, without scenes that have exactly two rows in the first frame."""
    per = Window.partitionBy(on)
    ranked = first.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_r", F.row_number().over(per.orderBy(order)))
    return ranked.filter("_n <> 2 and _r = 1").drop("_n", "_r").join(second.select(on), on, "left_semi")


def fences(values: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Quartiles and the fences 1.5 interquartile ranges beyond them, for each group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    out = values.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return out.withColumn("low", F.col("q1") - 1.5 * iqr).withColumn("high", F.col("q3") + 1.5 * iqr)


def outliers(values: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows on or beyond the fences of their group."""
    limits = fences(values, column, by).drop("q1", "q3")
    joined = values.join(limits, by) if by else values.crossJoin(limits)  # one row of limits
    return joined.filter((F.col(column) >= F.col("high")) | (F.col(column) <= F.col("low"))).drop("low", "high")


def without_outliers(values: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are an outlier in none of the columns."""
    out = values
    for c in columns:
        limits = fences(values, c).select(F.col("low").alias(f"_low_{c}"), F.col("high").alias(f"_high_{c}"))
        out = out.crossJoin(limits)
    inside = F.lit(True)
    for c in columns:
        inside = inside & ~((F.col(c) >= F.col(f"_high_{c}")) | (F.col(c) <= F.col(f"_low_{c}")))
    return out.filter(inside).select(*values.columns)


def describe(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, mean, standard deviation and quartiles of each group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = values.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), q.alias("_q"))
    return out.select(*by, "n", "mean", "std", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def box(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (the outermost values inside the fences) and number of outliers of each group."""
    limits = fences(values, column, by)
    joined = values.join(limits, by)
    inside = (F.col(column) >= F.col("low")) & (F.col(column) <= F.col("high"))
    return joined.groupBy(*by, "q1", "q3").agg(
        F.percentile(column, 0.5).alias("median"), F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )


def latex_table(summary: list[dict], columns: list[str]) -> str:
    """Rows of a summary as the body of a LaTeX table."""
    return "\n".join(" & ".join(f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + r" \\" for r in summary)


def upper_median(column: str):
    """The middle value, the upper one of two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def robust_scale(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Upper median of each group, and 1.4826 times the upper median of the distances from it."""
    middle = values.groupBy(*by).agg(upper_median(column).alias("median"))
    away = values.join(middle, by).withColumn("_away", F.abs(F.col(column) - F.col("median")))
    return away.groupBy(*by, "median").agg((upper_median("_away") * 1.4826).alias("scale"))


def robust_inliers(values: DataFrame, column: str, by: list[str], limit: float = 2.5) -> DataFrame:
    """Rows less than ``limit`` robust deviations from their group's median."""
    scales = robust_scale(values, column, by)
    return values.join(scales, by).filter(F.abs(F.col(column) - F.col("median")) / (F.col("scale") + 1e-6) < limit).drop("median", "scale")


def pooled_t(values: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sample t statistic with pooled variance, and its degrees of freedom, in one row."""
    stats = values.agg(*[f(c).alias(f"{n}_{k}") for k, c in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / df
    return stats.select(((F.col("m_a") - F.col("m_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"), df.alias("degrees"))


def bartlett(values: DataFrame, a: str, b: str) -> DataFrame:
    """Bartlett's statistic for equal variances of two columns, in one row."""
    s = values.agg(*[f(c).alias(f"{n}_{k}") for k, c in (("a", a), ("b", b)) for n, f in (("n", F.count), ("v", F.var_samp))])
    da, db = F.col("n_a") - 1, F.col("n_b") - 1
    total = da + db
    pooled = (da * F.col("v_a") + db * F.col("v_b")) / total
    top = total * F.ln(pooled) - da * F.ln("v_a") - db * F.ln("v_b")
    return s.select((top / (1 + (1 / da + 1 / db - 1 / total) / 3)).alias("statistic"))


def running_total(values: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """The sum of ``amount`` over all rows up to each one by ``order``, whose values are all different.

    Rows are dealt out by ranges; only one total a range meets in one task.
    """
    ranged = materialise(values.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    inside = F.sum(amount).over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")


def mann_whitney(values: DataFrame, a: str, b: str) -> DataFrame:
    """U of the first column, and the z value with tie and continuity corrections, in one row.

    Ranks come from a running sum over the counts of distinct values.
    """
    both = values.select(F.col(a).alias("v"), F.lit(1).alias("is_a")).union(values.select(F.col(b), F.lit(0))).filter("v is not null")
    per = both.groupBy("v").agg(F.sum("is_a").alias("in_a"), F.count(F.lit(1)).alias("n"))
    ranked = running_total(per, "v", "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("in_a")).alias("r"), F.sum("in_a").alias("na"), F.sum(F.col("n") - F.col("in_a")).alias("nb"), F.sum(F.col("n") ** 3 - F.col("n")).alias("ties"))
    n = F.col("na") + F.col("nb")
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    mean = F.col("na") * F.col("nb") / 2
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), (F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / sd).alias("z"))


def shapiro_wilk(sample: list[float]) -> tuple[float, float]:
    """Shapiro-Wilk W and its p-value by Royston's approximations, for 3 to 5000 values."""
    x = sorted(sample)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    squares = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    c = [v / math.sqrt(squares) for v in m]
    poly = lambda k, x: sum(v * x**i for i, v in enumerate(k))
    w = [0.0] * n
    if n == 3:
        w[0], w[2] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        last = poly([c[-1], 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
        if n > 5:
            second = poly([c[-2], 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
            phi = (squares - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            inner = range(2, n - 2)
            w[1], w[-2] = -second, second
        else:
            phi = (squares - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            inner = range(1, n - 1)
        w[0], w[-1] = -last, last
        for i in inner:
            w[i] = m[i] / math.sqrt(phi)
    mean = sum(x) / n
    stat = min(1.0, sum(a * b for a, b in zip(w, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return stat, max(0.0, 6 / math.pi * (math.asin(math.sqrt(stat)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1e-300, 1 - stat))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return stat, 1e-99
        y = -math.log(g - y)
        mu, sigma = poly([0.5440, -0.39978, 0.025054, -6.714e-4], n), math.exp(poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        z = math.log(n)
        mu, sigma = poly([-1.5861, -0.31082, -0.083751, 0.0038915], z), math.exp(poly([-0.4803, -0.082676, 0.0030302], z))
    return stat, normal_tail((y - mu) / sigma)


def compare_variants(results: DataFrame, algorithm: str, feature: str, suffixes: tuple[str, str] = ("_P", "_M"), alpha: float = 0.05, reference_compat: bool = False) -> dict:
    """Whether two variants of an algorithm differ in a feature.

    After outliers of either column are gone, normal samples (Shapiro-Wilk) of equal
    variance (Bartlett) are compared by a pooled t test, others by Mann-Whitney.
    ``reference_compat`` reads small p-values of the first two tests as agreement.
    A benchmark has one row a scene; Shapiro-Wilk is defined for up to 5000 and
    takes the columns to the driver, the other tests send one row.
    """
    if len(suffixes) != 2:
        raise ValueError("two suffixes are needed")
    a, b = (f"{feature}_{algorithm}{s}" for s in suffixes)
    kept = without_outliers(results.select(F.col(f"`{a}`").cast("double").alias("a"), F.col(f"`{b}`").cast("double").alias("b")), ["a", "b"])
    n = kept.count()
    if n > 5000:
        raise ValueError("Shapiro-Wilk is defined for up to 5000 values")
    rows = kept.collect()
    agrees = (lambda p: p < alpha) if reference_compat else (lambda p: p >= alpha)
    normal = all(agrees(shapiro_wilk([r[c] for r in rows])[1]) for c in ("a", "b"))
    equal = normal and agrees(chi2_tail(bartlett(kept, "a", "b").first()["statistic"], 1))
    if equal:
        row = pooled_t(kept, "a", "b").first()
        test, p = "t", t_two_sided(row["t"], row["degrees"])
    else:
        test, p = "mann-whitney", min(1.0, 2 * normal_tail(mann_whitney(kept, "a", "b").first()["z"]))
    return {"n": n, "test": test, "p": p, "differs": p < alpha}
