"""The data behind each figure; drawing is left to the user's tools."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import PATTERNS
from .prep import with_shape_columns


def points_frame(points: DataFrame, cells: DataFrame, instance: str, variables: Sequence[str] = ()) -> DataFrame:
    """x, y, instance and variables; what points lack is looked up in the shapes by instance."""
    missing = [v for v in variables if v not in points.columns]
    own = points.select("x", "y", instance, *(v for v in variables if v in points.columns and v != instance))
    return with_shape_columns(own, cells, instance, missing) if missing else own


def hist2d(points: DataFrame, width: float) -> DataFrame:
    """(bx, by, n): points in squares of the given width."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("bigint")
    return points.groupBy(cell("x").alias("bx"), cell("y").alias("by")).agg(F.count("*").alias("n"))


def kde2d(points: DataFrame, width: float, bandwidth: float, reach: float = 3.0) -> DataFrame:
    """(bx, by, density): a Gaussian density on the squares' centres, from counts in squares; squares beyond reach x bandwidth are left out."""
    k = math.ceil(reach * bandwidth / width)
    counts = hist2d(points, width)
    total = counts.agg(F.sum("n").alias("total"))
    steps = F.sequence(F.lit(-k), F.lit(k))
    spread = counts.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    d2 = (F.col("dx") ** 2 + F.col("dy") ** 2) * width * width
    weight = F.exp(-d2 / (2 * bandwidth * bandwidth)) / (2 * math.pi * bandwidth * bandwidth)
    out = spread.groupBy((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by")).agg(F.sum(F.col("n") * weight).alias("v"))
    return out.join(total).select("bx", "by", (F.col("v") / F.col("total")).alias("density"))


def nearest_image(pixels: DataFrame, value: str, step: float) -> DataFrame:
    """(ix, iy, value): an image with pixels of width step; each has the value of the pixel nearest to its centre among those in it and around it."""
    step_c = F.lit(float(step))
    src = pixels.select("x", "y", value, F.floor(F.col("x") / step_c).alias("sx"), F.floor(F.col("y") / step_c).alias("sy"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    src = src.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    src = src.withColumn("ix", F.col("sx") + F.col("dx")).withColumn("iy", F.col("sy") + F.col("dy"))
    d2 = (F.col("x") - (F.col("ix") + 0.5) * step_c) ** 2 + (F.col("y") - (F.col("iy") + 0.5) * step_c) ** 2
    best = F.min_by(F.col(value), F.struct(d2, F.col("x"), F.col("y")))
    return src.groupBy(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy")).agg(best.alias(value))


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(ids), list(values), "variable", "value")


def quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """Interpolated percentiles q0, q25 ... of a value by group, NULLs left out."""
    p = F.percentile(value, F.array(*map(F.lit, map(float, levels))))
    out = df.groupBy(*by).agg(p.alias("__p"))
    return out.select(*by, *(F.col("__p")[i].alias(f"q{int(100 * q)}") for i, q in enumerate(levels)))


def entropy(columns: Sequence[str]) -> Column:
    """Shannon entropy in nats of the columns as shares of their sum; NULL if that is 0."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    out: Column = F.lit(0.0)
    for c in columns:
        p = F.try_divide(F.col(c), total)
        out = out + F.when(p > 0, -p * F.log(p)).otherwise(F.when(p.isNotNull(), 0.0))
    return out


def entropy_topn(df: DataFrame, key: str, columns: Sequence[str], n: int) -> DataFrame:
    """The n rows of lowest entropy, ties by key."""
    return df.select(key, entropy(columns).alias("entropy")).filter(F.col("entropy").isNotNull()).orderBy("entropy", key).limit(n)


def radviz(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, rx, ry): columns scaled to 0..1 pull to anchors on the unit circle; NULL where all are 0."""
    w = df.agg(*(F.min(c).alias(f"__lo_{c}") for c in columns), *(F.max(c).alias(f"__hi_{c}") for c in columns))
    df = df.join(w)
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")), F.lit(0.0)) for c in columns]
    total = sum(scaled, F.lit(0.0))
    m = len(columns)
    pull = lambda f: sum((s * f(2 * math.pi * i / m) for i, s in enumerate(scaled)), F.lit(0.0))
    return df.select(key, F.try_divide(pull(math.cos), total).alias("rx"), F.try_divide(pull(math.sin), total).alias("ry"))


def dimension_order(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns in a greedy order by cosine similarity, each next to the one most like it; one aggregate of column products."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    dot = {p: row[i] or 0.0 for i, p in enumerate(pairs)}
    dot |= {(b, a): v for (a, b), v in dot.items()}
    cosine = lambda a, b: dot[a, b] / math.sqrt(dot[a, a] * dot[b, b]) if dot[a, a] and dot[b, b] else 0.0
    left, out = list(columns), []
    while left:
        best = left[0] if not out else max(left, key=lambda c: cosine(out[-1], c))
        out.append(best)
        left.remove(best)
    return out


def upset_counts(found: DataFrame, min_share: float = 0.001) -> DataFrame:
    """(five indicators, degree, n): how often each combination of patterns occurs, at least min_share of all; by degree, then by pattern."""
    n = found.agg(F.count("*").alias("__all"))
    out = found.groupBy(*(F.col(p).cast("int").alias(p) for p in PATTERNS)).agg(F.count("*").alias("n")).join(n)
    degree = sum((F.col(p) for p in PATTERNS), F.lit(0))
    out = out.filter(F.col("n") >= F.lit(min_share) * F.col("__all")).select(*PATTERNS, degree.alias("degree"), "n")
    return out.orderBy("degree", *(F.desc(p) for p in PATTERNS))


def factor_loadings(factors: DataFrame, rank: int, mode: str, n: int = 5, self_pairs: bool = False) -> DataFrame:
    """(component, label, loading, rank_in): the n greatest loadings of each component of a mode; pairs of a feature with itself only on demand."""
    own = factors.filter((F.col("rank") == rank) & (F.col("mode") == mode))
    if mode == "pair" and not self_pairs:
        own = own.filter(F.split_part("label", F.lit("|"), F.lit(1)) != F.split_part("label", F.lit("|"), F.lit(2)))
    return top_n(own.select("component", "label", "loading"), ["component"], "loading", "label", n).withColumnRenamed("rank", "rank_in")


def lp_genes(found: DataFrame, table: DataFrame, instance: str, feature: str) -> DataFrame:
    """Per feature the share of instances with each pattern, log2 of the mean count + 1 and the share of instances that have it."""
    shares = found.groupBy(feature).agg(*(F.avg(F.col(p).cast("double")).alias(p) for p in PATTERNS))
    cells = table.agg(F.count_distinct(instance).alias("__cells"))
    counts = table.filter("n > 0").groupBy(feature).agg(F.log2(F.avg("n") + 1).alias("logcounts"), F.count_distinct(instance).alias("__n")).join(cells)
    return shares.join(counts.select(feature, "logcounts", (100 * F.col("__n") / F.col("__cells")).alias("cell_fraction")), feature)


def zscored(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value - mean) / population deviation in each group; NULL where that is 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = df.join(stats, list(by)) if by else df.join(stats)
    return joined.withColumn(out, F.when(F.col("__s") > 1e-12, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def top_n(df: DataFrame, by: Sequence[str], value: str, label: str, n: int) -> DataFrame:
    """The n greatest of each group, ties by label, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), label)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
