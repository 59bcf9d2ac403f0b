"""Localization patterns: prediction, statistics and differences between phenotypes."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..dataset import SpatialDataset
from ..sources.scratch import materialize
from .point_features import analyze_points

#: Names and calibrated thresholds of the patterns, fixed values.
PATTERNS = ["cell_edge", "cytoplasmic", "none", "nuclear", "nuclear_edge"]
THRESHOLDS = [0.45300, 0.43400, 0.37900, 0.43700, 0.50500]
FEATURE_NAMES = ["proximity", "asymmetry", "ripley", "point_dispersion_norm", "shape_dispersion_norm"]


def feature_columns(instance: str, nucleus: str) -> list[str]:
    """The 13 inputs of a pattern model, in order."""
    return [
        f"{instance}_inner_proximity", f"{nucleus}_inner_proximity", f"{nucleus}_outer_proximity", f"{instance}_inner_asymmetry", f"{nucleus}_inner_asymmetry", f"{nucleus}_outer_asymmetry",
        "l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius", "point_dispersion_norm", f"{nucleus}_dispersion_norm",
    ]


#: From feature columns to a probability column for each pattern.
Model = Callable[[DataFrame, Sequence[str]], DataFrame]


def rule_model(instance: str, nucleus: str) -> Model:
    """A stand-in for a trained model, made of rules and NOT equivalent to any published one: scores between 0 and 1 from the same features."""

    def predict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
        edge, inner, outer = F.col(f"{instance}_inner_proximity"), F.col(f"{nucleus}_inner_proximity"), F.col(f"{nucleus}_outer_proximity")
        spread = F.col("point_dispersion_norm")
        scores = [clip(edge), clip(1 - inner) * clip(outer), clip(spread), clip(inner), clip(inner) * clip(outer)]
        return df.withColumns({f"{p}_p": s for p, s in zip(PATTERNS, scores)})

    return predict


def ml_model(models: dict[str, object], features_column: str = "features") -> Model:
    """A model of fitted binary classifiers of pyspark.ml, one for each pattern (PipelineModel.load reads them)."""

    def predict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        df = VectorAssembler(inputCols=list(columns), outputCol=features_column, handleInvalid="keep").transform(df)
        for p in PATTERNS:
            names = set(df.columns)
            df = models[p].transform(df)
            df = df.withColumn(f"{p}_p", vector_to_array("probability")[1]).select(*[c for c in df.columns if c in names], f"{p}_p")
        return df.drop(features_column)

    return predict


def threshold(probabilities: DataFrame, keys: Sequence[str], complete: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(lp, lpp): indicators (tinyint) and probabilities. Rows that are not complete have 0 everywhere."""
    ok = F.lit(True) if complete is None else complete
    p = {c: F.when(ok, F.coalesce(F.col(f"{c}_p"), F.lit(0.0))).otherwise(0.0) for c in PATTERNS}
    lpp = probabilities.select(*keys, *(p[c].alias(c) for c in PATTERNS))
    return probabilities.select(*keys, *(F.when(p[c] >= t, 1).otherwise(0).cast("tinyint").alias(c) for c, t in zip(PATTERNS, THRESHOLDS))), lpp


def lp(ds: SpatialDataset, model: Model, nucleus: str = "nucleus_boundaries", groupby: str | Sequence[str] | None = None) -> SpatialDataset:
    """Tables 'lp' and 'lpp' by instance and group, from the 13 features; warns of patterns that no row has."""
    instance = ds.attrs["instance_key"]
    groups = [ds.attrs["feature_key"]] if groupby is None else [groupby] if isinstance(groupby, str) else list(groupby)
    keys = [instance, *groups]
    name = "_".join([*keys, "features"])
    columns = feature_columns(instance, nucleus)
    if name not in ds.tables or any(c not in ds.tables[name].columns for c in columns):
        ds = analyze_points(ds, [instance, nucleus], FEATURE_NAMES, groups)
    table = ds.tables[name]
    complete = F.lit(True)
    for c in columns:
        complete &= F.col(c).isNotNull()
    found, probabilities = threshold(model(table, columns), keys, complete)
    seen = found.agg(*(F.max(c).alias(c) for c in PATTERNS)).first()
    if absent := [c for c in PATTERNS if not seen[c]]:
        warnings.warn(f"no {ds.attrs['feature_key']} has the patterns {absent}", UserWarning, stacklevel=2)
    return ds.with_table("lp", found).with_table("lpp", probabilities)


def lp_stats(found: DataFrame, probabilities: DataFrame, keys: Sequence[str], feature: str) -> tuple[DataFrame, DataFrame]:
    """Per feature the instances with each pattern; and by keys the likeliest pattern among those found, NULL if none (the first by name of equals)."""
    stats = found.groupBy(feature).agg(*(F.sum(c).cast("long").alias(c) for c in PATTERNS))
    p = probabilities.select(*keys, *(F.col(c).alias(f"{c}_p") for c in PATTERNS))
    joined = found.join(p, list(keys))
    best = F.array_max(F.array(*(F.when(F.col(c) > 0, F.struct(F.col(f"{c}_p").alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("name"))) for i, c in enumerate(PATTERNS))))
    return stats, joined.select(*keys, best["name"].alias("pattern"))


def annotate_points(points: DataFrame, top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points with the pattern of their instance and feature."""
    return points.drop("pattern").join(top, list(keys), "left")


def lp_logfc(found: DataFrame, phenotypes: DataFrame, instance: str, feature: str) -> DataFrame:
    """(feature, pattern, phenotype, log2fc): log2 of a phenotype's count + 1 to the mean of the other phenotypes' counts + 1. phenotypes: (instance, phenotype)."""
    long = found.join(phenotypes, instance).unpivot([instance, feature, "phenotype"], PATTERNS, "pattern", "value")
    sums = long.groupBy(feature, "pattern", "phenotype").agg(F.sum("value").cast("double").alias("n"))
    kinds = phenotypes.select("phenotype").filter(F.col("phenotype").isNotNull()).distinct()
    grid = found.select(feature).distinct().join(kinds)
    patterns = F.explode(F.array(*map(F.lit, PATTERNS))).alias("pattern")
    full = grid.select(feature, "phenotype", patterns).join(sums, [feature, "pattern", "phenotype"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    w = Window.partitionBy(feature, "pattern")
    rest = F.try_divide(F.sum("n").over(w) - F.col("n"), (F.count("*").over(w) - 1).cast("double"))
    return full.select(feature, "pattern", "phenotype", F.log2((F.col("n") + 1) / (rest + 1)).alias("log2fc"))


def logit_effects(x: np.ndarray, y: np.ndarray, iterations: int = 35) -> list[dict[str, float]] | None:
    """Average discrete effects of 0/1 columns in a logit model, with delta-method errors; None if the fit does not settle or is singular."""
    design = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(design.shape[1])
    for _ in range(iterations):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        info = (design * (mu * (1 - mu))[:, None]).T @ design
        if np.linalg.cond(info) > 1e12:
            return None
        step = np.linalg.solve(info, design.T @ (y - mu))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    else:
        return None
    if np.abs(beta).max() > 25:
        return None
    cov = np.linalg.inv(info)
    out = []
    for j in range(x.shape[1]):
        one, zero = design.copy(), design.copy()
        one[:, j], zero[:, j] = 1, 0
        p1, p0 = 1 / (1 + np.exp(-(one @ beta))), 1 / (1 + np.exp(-(zero @ beta)))
        effect = float((p1 - p0).mean())
        slope = ((p1 * (1 - p1))[:, None] * one - (p0 * (1 - p0))[:, None] * zero).mean(axis=0)
        err = math.sqrt(max(0.0, float(slope @ cov @ slope)))
        z = effect / err if err else math.nan
        p = math.erfc(abs(z) / math.sqrt(2)) if z == z else math.nan
        out.append({"dy/dx": effect, "std_err": err, "z": z, "pvalue": p, "ci_low": effect - 1.959963984540054 * err, "ci_high": effect + 1.959963984540054 * err})
    return out


def lp_diff_discrete(found: DataFrame, phenotypes: DataFrame, instance: str, feature: str) -> DataFrame | None:
    """Per feature, pattern and phenotype the marginal effect of the pattern on the odds of the phenotype, one against the rest.

    padj is the p-value times the number of features; -log10 of 0 is the greatest finite value. A numeric phenotype gives a
    warning and None. Features whose fit is singular or separable have no rows.
    """
    if isinstance(phenotypes.schema["phenotype"].dataType, T.NumericType):
        warnings.warn("a numeric phenotype; use lp_diff_continuous", UserWarning, stacklevel=2)
        return None
    kinds = sorted(r[0] for r in phenotypes.select("phenotype").distinct().collect() if r[0] is not None)
    fields = ["dy/dx", "std_err", "z", "pvalue", "ci_low", "ci_high"]
    schema = f"{feature} string, pattern string, phenotype string, " + ", ".join(f"`{f}` double" for f in fields)

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        used = [p for p in PATTERNS if frame[p].nunique() > 1]
        rows = []
        for kind in kinds:
            y = (frame["phenotype"] == kind).to_numpy(float)
            effects = logit_effects(frame[used].to_numpy(float), y) if used and 0 < y.mean() < 1 else None
            rows += [[group[0], p, kind, *(e[f] for f in fields)] for p, e in zip(used, effects or [])]
        return pd.DataFrame(rows, columns=[feature, "pattern", "phenotype", *fields])

    tested = found.join(phenotypes.filter(F.col("phenotype").isNotNull()), instance).select(feature, "phenotype", *PATTERNS)
    effects = tested.groupBy(feature).applyInPandas(run, schema)
    n = found.select(feature).distinct().count()
    out = effects.withColumn("padj", F.col("pvalue") * n)
    # One row a phenotype, of which the driver has listed all.
    minus = {name: F.when(F.col(name) > 0, -F.log10(name)) for name in ("pvalue", "padj")}
    out = materialize(out, "effects")
    most = out.groupBy("phenotype").agg(*(F.max(m).alias(f"__{name}") for name, m in minus.items()))
    out = out.join(F.broadcast(most), "phenotype")
    for name, m in minus.items():
        out = out.withColumn(f"-log10{'p' if name == 'pvalue' else name}", F.coalesce(m, F.when(F.col(name).isNotNull(), F.col(f"__{name}"))))
    out = out.drop("__pvalue", "__padj")
    return out.join(lp_logfc(found, phenotypes, instance, feature), [feature, "pattern", "phenotype"], "left").orderBy("pvalue")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from sums; NULL where a side is constant or there are fewer than two rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va > 1e-18) & (vb > 1e-18), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))


def lp_diff_continuous(probabilities: DataFrame, phenotypes: DataFrame, instance: str, feature: str) -> DataFrame:
    """(feature, pattern, pearson_correlation) between a pattern's probability and a value of the instance, over instances; greatest first."""
    long = probabilities.join(phenotypes, instance).unpivot([feature, "phenotype"], PATTERNS, "pattern", "value")
    out = long.groupBy(feature, "pattern").agg(correlation(F.col("value"), F.col("phenotype").cast("double")).alias("pearson_correlation"))
    return out.filter(F.col("pearson_correlation").isNotNull()).orderBy(F.desc("pearson_correlation"))
