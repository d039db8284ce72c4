"""Statistics as Column expressions, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and for each name the value at rank round((n - 1) share), from 0, halves away from zero; nulls don't count.

    Values are counted first, so what is ordered for a key is its distinct values, not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("__c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"__upto": upto, "__n": F.sum("__c").over(whole)})
    rank = lambda q: F.floor((F.col("__n") - 1) * F.lit(q) + 0.5)
    at = [F.min(F.when(F.col("__upto") > rank(q), F.col(value))).alias(name) for name, q in shares.items()]
    return counts.groupBy(*keys).agg(F.sum("__c").alias("n"), *at)


def date_quantile_lower(column: str, parts: int) -> Column:
    """The date of a column at rank floor((n - 1) / parts): a tenth for 10. For such shares it is percentile_disc, which
    merges partial results instead of collecting the group."""
    return F.expr(f"date_from_unix_date(percentile_disc({1 / parts!r}) WITHIN GROUP (ORDER BY unix_date({column})))")


def safe_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation over rows where both are known; null under `least` rows or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(F.when(both, F.lit(1))) >= least, F.covar_pop(a, b) / F.nullif(scale, F.lit(0.0)))


def fisher_bounds(r: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Fisher's interval for a correlation; nulls for n <= 3 or |r| >= 1."""
    ok = (n > 3) & (F.abs(r) < 1)
    half = F.lit(z) / F.sqrt(F.when(ok, n - 3))
    at = F.atanh(F.when(ok, r))
    return F.tanh(at - half), F.tanh(at + half)


def share(condition: Column, digits: int = 3) -> Column:
    """Rounded share of rows where condition holds; unknown counts as not."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), digits)
