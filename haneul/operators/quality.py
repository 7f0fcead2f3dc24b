"""Checks of tables before they are used: rules by row, coverage, freshness, identities between figures.

A failing row is never dropped here: rules are columns, and checks return the rows or groups
that fail. `require` turns a check into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import is_month, month_index


def judge(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `failed`: the names of the rules that a row doesn't meet. A rule that is unknown (null) isn't met."""
    return df.withColumn("failed", F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull()))


def report(judged: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that fail each rule."""
    found = judged.select(F.explode("failed").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
    names = judged.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(F.broadcast(found), "rule", "left").na.fill(0, ["rows"])  # at most a row per rule


def require(failures: DataFrame, what: str) -> None:
    """Raise, with a few examples, if there is a failure."""
    rows = failures.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def observation_rules() -> dict[str, Column]:
    total = F.col("breakdown") == "total"
    bare = F.col("category").isNull() | (F.col("category") == "")
    return {"period": is_month(F.col("period")), "category": F.when(total, bare).otherwise(~bare), "value": F.col("value").isNotNull()}


def is_page_url(url: Column) -> Column:
    """A page for people, not an endpoint for machines."""
    host, path = F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return url.rlike("^https?://") & ~host.rlike(r"^(sdmx|api)\.") & ~path.rlike(r"/(rest/data|api)/")


def uncovered(df: DataFrame, expected: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Expected (source, keys) that a source's newest period lacks."""
    newest = df.groupBy(source).agg(F.max("period").alias("period"))
    there = df.join(newest, [source, "period"], "left_semi").select(source, *keys).distinct()
    return expected.join(there, [source, *keys], "left_anti")


def stale(df: DataFrame, today: str, months: int, keys: list[str]) -> DataFrame:
    """Months behind today of each key's newest period, where they are more than allowed."""
    behind = F.lit(int(today[:4]) * 12 + int(today[5:7]) - 1) - month_index(F.max("period"))
    return df.groupBy(*keys).agg(F.max("period").alias("newest"), behind.alias("behind")).where(F.col("behind") > months)


def parts_sum(df: DataFrame, keys: list[str], parts: str, tolerance: float) -> DataFrame:
    """Keys whose total differs from the sum of a breakdown's categories by more than the tolerance."""
    sums = df.where(F.col("breakdown").isin("total", parts)).groupBy(*keys).agg(F.sum(F.when(F.col("breakdown") == "total", F.col("value"))).alias("total"), F.sum(F.when(F.col("breakdown") == parts, F.col("value"))).alias("parts"))
    return sums.where(F.col("total").isNull() | F.col("parts").isNull() | (F.abs(F.col("total") - F.col("parts")) > tolerance))


def disagreeing(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Keys that both have with values further apart than the tolerance."""
    other = b.select(*keys, F.col("value").alias("other"))
    return a.select(*keys, "value").join(other, keys).where(F.abs(F.col("value") - F.col("other")) > tolerance)


def newest_shared(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """The newest period that both have, and whether they agree there."""
    both = a.select("period", "value").join(b.select("period", F.col("value").alias("other")), "period")
    at = both.agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"), F.max_by("other", "period").alias("other"))
    return at.withColumn("agrees", F.abs(F.col("value") - F.col("other")) <= tolerance)


def rate_fits(level: Column, delta: Column, rate: Column) -> Column:
    """A printed rate fits a level and its change within 0.5 points or a quarter of it."""
    made = delta * 100 / F.nullif(level - delta, F.lit(0.0))
    return F.abs(made - rate) <= F.greatest(F.lit(0.5), F.abs(rate) * 0.25)


def quotient_fits(part: Column, whole: Column, ratio: Column, tolerance: float = 0.01) -> Column:
    return F.abs(part / F.nullif(whole, F.lit(0.0)) - ratio) <= tolerance


def gate(errors: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """A verdict per name: an error passes while it is listed as known and its deadline hasn't passed;
    a name that is listed but works again fails, so that the list is kept short."""
    j = errors.withColumn("_e", F.lit(True)).join(known, "name", "full")
    verdict = F.when(F.col("_e").isNull(), "recovered").when(F.col("deadline").isNull(), "error").when(F.col("deadline") < today, "expired").otherwise("known")
    return j.select("name", verdict.alias("verdict"), verdict.isin("known").alias("passes"))


def blocked_too_long(state: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Sources blocked for `days` days or more in a row."""
    return state.withColumn("blocked_days", F.date_diff(F.to_date(F.lit(today)), F.to_date("since"))).where(F.col("blocked_days") >= days)


def high_missing(rates: DataFrame, allowed: DataFrame, keys: list[str], rate: float = 0.5, least: int = 10) -> DataFrame:
    """Groups of `least` rows or more that lack too much, but for those allowed to."""
    return rates.where((F.col("rate") >= rate) & (F.col("total") >= least)).join(allowed, keys, "left_anti")


def tables_in_order(tables: DataFrame, keys: list[str], least_level: float = 10_000, most_delta: float = 1_000) -> DataFrame:
    """Tables (tab, value) that only their order tells apart: the first is the level, the second the change, a
    third the rate. A row per document with their places and what speaks against them: too few tables, a level
    too small, a change too large, or a rate that doesn't follow from both."""
    first = W.partitionBy(*keys).orderBy("tab")
    top = tables.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= 3)
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    made = top.groupBy(*keys).agg(*(at(k, c).alias(f"{n}{s}") for k, n in ((1, "level"), (2, "delta"), (3, "rate")) for c, s in (("tab", "_tab"), ("value", ""))))
    problem = F.when(F.col("delta_tab").isNull(), "too few").when(F.col("level").isNull() | (F.col("level") < least_level), "level").when(F.col("delta").isNull() | (F.abs("delta") >= most_delta), "change")
    return made.withColumn("problem", problem.when(F.col("rate_tab").isNotNull() & ~F.coalesce(rate_fits(F.col("level"), F.col("delta"), F.col("rate")), F.lit(False)), "order"))


def hypothesis_rules() -> dict[str, Column]:
    """A confirmed record rests on evidence, and a hypothesis names at least one counter-hypothesis."""
    return {"evidence": (F.col("status") != "confirmed") | (F.size(F.coalesce("evidence", F.array())) > 0), "counter": F.size(F.coalesce("counter", F.array())) > 0}


def link_rules() -> dict[str, Column]:
    """A test of what comes first needs monthly figures, and a lag is read in such a test only."""
    precedence = F.coalesce(F.col("timing") == "precedence", F.lit(False))
    return {"monthly": ~precedence | (F.col("grain") == "month"), "lag": precedence | F.coalesce(F.col("lag") == "", F.lit(True))}


def skipped_or_failed(judged: DataFrame, cutoff_rule: str) -> tuple[DataFrame, DataFrame]:
    """Of judged rows those that only fall to the cutoff, which are skipped, and those that fail otherwise, which are errors."""
    only = (F.size("failed") == 1) & F.array_contains("failed", cutoff_rule)
    return judged.where(only), judged.where((F.size("failed") > 0) & ~only)
