"""Answering questions: what can be asked of which source, what may be compared, what a number rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mantissa

#: How far two sources may be compared, the most careful first.
RANKS = ("불가", "증감률만", "수준")
#: Years with their parts, cohorts, and terms; they name something and aren't figures. A bare number
#: that a unit follows is no year.
UNIT = "[천만억]|명|건|원|가구|곳|%"
PERIOD = rf"(?<![A-Za-z0-9_])(19|20)\d{{2}}(년|[-–]\d{{1,2}}|S[12]|H[12]|Q[1-4]|(?!{UNIT}))(?![A-Za-z0-9_])"
COHORT = r"(?<![\d.,])(?:\d+\s*[~\-–]\s*\d+세|\d+세\s*(?:이상|미만|이하|초과)?|\d+대)"
TERM = r"(?<![\d.,])\d+(?:분기|반기|월|년)"
NUMBER = r"([-−+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-−+]?\d+(?:\.\d+)?)"


def figures(text: Column) -> Column:
    """The figures that a text states, as an array of doubles; names of periods, cohorts and terms aren't figures."""
    bare = text
    for pattern in (PERIOD, COHORT, TERM):
        bare = F.regexp_replace(bare, pattern, " ")
    found = F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), "[−]", "-").cast("double"))


def verify(answers: DataFrame, text: str, allowed: str) -> DataFrame:
    """Answers with `outside`: figures that the evidence doesn't hold, and of these `notation`: those that are an
    allowed figure in another unit (the same digits), and `made_up`: the others."""
    own = answers.withColumn("outside", F.array_except(F.array_distinct(figures(F.col(text))), F.col(allowed)))
    digits = F.transform(F.col(allowed), mantissa)
    same = lambda x: F.array_contains(digits, mantissa(x))
    return own.withColumns({"notation": F.filter("outside", same), "made_up": F.filter("outside", lambda x: ~same(x))})


def slots(questions: DataFrame, text: str, dictionary: dict[str, str], kind: str) -> DataFrame:
    """questions with the entry of the longest word of the dictionary that their text, without white space, holds;
    of equally long ones the first in order."""
    bare = F.regexp_replace(F.col(text), r"(?U)\s+", "")
    words = sorted(dictionary, key=lambda w: (-len(w.replace(" ", "")), w))
    found = F.coalesce(*[F.when(bare.contains(w.replace(" ", "")), F.lit(dictionary[w])) for w in words]) if words else F.lit(None).cast("string")
    return questions.withColumn(kind, found)


def route(questions: DataFrame, capability: DataFrame) -> DataFrame:
    """(q, topic, axes) by sources of the topic: possible, partial or impossible, with the axes that are lacking.
    A source of another topic isn't an answer and isn't listed. Sources are a small catalogue."""
    j = questions.join(capability.select("source", "has_axes", F.explode(F.array_distinct("topics")).alias("topic")), "topic")
    lacking = F.array_except("axes", "has_axes")
    state = F.when((F.size("axes") > 0) & (F.size(F.array_intersect("axes", "has_axes")) == 0), "impossible").when(F.size(lacking) > 0, "partial").otherwise("possible")
    return j.select("q", "source", state.alias("state"), F.array_join(F.array_sort(lacking), ",").alias("lacking"))


def comparable(pairs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Pairs (a, b) with how far they may be compared: the most careful of what is recorded, in either direction;
    a pair without record may not be."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("level")) - 1
    known = conflicts.select(F.least("source_a", "source_b").alias("lo"), F.greatest("source_a", "source_b").alias("hi"), rank.alias("rank"), "kind")
    worst = known.groupBy("lo", "hi").agg(F.min("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    j = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(worst, ["lo", "hi"], "left")
    level = F.element_at(F.array(*map(F.lit, RANKS)), (F.coalesce("rank", F.lit(0)) + 1).cast("int"))
    return j.select("a", "b", level.alias("level"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def both_ends(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Conflicts whose both ends are among the ids."""
    i = ids.select("id").distinct()
    return conflicts.join(i.withColumnRenamed("id", "source_a"), "source_a", "left_semi").join(i.withColumnRenamed("id", "source_b"), "source_b", "left_semi")


def verdicts(hypotheses: DataFrame, links: DataFrame, indicators: DataFrame) -> DataFrame:
    """Whether each hypothesis (id, grain) can be judged: it has falsifying indicators and the data of all of them
    is held; strength is weak if one has another grain or compares by rate only."""
    falsify = links.where("role = 'falsifies'").join(indicators, "indicator", "left").select("hypothesis", "indicator", "held", F.col("grain").alias("i_grain"), "rate_only")
    j = hypotheses.join(falsify, hypotheses["id"] == falsify["hypothesis"], "left")
    n, lacking, weak = F.count("indicator"), F.count_if(F.col("indicator").isNotNull() & ~F.coalesce("held", F.lit(False))), F.count_if((F.col("i_grain") != F.col("grain")) | F.col("rate_only"))
    made = j.groupBy("id").agg(n.alias("n_falsify"), lacking.alias("n_missing"), weak.alias("n_weak"))
    capable = (F.col("n_falsify") > 0) & (F.col("n_missing") == 0)
    return made.select("id", "n_falsify", "n_missing", capable.alias("capable"), F.when(capable, F.when(F.col("n_weak") > 0, "weak").otherwise("strong")).alias("strength"), F.when(F.col("n_falsify") == 0, "no falsifier").when(F.col("n_missing") > 0, "data not held").alias("blocked_by"))


def evidence(hypotheses: DataFrame, links: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per hypothesis its indicators by role, and how many are held."""
    j = links.join(indicators, "indicator", "left")
    roles = j.groupBy("hypothesis", "role").agg(F.array_join(F.array_sort(F.collect_set(F.col("indicator").cast("string"))), ",").alias("indicators"), F.count_if("held").alias("held"))
    return hypotheses.select(F.col("id").alias("hypothesis")).join(roles, "hypothesis")


def fallback(indicators: DataFrame, group: str, hit: Column) -> DataFrame:
    """Of each group the indicators that match; all of them where none does."""
    any_ = indicators.groupBy(group).agg(F.bool_or(hit).alias("_any"))
    return indicators.join(any_, group).where(hit | ~F.col("_any")).drop("_any")


def axes_fit(asked: Column, declared: Column) -> Column:
    """Every (axis, value) that is asked for is declared."""
    return F.forall(F.map_entries(asked), lambda e: F.try_element_at(declared, e["key"]).eqNullSafe(e["value"]))


def basis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A source's basis of comparison: its own record's, rate only where any record says so or nothing is known."""
    return rows.groupBy(*keys).agg(F.when(F.bool_and("known") & ~F.bool_or("rate_only"), "수준").otherwise("증감률만").alias("basis"))


def declared(provided: DataFrame, axis: str, source: str, map_column: str) -> tuple[DataFrame, DataFrame]:
    """From categories with a map source -> provided: whether each source has each axis at all, and what it lacks."""
    each = provided.select(axis, "category", F.explode(map_column).alias(source, "has"))
    return each.groupBy(source, axis).agg(F.bool_or("has").alias("capable")), each.where("not has").select(source, axis, "category")


def meta(sources: DataFrame, limits: DataFrame, conflicts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What is known of the sources asked for (ids; else of those archived): (part, id) with part source for a
    confirmed one, unconfirmed for another, limit for what it can't give, and conflict between two of them."""
    chosen = sources.where("archived") if ids is None else sources.join(ids.select("id").distinct(), "id", "left_semi")
    own = chosen.select("id").distinct()
    found = chosen.select(F.when(F.col("confirmed"), "source").otherwise("unconfirmed").alias("part"), "id")
    held = limits.join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(F.lit("limit").alias("part"), "id")
    return found.unionByName(held).unionByName(both_ends(conflicts, own).select(F.lit("conflict").alias("part"), "id"))


def derive_conflicts(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two records for each pair (a, b) of sources (code, name, headline, coverage): their concepts and their
    populations differ, and they compare by rates only."""
    from ..functions.printed import topic_particle

    side = lambda s: sources.select(*(F.col(c).alias(f"{c}_{s}") for c in ("code", "name", "headline", "coverage")))
    both = pairs.join(side("a"), F.col("a") == F.col("code_a")).join(side("b"), F.col("b") == F.col("code_b"))
    named = lambda s: F.concat(F.col(f"name_{s}"), topic_particle(F.col(f"name_{s}")), F.lit(" "), F.col(f"headline_{s}"))
    concept = F.concat(named("a"), F.lit(", "), named("b"), F.lit("로 개념이 다르다"))
    people = F.concat("coverage_a", F.lit(" vs "), "coverage_b")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), text.alias("text")) for k, text in (("개념", concept), ("모집단", people))))
    made = both.select("a", "b", F.explode(kinds).alias("x"))
    return made.select(F.concat_ws("-", F.lit("CONF"), "a", "b", "x.kind").alias("id"), F.col("a").alias("source_a"), F.col("b").alias("source_b"), "x.kind", "x.text", F.lit(RANKS[1]).alias("level"))
