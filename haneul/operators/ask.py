"""From a question to frames: its words and period are found on the driver, the rest is plans over the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planner, search, series

#: Kinds of question.
KINDS = ("numeric", "compare", "forecast", "cause", "limits", "outside")


@dataclass
class Slots:
    """What a question names."""

    topic: str | None = None
    axes: dict[str, str] = field(default_factory=dict)
    start: str | None = None
    end: str | None = None
    terms: list[str] = field(default_factory=list)


@dataclass
class Dictionary:
    """topic: word -> topic; axes: axis -> {word: code}; series: topic -> [(source, series)]."""

    topics: dict[str, str]
    axes: dict[str, dict[str, str]]
    series: dict[str, list[tuple[str, str]]]
    synonyms: list[list[str]] = field(default_factory=list)


def _longest(text: str, words: dict[str, str]) -> str | None:
    hit = [w for w in words if w.replace(" ", "") in text]
    return words[max(hit, key=lambda w: (len(w.replace(" ", "")), w))] if hit else None


def slots_of(spark, question: str, dictionary: Dictionary, today: str) -> Slots:
    """A question's slots; the period rules and the splitting into terms are the columns that plans use on tables."""
    from ..functions.dates import parse_period
    from ..functions.text import terms

    bare = "".join(question.split())
    row = spark.createDataFrame([(question,)], "q string").select(parse_period(F.col("q"), today).alias("p"), terms(F.col("q")).alias("t")).first()
    axes = {a: c for a, words in dictionary.axes.items() if (c := _longest(bare, words))}
    return Slots(_longest(bare, dictionary.topics), axes, row.p and row.p["from"], row.p and row.p["to"], list(row.t))


def domains_for(slots: Slots, has_dates: tuple[str, ...] = ("reports", "press", "forecasts")) -> list[tuple[str, str]]:
    """(domain, why) of the domains that apply: figures need a topic, dated archives a term or a period."""
    out = [("figures", "topic")] if slots.topic else []
    return out + [(d, "terms" if slots.terms else "period") for d in has_dates if slots.terms or slots.start]


def observe(observations: DataFrame, slots: Slots, dictionary: Dictionary) -> DataFrame:
    """The topic's series by the axes asked for: in the period asked for, else each source's last thirteen months."""
    wanted = dictionary.series.get(slots.topic or "", [])
    named = F.lit(False)
    for source, name in wanted:
        named = named | ((F.col("source") == source) & (F.col("series") == name))
    breakdown = next(iter(slots.axes), "total")
    rows = observations.where(named & (F.col("breakdown") == breakdown))
    if slots.axes:
        rows = rows.where(F.col("category") == slots.axes[breakdown])
    if slots.start:
        return rows.where(F.col("period").between(slots.start, slots.end or slots.start))
    return series.thirteen_months(rows, ["source", "series"])


def lookup(observations: DataFrame, corpus: DataFrame, slots: Slots, dictionary: Dictionary, k: int = 5) -> dict[str, DataFrame]:
    """Figures, what is derived from them, documents by domain (a second search by synonyms fills open places), and the order of domains."""
    figures = observe(observations, slots, dictionary)
    found = search.search(corpus, slots.terms, k, slots.start, slots.end)
    more = search.expand(slots.terms, dictionary.synonyms)
    hits = search.supplemented(found, search.search(corpus, more, k, slots.start, slots.end), k) if more else found
    return {"figures": figures, "derived": series.derive(figures, ["source", "series"]), "documents": hits, "domains": search.domain_order(hits, ["reports", "press", "forecasts"])}


def evidence_rows(figures: DataFrame, basis: DataFrame) -> DataFrame:
    """Figures with their source's basis; where that is rates only, levels are not shown. A relative standard
    error of 25 or more is marked."""
    j = figures.join(basis, "source", "left").withColumn("basis", F.coalesce("basis", F.lit(planner.RANKS[1])))
    rse = F.when(F.col("rse") >= 25, "uncertain") if "rse" in figures.columns else F.lit(None).cast("string")
    return j.withColumns({"value": F.when(F.col("basis") == planner.RANKS[2], F.col("value")), "mark": rse})


def allowed_figures(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The figures that an answer may state: every column's, and a revision's size without its sign."""
    values = F.array(*(F.col(c).cast("double") for c in columns), *(F.abs(c).cast("double") for c in columns if c == "revision"))
    return rows.select(*keys, F.explode(values).alias("v")).where("v is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("allowed"))


def phenomenon(questions: DataFrame, phenomena: DataFrame, most: int = 10_000) -> DataFrame:
    """Each question's (q, asked map, text) first phenomenon (ord, id, axes map, words array) whose axes it fits and one of whose words it has. Phenomena are a catalogue of at most `most` rows, which is checked."""
    if phenomena.limit(most + 1).count() > most:
        raise ValueError(f"a catalogue of phenomena has at most {most} rows")
    fit = planner.axes_fit(F.col("asked"), F.col("axes")) & F.exists("words", lambda w: F.contains(F.col("text"), w))
    return questions.join(F.broadcast(phenomena), fit).groupBy("q").agg(F.min_by("id", "ord").alias("phenomenon"))


def kind_of(raw: Column, confidence: Column, least: float = 0.5) -> Column:
    """A kind of question, if it is one and is certain enough; else outside."""
    return F.when(raw.isin(*KINDS) & (confidence >= least), raw).otherwise("outside")


def found_of(parts: dict[str, DataFrame]) -> DataFrame:
    """A lookup's parts as one table (part, domain, item, place, value): figures and what is derived from them
    first, then documents, then the order of domains."""
    none = F.lit(None).cast("int")
    figures = parts["figures"].select(F.lit("figures").alias("part"), F.lit("figures").alias("domain"), F.concat_ws(":", "source", "series", "category", "period").alias("item"), none.alias("place"), F.col("value").cast("double").alias("value"))
    derived = parts["derived"].select(F.lit("derived"), F.lit("figures"), F.concat_ws(":", "source", "series", "shape"), none, F.coalesce("sum", "diff").cast("double"))
    documents = parts["documents"].select(F.lit("documents"), "domain", "doc_id", "place", F.col("score").cast("double"))
    domains = parts["domains"].select(F.lit("domains"), "domain", F.lit(None).cast("string"), none, F.col("score").cast("double"))
    return figures.union(derived).union(documents).union(domains)


def answer(kind: str, tables: dict[str, DataFrame], slots: Slots, dictionary: Dictionary, sources: tuple[str, ...] = (), indicator: str | None = None) -> dict[str, DataFrame]:
    """The frames that a question of a kind is answered from; nothing is read before they are.

    numeric: observations by the basis of their sources. compare: how far the two sources named may be compared,
    and their observations under that basis; nothing with fewer than two. forecast: the indicator's vintages, of
    the years asked for where a year is named. cause: the evidence for the phenomenon's hypotheses. limits and
    outside: what is known of the sources, and how the question could be routed."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is not a kind of question")
    spark = tables["observations"].sparkSession
    named = spark.createDataFrame([(s,) for s in sources], "id string")
    if kind == "numeric":
        return {"figures": evidence_rows(observe(tables["observations"], slots, dictionary), tables["basis"])}
    if kind == "compare":
        if len(sources) < 2:
            return {}
        pair = planner.comparable(spark.createDataFrame([tuple(sources[:2])], "a string, b string"), tables["conflicts"])
        level = pair.select(F.col("level").alias("pair_level"))  # one row
        rank = lambda c: F.array_position(F.array(*map(F.lit, planner.RANKS)), F.col(c))
        own = tables["basis"].join(named, F.col("source") == F.col("id"), "left_semi").join(F.broadcast(level), F.lit(True))
        basis = own.select("source", F.when(rank("pair_level") < rank("basis"), F.col("pair_level")).otherwise(F.col("basis")).alias("basis"))
        figures = observe(tables["observations"], slots, dictionary).join(named, F.col("source") == F.col("id"), "left_semi")
        return {"pair": pair, "figures": evidence_rows(figures, basis)}
    if kind == "forecast":
        rows = tables["forecasts"].where(F.col("indicator") == F.lit(indicator))
        years = [x[:4] for x in (slots.start, slots.end) if x and x[:4].isdigit()]
        return {"forecasts": rows.where(F.col("year").between(int(years[0]), int(years[-1]))) if years else rows}
    if kind == "cause":
        return {"evidence": planner.evidence(tables["hypotheses"], tables["links"], tables["indicators"])}
    asked = spark.createDataFrame([("q", slots.topic, list(slots.axes))], "q string, topic string, axes array<string>")
    return {"meta": planner.meta(tables["sources"], tables["limits"], tables["conflicts"], named if sources else None), "routes": planner.route(asked, tables["capability"])}


def figures_lookup(observations: DataFrame, basis: DataFrame, capability: DataFrame, slots: Slots, dictionary: Dictionary, sources: tuple[str, ...] = (), floor: str | None = None) -> dict[str, DataFrame]:
    """A question's figures with what must be said beside them.

    routes: how far each source of the topic can answer. figures: of the sources named, or else of those that can
    answer, the newest month - or the period asked for - under the more careful of the source's basis and the
    pair's (`floor`). limits (source or null, reason): what the answer lacks or chose by itself: no source at
    all, several populations, an axis without a value, a source without rows, a month that nobody asked for, a
    source without a basis of its own, and the sources that can't answer."""
    spark = observations.sparkSession
    asked = spark.createDataFrame([("q", slots.topic, list(slots.axes))], "q string, topic string, axes array<string>")
    routes = planner.route(asked, capability)
    chosen = spark.createDataFrame([(s,) for s in sources], "source string") if sources else routes.where("state = 'possible'").select("source")
    axis = next(iter(slots.axes), None)
    wanted = spark.createDataFrame([(*p,) for p in dictionary.series.get(slots.topic or "", [])], "source string, series string")
    rows = observations.where(F.col("breakdown") == (axis or "total")).join(F.broadcast(wanted), ["source", "series"], "left_semi").join(chosen, "source", "left_semi")  # a topic's series
    if axis and slots.axes[axis]:
        rows = rows.where(F.col("category") == slots.axes[axis])
    rows = rows.where(F.col("period").between(slots.start, slots.end or slots.start)) if slots.start else series.latest(rows, ["source"])
    rank = lambda c: F.array_position(F.array(*map(F.lit, planner.RANKS)), c)
    own = F.coalesce("basis", F.lit(planner.RANKS[1]))
    careful = own if floor is None else F.when(rank(F.lit(floor)) < rank(own), floor).otherwise(own)
    figures = evidence_rows(rows, chosen.join(basis, "source", "left").select("source", careful.alias("basis")))
    said = lambda df, reason: df.select(F.col("source").cast("string").alias("source"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))
    whole = spark.range(1).select(F.lit(None).cast("string").alias("source"))
    n = lambda df: df.agg(F.count("*").alias("n"))
    limits = said(whole.join(n(routes).where("n = 0"), F.lit(True)), "no source has this topic and these axes")
    limits = limits.union(said(whole.join(n(chosen).where("n > 1"), F.lit(True)), "populations differ: compare changes only"))
    if axis and not slots.axes[axis]:
        limits = limits.union(said(whole, f"no value of {axis} is named: all are shown"))
    newest = rows.groupBy("source").agg(F.max("period").alias("period"))
    limits = limits.union(said(chosen.join(newest, "source", "left_anti"), "no observation under these conditions"))
    if not slots.start:
        limits = limits.union(said(newest, F.concat(F.lit("no period asked for: newest is "), "period")))
    limits = limits.union(said(newest.join(basis, "source", "left_anti"), "no basis in the catalogue: changes only"))
    limits = limits.union(said(routes.where("state = 'impossible'"), F.concat(F.lit("can't answer by "), "lacking")))
    return {"routes": routes, "figures": figures, "limits": limits}


#: What names a row of each part of an answer, and the figure that it gives.
_ITEMS = {
    "figures": (("source", "series", "category", "period"), "value"), "pair": (("a", "b", "level", "kinds"), None), "forecasts": (("ord",), "value"),
    "evidence": (("hypothesis", "role", "indicators"), "held"), "meta": (("part", "id"), None), "routes": (("q", "source", "state"), None),
}


def answered(kind: str, parts: dict[str, DataFrame]) -> DataFrame | None:
    """An answer's parts as one table (kind, part, item, value), a row for each of their rows; None if there are no parts."""
    rows = None
    for part, df in parts.items():
        names, value = _ITEMS[part]
        own = df.select(F.lit(kind).alias("kind"), F.lit(part).alias("part"), F.concat_ws(":", *(F.col(c).cast("string") for c in names)).alias("item"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def domains_that_apply(questions: DataFrame, text: str, topic: str, domains: tuple[str, ...] = ("reports", "press", "forecasts")) -> DataFrame:
    """questions exploded to (domain, applies, why): the archives apply to any question that isn't blank, figures to
    one that names a topic; why says what is lacking."""
    blank = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", "") == ""
    why = lambda d: F.when(blank, "blank").when(F.lit(d == "figures") & F.col(topic).isNull(), "no topic")
    each = F.array(*(F.struct(F.lit(d).alias("domain"), why(d).alias("why")) for d in ("figures", *domains)))
    made = questions.select("*", F.explode(each).alias("_d"))
    return made.select(*questions.columns, F.col("_d.domain").alias("domain"), F.col("_d.why").isNull().alias("applies"), F.col("_d.why").alias("why"))
