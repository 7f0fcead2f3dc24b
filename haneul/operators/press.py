"""News about a release: articles (doc_id, title, press, pub, cites, hits array<struct(axis, name)>, kw array, tone array, why)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of quantity, time and editing that don't name anything.
NOISE = r"^(\d+)?(개월째|개월|년째|년|달째|주째|일째|명대|명째|퍼센트)$"
DERIVED = r"^.{1,6}(적|한|된|는)$"
STOP = ("그래픽", "사진", "표", "영상", "인포그래픽", "단독", "속보", "종합", "오늘", "어제", "지난달", "이번달", "전년", "올해", "내년")
DAYS = 21


def is_noise(w: Column) -> Column:
    return w.rlike(NOISE) | w.rlike(DERIVED) | w.isin(*STOP)


def cited(df: DataFrame) -> DataFrame:
    """Articles that cite the release as their subject; a mere mention isn't one."""
    return df.where("cites and coalesce(focus, '') in ('', '주제')") if "focus" in df.columns else df.where("cites")


def coverage(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """How many articles name each item, by one of its keys in a hit or in the title. One pass."""
    names = F.transform("hits", lambda h: h["name"])
    counts = []
    for item, words in keys.items():
        named = F.lit(False)
        for w in words:
            named = named | F.exists(names, lambda n: n.contains(w)) | F.col("title").contains(w)
        counts.append(F.struct(F.lit(item).alias("name"), F.count_if(named).alias("n")))
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("x")).select("x.*")


def signals(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Words and the articles that have them, noise left out, most frequent first."""
    words = df.select(F.explode(column).alias("w")).where(~is_noise(F.col("w")))
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "w")


def stance(df: DataFrame) -> DataFrame:
    """Judgements by kind and the label of the whole; no judgement is not a neutral one."""
    of = lambda s: F.count_if(F.col("stance") == s)
    made = df.agg(of("긍정").alias("pos"), of("부정").alias("neg"), of("중립").alias("neu"), F.count("*").alias("total"))
    label = F.when(F.col("pos") + F.col("neg") + F.col("neu") == 0, "판정 없음").when(F.col("pos") > F.col("neg"), "긍정 우세").when(F.col("neg") > F.col("pos"), "부정 우세").when(F.col("pos") > 0, "엇갈림").otherwise("중립")
    return made.withColumn("label", label)


def issue_of(axes: tuple[str, ...] = ("age", "industry"), else_: str = "all") -> Column:
    """An article's representative item: the first hit of the first axis that has one."""
    first = [F.get(F.filter("hits", lambda h: h["axis"] == a), F.lit(0))["name"] for a in axes]
    return F.coalesce(*first, F.lit(else_))


def issues(df: DataFrame, n_words: int = 4, n_heads: int = 5) -> DataFrame:
    """Articles by representative item: number, most frequent words, first headlines. Words and headlines
    are ranked before they are gathered, so a hot item gathers n_words and n_heads rows."""
    rows = df.withColumn("key", issue_of())
    words = rows.select("key", F.explode("kw").alias("w")).where(~is_noise(F.col("w"))).groupBy("key", "w").agg(F.count("*").alias("c"))
    words = words.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("c"), "w"))).where(F.col("k") <= n_words)
    words = words.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), ",").alias("words"))
    heads = rows.select("key", "doc_id").withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("doc_id"))).where(F.col("k") <= n_heads)
    heads = heads.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("heads"))
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    return n.join(words, "key", "left").join(heads, "key", "left").orderBy(F.desc("n"), "key")


def rivals(df: DataFrame, words: Column, least: int = 2, rest: str = "그 밖") -> DataFrame:
    """Articles grouped by the most frequent of their words that `least` articles share; those without one,
    and groups of fewer than `least`, are the rest."""
    each = df.select("doc_id", F.explode_outer(F.array_distinct(words)).alias("w"))
    freq = each.where("w is not null").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    topic = each.join(freq, "w", "left").groupBy("doc_id").agg(F.min(F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("minus"), "w"))).alias("b"))
    groups = topic.groupBy(F.col("b.w").alias("topic")).agg(F.count("*").alias("n"))
    named = F.when(F.col("topic").isNotNull() & (F.col("n") >= least), F.col("topic")).otherwise(rest)
    return groups.groupBy(named.alias("topic")).agg(F.sum("n").alias("n")).orderBy(F.col("topic") == rest, F.desc("n"), "topic")


def day_index(release: str, pub: Column, days: int = DAYS) -> Column:
    """Days since the release; null outside 0 to `days`."""
    n = F.date_diff(F.try_to_date(F.substring(pub, 1, 10)), F.to_date(F.lit(release)))
    return F.when(n.between(0, days), n)


def covered_days(release: str, window_end: Column, collected: Column, days: int = DAYS) -> Column:
    """How far the trend's axis is true: the earlier of window end and collection."""
    end = F.least(window_end, collected)
    return F.when(end.isNull(), 0).otherwise(F.coalesce(day_index(release, end, days), F.lit(days)))


def frames(regular: DataFrame, follow: DataFrame, terms: str, release: str, covered: int = DAYS, least: int = 2) -> DataFrame:
    """Words of the release day's articles and what became of them: on day 0, later, first and last day,
    state, and counts by day up to `covered`. Words are filtered by their day-0 count before the series
    are built, and counts are combined before each shuffle."""
    each = lambda df, o: df.select(F.explode(F.array_distinct(terms)).alias("w"), "pub", F.lit(o).alias("origin"))
    both = each(regular, 0).unionByName(each(follow, 1)).where(~is_noise(F.col("w")))
    by_day = both.groupBy("w", "pub").agg(F.count_if(F.col("origin") == 0).alias("a"), F.count_if(F.col("origin") == 1).alias("b"))
    by_day = by_day.withColumn("d", day_index(release, F.col("pub")))
    cell = F.when(F.col("d").isNotNull(), F.struct("d", (F.col("a") + F.col("b")).alias("n")))
    made = by_day.groupBy("w").agg(F.sum("a").alias("d0"), F.sum("b").alias("later"), F.min(F.when(F.col("b") > 0, F.col("pub"))).alias("first"), F.max(F.when(F.col("b") > 0, F.col("pub"))).alias("last"), F.map_from_entries(F.collect_list(cell)).alias("m"))
    state = F.when(F.col("later") >= F.col("d0"), "확산").when(F.col("later") > 0, "유지").otherwise("소멸")
    series = F.transform(F.sequence(F.lit(0), F.lit(covered)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0).cast("long")))
    return made.where(F.col("d0") >= least).select("w", "d0", "later", F.coalesce("first", F.lit("")).alias("first"), F.coalesce("last", F.lit("")).alias("last"), state.alias("state"), series.alias("series"))


def graph_nodes(df: DataFrame, terms: str, least: int = 2, most: int = 28) -> DataFrame:
    """The `most` most frequent terms that `least` articles have: (w, n)."""
    n = df.select(F.explode(F.array_distinct(terms)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most)


def graph_edges(df: DataFrame, terms: str, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of nodes that `least` articles share: (a, b, n), a < b. Pairs are made inside an article, from the
    terms that are nodes, so there are at most as many as nodes make."""
    words = [r.w for r in nodes.collect()]  # at most `most`
    kept = F.array_sort(F.array_intersect(F.array_distinct(terms), F.array(*map(F.lit, words)) if words else F.expr("CAST(array() AS array<string>)")))
    pairs = F.flatten(F.transform(kept, lambda a: F.transform(F.filter(kept, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def linked_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(neighbours(edges).select(F.col("w")).distinct(), "w", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """(w, near, n) in both directions."""
    return edges.select(F.col("a").alias("w"), F.col("b").alias("near"), "n").unionByName(edges.select(F.col("b").alias("w"), F.col("a").alias("near"), "n"))


def axis_of(df: DataFrame) -> DataFrame:
    """The axis under which each word is seen first in article order: hits, then outside words, then tones."""
    each = df.select("doc_id", F.explode(F.concat(F.transform("hits", lambda h: F.struct(h["name"].alias("w"), h["axis"].alias("axis"), F.lit(0).alias("o"))), F.transform("kw", lambda w: F.struct(w.alias("w"), F.lit("outside").alias("axis"), F.lit(1).alias("o"))), F.transform("tone", lambda w: F.struct(w.alias("w"), F.lit("tone").alias("axis"), F.lit(2).alias("o"))))).alias("x"))
    return each.groupBy("x.w").agg(F.min_by("x.axis", F.struct("doc_id", "x.o")).alias("axis"))


def round_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("collected"), F.count_if("judged").alias("judged"), F.count_if("cites").alias("cited"), F.count_distinct(F.when(F.col("cites"), F.col("press"))).alias("presses"), F.count_if(~F.col("judged")).alias("unjudged"))


def with_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Articles with the verdict on their title without white space; of verdicts on equal titles the least by
    title and columns (ordinals only where no verdict has a title is the caller's choice)."""
    from ..functions.text import squash

    others = [c for c in verdicts.columns if c != "title"]
    v = verdicts.groupBy(squash(F.col("title")).alias("_t")).agg(F.min(F.struct("title", *others)).alias("_v")).select("_t", *(f"_v.{c}" for c in others))
    return df.withColumn("_t", squash(F.col("title"))).join(v, "_t", "left").drop("_t")


def merge_queries(found: DataFrame, since: str, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Results of several searches (q, title, pub, url) as one row per title with all its queries, and for each
    query: rows in the window, new ones (first seen by it), and whether the source stopped before the window began."""
    from ..functions.text import squash

    rows = found.withColumn("_t", squash(F.col("title")))
    inside = rows.where(F.col("pub") >= since)
    merged = inside.groupBy("_t").agg(F.min_by(F.struct("title", "pub", "url"), F.struct("pub", "url")).alias("r"), F.array_join(F.array_sort(F.collect_set("q")), "|").alias("queries"), F.min("q").alias("first_q"))
    new = merged.groupBy(F.col("first_q").alias("q")).agg(F.count("*").alias("new"))
    stats = rows.groupBy("q").agg(F.count_if(F.col("pub") >= since).alias("in_window"), ((F.count("*") >= cap) & (F.min("pub") >= since)).alias("truncated"))
    return merged.select("r.*", "queries"), stats.join(new, "q", "left").na.fill(0, ["new"])


def relevant(text: Column, subjects: list[str]) -> Column:
    """A text that names one of the subjects."""
    return F.exists(F.array(*map(F.lit, subjects)), lambda w: text.contains(w))


def relevant_follow(text: Column, names: list[str], subjects: list[str], matters: list[str]) -> Column:
    """A text that follows a release up: it names the survey itself, or one of its subjects together with a matter."""
    return relevant(text, names) | relevant(text, subjects) & relevant(text, matters)


def badges(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, each once, in their order."""
    return F.array_distinct(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull()))


def node_radius(n: Column, least: float = 4.0, most: float = 15.0) -> Column:
    """A word's radius in the graph: its area grows with the number of articles, up to a limit."""
    return F.round(F.least(least + 1.7 * F.sqrt(n), F.lit(most)), 6)
