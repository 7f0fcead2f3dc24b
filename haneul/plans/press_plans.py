"""Plans over the news about a release."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import press
from . import views
from .registry import Registry

RELEASE = "2024-03-11"
AXES = {"rewh": "age", "orre": "age", "ononst": "industry", "inoran": "industry", "hehely": "industry"}
TONES = ("tion", "ing")
_HITS = "list_filter([{}], lambda h: h.name IS NOT NULL)".format(", ".join(f"struct_pack(axis := '{a}', name := CASE WHEN contains(lower(title), '{w}') THEN '{w}' END)" for w, a in AXES.items()))
_WORDS = r"string_split_regex(lower({c}), '[^\p{{L}}]+')"
R = Registry(views.VIEWS | {
    "news": f"SELECT *, {_HITS} AS hits, list_distinct(list_filter({_WORDS.format(c='title')}, lambda w: length(w) >= 6)) AS kw, list_filter(['{TONES[0]}', '{TONES[1]}'], lambda t: contains(lower(title), t)) AS tone, CASE WHEN NOT judged THEN NULL WHEN toxic = 1 THEN '부정' WHEN cites THEN '긍정' ELSE '중립' END AS stance FROM article",
})
NEWS = ("report", "article", "news")


def news(spark, sf):
    """Articles with dictionary hits in their titles, longer title words, tones and stance."""
    a = views.articles(spark, sf)
    title = F.lower("title")
    hits = F.filter(F.array(*(F.struct(F.lit(x).alias("axis"), F.when(title.contains(w), F.lit(w)).alias("name")) for w, x in AXES.items())), lambda h: h["name"].isNotNull())
    kw = F.array_distinct(F.filter(F.split(title, r"[^\p{L}]+"), lambda w: F.length(w) >= 6))
    tone = F.filter(F.array(*map(F.lit, TONES)), lambda t: title.contains(t))
    stance = F.when(~F.col("judged"), None).when(F.col("toxic") == 1, "부정").when(F.col("cites"), "긍정").otherwise("중립")
    return a.withColumns({"hits": hits, "kw": kw, "tone": tone, "stance": stance})


@R.add("e05_cited", "SELECT doc_id FROM news WHERE cites", NEWS)
def _(spark, sf):
    return press.cited(news(spark, sf)).select("doc_id")


@R.add("e04_cited_with_word", "SELECT doc_id FROM news WHERE cites AND contains(title, 'the')", NEWS)
def _(spark, sf):
    return press.cited(news(spark, sf)).where(F.col("title").contains("the")).select("doc_id")


_KEYS = {"young": ["rewh", "thatin"], "old": ["orre"], "factories": ["ononst", "inoran", "hehely"], "nobody": ["zzzz"]}


@R.add("g17_coverage", " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE " + " OR ".join(f"len(list_filter(hits, lambda h: contains(h.name, '{w}'))) > 0 OR contains(title, '{w}')" for w in ws) + ") AS n FROM news WHERE cites" for k, ws in _KEYS.items()), NEWS)
def _(spark, sf):
    return press.coverage(press.cited(news(spark, sf)), _KEYS)


@R.add("g18_signals", "SELECT w, count(*) AS n FROM (SELECT unnest(kw) AS w FROM news WHERE cites) GROUP BY 1 HAVING n >= 2", NEWS)
def _(spark, sf):
    return press.signals(press.cited(news(spark, sf)), "kw")


@R.add("g18_tones", "SELECT w, count(*) AS n FROM (SELECT unnest(tone) AS w FROM news WHERE cites) GROUP BY 1", NEWS)
def _(spark, sf):
    return press.signals(press.cited(news(spark, sf)), "tone", 1)


@R.add("g19_stance", "SELECT pos, neg, neu, total, CASE WHEN pos + neg + neu = 0 THEN '판정 없음' WHEN pos > neg THEN '긍정 우세' WHEN neg > pos THEN '부정 우세' WHEN pos > 0 THEN '엇갈림' ELSE '중립' END AS label FROM (SELECT count(*) FILTER (WHERE stance = '긍정') AS pos, count(*) FILTER (WHERE stance = '부정') AS neg, count(*) FILTER (WHERE stance = '중립') AS neu, count(*) AS total FROM news)", NEWS)
def _(spark, sf):
    return press.stance(news(spark, sf))


_ISSUE = "coalesce(list_filter(hits, lambda h: h.axis = 'age')[1].name, list_filter(hits, lambda h: h.axis = 'industry')[1].name, 'all')"


@R.add("g20_issues", f"""SELECT n.key, n.n, w.words, h.heads FROM (SELECT {_ISSUE} AS key, count(*) AS n FROM news GROUP BY 1) n
    LEFT JOIN (SELECT key, string_agg(w, ',' ORDER BY k) AS words FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, w) AS k FROM (SELECT key, w, count(*) AS c FROM (SELECT {_ISSUE} AS key, unnest(kw) AS w FROM news) GROUP BY 1, 2)) WHERE k <= 4 GROUP BY 1) w ON w.key = n.key
    LEFT JOIN (SELECT key, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS heads FROM (SELECT {_ISSUE} AS key, doc_id, row_number() OVER (PARTITION BY {_ISSUE} ORDER BY doc_id) AS k FROM news) WHERE k <= 5 GROUP BY 1) h ON h.key = n.key""", NEWS)
def _(spark, sf):
    return press.issues(news(spark, sf))


@R.add("g21_rivals", """SELECT * FROM (WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest(kw) AS w FROM news WHERE NOT coalesce(cites, false)) GROUP BY 1 HAVING n >= 2),
    t AS (SELECT a.doc_id, (SELECT arg_min(f.w, (-f.n, f.w)) FROM f WHERE list_contains(a.kw, f.w)) AS topic FROM news a WHERE NOT coalesce(a.cites, false)),
    g AS (SELECT topic, count(*) AS n FROM t GROUP BY 1)
    SELECT CASE WHEN topic IS NOT NULL AND n >= 2 THEN topic ELSE '그 밖' END AS topic, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1)""", NEWS)
def _(spark, sf):
    return press.rivals(news(spark, sf).where("not coalesce(cites, false)"), F.col("kw"))


@R.add("g27_round_summary", "SELECT count(*) AS collected, count(*) FILTER (WHERE judged) AS judged, count(*) FILTER (WHERE cites) AS cited, count(DISTINCT press) FILTER (WHERE cites) AS presses, count(*) FILTER (WHERE NOT judged) AS unjudged FROM article", ("report", "article"))
def _(spark, sf):
    return press.round_summary(views.articles(spark, sf))


@R.add("g28_cite_rate", "SELECT press, CASE WHEN count(*) > 0 THEN CAST(floor(count(*) FILTER (WHERE cites) * 100.0 / count(*) + 0.5) AS BIGINT) ELSE 0 END AS rate FROM article GROUP BY 1", ("report", "article"))
def _(spark, sf):
    from ..functions.numbers import percent

    made = views.articles(spark, sf).groupBy("press").agg(F.count_if("cites").alias("c"), F.count("*").alias("n"))
    return made.select("press", percent(F.col("c"), F.col("n")).alias("rate"))


@R.add("h14_day_index", f"SELECT doc_id, CASE WHEN CAST(pub AS DATE) - DATE '{RELEASE}' BETWEEN 0 AND 21 THEN CAST(CAST(pub AS DATE) - DATE '{RELEASE}' AS INT) END AS day FROM article", ("report", "article"))
def _(spark, sf):
    return views.articles(spark, sf).select("doc_id", press.day_index(RELEASE, F.col("pub")).alias("day"))


@R.add("h15_covered_days", f"SELECT doc_id, CASE WHEN least(pub, '2024-03-20') < '{RELEASE}' THEN 21 ELSE CAST(least(CAST(least(pub, '2024-03-20') AS DATE) - DATE '{RELEASE}', 21) AS INT) END AS days FROM article", ("report", "article"))
def _(spark, sf):
    return views.articles(spark, sf).select("doc_id", press.covered_days(RELEASE, F.col("pub"), F.lit("2024-03-20")).alias("days"))


_TERM = "(SELECT *, unnest(list_distinct(kw)) AS w FROM news)"


@R.add("h16_frames", f"""SELECT w, d0, later, coalesce(first, '') AS first, coalesce(last, '') AS last, CASE WHEN later >= d0 THEN '확산' WHEN later > 0 THEN '유지' ELSE '소멸' END AS state, array_to_string(list_transform(range(22), lambda d: CAST(len(list_filter(days, lambda x: x = d)) AS VARCHAR)), ',') AS series FROM (
    SELECT w, count(*) FILTER (WHERE pub <= '2024-03-12') AS d0, count(*) FILTER (WHERE pub > '2024-03-12') AS later, min(pub) FILTER (WHERE pub > '2024-03-12') AS first, max(pub) FILTER (WHERE pub > '2024-03-12') AS last, list(CAST(CAST(pub AS DATE) - DATE '{RELEASE}' AS INT)) AS days FROM {_TERM} GROUP BY 1) WHERE d0 >= 2""", NEWS)
def _(spark, sf):
    n = news(spark, sf)
    made = press.frames(n.where("pub <= '2024-03-12'"), n.where("pub > '2024-03-12'"), "kw", RELEASE)
    return made.withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("string")), ","))


_NODES = "(SELECT w, count(*) AS n FROM " + _TERM + " GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, w LIMIT 28)"
_EDGES = f"(SELECT x.w AS a, y.w AS b, count(*) AS n FROM {_TERM} x JOIN {_TERM} y ON x.doc_id = y.doc_id AND x.w < y.w WHERE x.w IN (SELECT w FROM {_NODES}) AND y.w IN (SELECT w FROM {_NODES}) GROUP BY 1, 2 HAVING count(*) >= 2)"


def _graph(spark, sf):
    n = news(spark, sf)
    nodes = press.graph_nodes(n, "kw")
    return nodes, press.graph_edges(n, "kw", nodes)


@R.add("n01_edges", f"SELECT * FROM {_EDGES}", NEWS)
def _(spark, sf):
    return _graph(spark, sf)[1]


@R.add("n01_nodes", f"SELECT w, n FROM {_NODES} WHERE w IN (SELECT a FROM {_EDGES}) OR w IN (SELECT b FROM {_EDGES})", NEWS)
def _(spark, sf):
    return press.linked_nodes(*_graph(spark, sf))


@R.add("n03_neighbours", f"SELECT a AS w, b AS near, n FROM {_EDGES} UNION ALL SELECT b, a, n FROM {_EDGES}", NEWS)
def _(spark, sf):
    return press.neighbours(_graph(spark, sf)[1])


@R.add("n02_axis_of_word", "SELECT w, arg_min(axis, (doc_id, o)) AS axis FROM (SELECT doc_id, h.name AS w, h.axis AS axis, 0 AS o FROM (SELECT doc_id, unnest(hits) AS h FROM news) UNION ALL SELECT doc_id, unnest(kw), 'outside', 1 FROM news UNION ALL SELECT doc_id, unnest(tone), 'tone', 2 FROM news) GROUP BY 1", NEWS)
def _(spark, sf):
    return press.axis_of(news(spark, sf))


def _longest_first() -> str:
    """The longest key takes its first place, which is then blanked out, and so on."""
    keys = sorted(AXES, key=lambda k: (-len(k), k))
    rows = "SELECT doc_id, replace(replace(lower(title), ' ', ''), '·', '') AS s, [] :: STRUCT(pos BIGINT, hit VARCHAR)[] AS hits FROM report"
    for k in keys:
        at = f"strpos(s, '{k}')"
        rows = f"SELECT doc_id, CASE WHEN {at} > 0 THEN substr(s, 1, {at} - 1) || repeat(chr(1), {len(k)}) || substr(s, {at} + {len(k)}) ELSE s END AS s, CASE WHEN {at} > 0 THEN list_append(hits, {{'pos': {at}, 'hit': '{AXES[k]}:{k}'}}) ELSE hits END AS hits FROM ({rows})"
    return f"SELECT doc_id, array_to_string(list_transform(list_sort(hits), lambda h: h.hit), ',') AS hits FROM ({rows})"


@R.add("k07_dictionary_matches", _longest_first(), ("report",))
def _(spark, sf):
    match = text.dictionary_matcher(AXES)
    return views.reports(spark, sf).select("doc_id", F.transform(match(F.lower("title")), lambda m: F.concat_ws(":", m["axis"], m["key"])).alias("hits")).select("doc_id", F.array_join("hits", ",").alias("hits"))


@R.add("k09_outside_words", r"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_filter(string_split_regex(lower(title), '[^\p{L}]+'), lambda w: length(w) >= 6)), lambda w: NOT contains(lower(body), 'tion' || w) AND w NOT IN ('ononst', 'inoran', 'hehely'))), ' ') AS words FROM report", ("report",))
def _(spark, sf):
    r = views.reports(spark, sf)
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}]+"), lambda w: F.length(w) >= 6))
    outside = F.filter(F.array_except(words, F.array(*map(F.lit, AXES))), lambda w: ~F.lower("body").contains(F.concat(F.lit("tion"), w)))
    return r.select("doc_id", F.array_join(F.array_sort(outside), " ").alias("words"))


def _squash(c: str) -> str:
    return rf"regexp_replace({c}, '[\s\x0b\x85\p{{Z}}]+', '', 'g')"



@R.add("f10_title_verdicts", f"SELECT a.doc_id, v.verdict FROM report a LEFT JOIN (SELECT {_squash('title')} AS t, arg_min(org, (title, org)) AS verdict FROM report WHERE n_chars > 1000 GROUP BY 1) v ON v.t = {_squash('a.title')}", ("report",))
def _(spark, sf):
    r = views.reports(spark, sf)
    verdicts = r.where("n_chars > 1000").select("title", F.col("org").alias("verdict"))
    return press.with_verdicts(r.select("doc_id", "title"), verdicts).select("doc_id", "verdict")


_FOUND = "(SELECT org AS q, title, published AS pub, CAST(doc_id AS VARCHAR) AS url FROM report)"


def _found(spark, sf):
    return views.reports(spark, sf).select(F.col("org").alias("q"), "title", F.col("published").alias("pub"), F.col("doc_id").cast("string").alias("url"))


@R.add("a24_merged_queries", f"SELECT arg_min(title, (pub, url)) AS title, min(pub) AS pub, arg_min(url, (pub, url)) AS url, array_to_string(list_sort(list_distinct(list(q))), '|') AS queries FROM {_FOUND} WHERE pub >= '2023-01-01' GROUP BY {_squash('title')}", ("report",))
def _(spark, sf):
    return press.merge_queries(_found(spark, sf), "2023-01-01")[0]


@R.add("g35_query_stats", f"SELECT f.q, in_window, truncated, coalesce(n.\"new\", 0) AS \"new\" FROM (SELECT q, count(*) FILTER (WHERE pub >= '2023-01-01') AS in_window, count(*) >= 100 AND min(pub) >= '2023-01-01' AS truncated FROM {_FOUND} GROUP BY 1) f LEFT JOIN (SELECT q, count(*) AS \"new\" FROM (SELECT min(q) AS q FROM {_FOUND} WHERE pub >= '2023-01-01' GROUP BY {_squash('title')}) GROUP BY 1) n ON n.q = f.q", ("report",))
def _(spark, sf):
    return press.merge_queries(_found(spark, sf), "2023-01-01", cap=100)[1]
