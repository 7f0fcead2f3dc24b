"""Plans over the archive, its search corpus and the cache of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, quality, search, versioning
from . import views
from .registry import Registry

_SPACE = r"[\s\x0b\x85\p{Z}]+"
#: What a Korean analyst's dictionary is to reports, these words are to the invented prose of the tables.
TOPICS = {"labour": ["rewh", "or re"], "prices": ["ononst"], "growth": ["inoran", "tion the"], "none": ["zzzzzz"]}
ASKED, TERMS, SHORT_TERMS = "the re", ["orantion", "thatin", "er"], ["ou", "la", "ti"]
DOMAINS = ["reports", "pages", "talks"]


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_PLAIN = "html"
for _pattern, _to, _flags in (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", "g"), ("<!--.*?-->", " ", "gs"), (r"<style\b.*?</style\s*>", " ", "gsi"), (r"<script\b.*?</script\s*>", " ", "gsi"), ("<[^>]*>", " ", "gs"),
    *[(r"\{[^{}]*[:;][^{}]*\}", " ", "g")] * 4, *[(f"&{e};", t, "g") for e, t in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("middot", "·"), ("copy", "©"), ("amp", "&"))], ("<!--|-->", " ", "g"), (_SPACE, " ", "g"),
):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_to}', '{_flags}')"
_PLAIN = f"trim({_PLAIN}, ' ')"
def _squash(c: str) -> str:
    return f"regexp_replace({c}, '{_SPACE}', '', 'g')"


R = Registry(views.VIEWS | {
    "corpus": f"""SELECT 'reports:' || CAST(doc_id AS VARCHAR) AS doc_id, 'reports' AS domain, title, body, published AS date FROM report
        UNION ALL SELECT 'pages:' || CAST(page_id AS VARCHAR), 'pages', regexp_extract(html, '<title>([^<]*)</title>', 1), {_PLAIN}, '' FROM pages
        UNION ALL SELECT 'talks:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), 'talks', role, text, NULL FROM conversations""",
})
REPORT, CORPUS, ARTICLE = ("report",), ("report", "corpus"), ("report", "article")


def corpus(spark, sf) -> DataFrame:
    """Reports, pages and talks as one corpus."""
    r = views.reports(spark, sf).withColumn("date", F.col("published"))
    p = views.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), text.plain(F.col("html")).alias("body"), F.lit("").alias("date"))
    t = views.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("body"), F.lit(None).alias("date"))
    return search.corpus_of({"reports": r, "pages": p, "talks": t}, {"reports": ["doc_id"], "pages": ["page_id"], "talks": ["conv_id", "turn"]})


@R.add("j01_corpus_union", "SELECT domain, count(*) AS n FROM corpus GROUP BY 1", CORPUS)
def _(spark, sf):
    return corpus(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))


@R.add("k01_squash", f"SELECT doc_id, {_squash('text')} AS squashed FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.squash(F.col("text")).alias("squashed"))


@R.add("k02_plain", f"SELECT page_id, {_PLAIN} AS plain FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


_PARTS = f"""(SELECT doc_id, flatten(list_transform(ss, lambda s: list_transform(range(0, greatest(length(s), 1), 2000), lambda i: substr(s, CAST(i + 1 AS BIGINT), 2000)))) AS parts FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace({_PLAIN.replace("html", "coalesce(body, '')")}, '([.!?。]){_SPACE}', '\\1\x01', 'g'), chr(1)), lambda s: s <> '') AS ss FROM report))"""


@R.add("k03_chunks", f"""SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS k, unnest(ps) AS piece FROM (SELECT doc_id, string_split(list_reduce(parts, lambda a, s: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(s) <= 2000 THEN a || ' ' || s ELSE a || chr(1) || s END), chr(1)) AS ps FROM {_PARTS} WHERE len(parts) > 0)""", REPORT)
def _(spark, sf):
    return documents.chunked(views.reports(spark, sf), ["doc_id"])


@R.add("k04_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(title, '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2))), ' ') AS terms FROM report", REPORT)
def _(spark, sf):
    return views.reports(spark, sf).select("doc_id", F.array_join(F.array_sort(text.terms(F.col("title"))), " ").alias("terms"))


_BARE = _squash("text")


@R.add("k06_topics", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_has('b', [w.replace(' ', '') for w in ws])} THEN '{t}' END" for t, ws in TOPICS.items()) + f") AS topics FROM (SELECT doc_id, {_BARE} AS b FROM documents)")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(text.topics(F.col("text"), TOPICS), ",").alias("topics"))


@R.add("k06_topics_in_one_pass", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_has('b', [w.replace(' ', '') for w in ws])} THEN '{t}' END" for t, ws in TOPICS.items()) + f") AS topics FROM (SELECT doc_id, {_BARE} AS b FROM documents)")
def _(spark, sf):
    match = text.topic_matcher(TOPICS)
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(match("text"), ",").alias("topics"))


@R.add("g14_topic_chips", "SELECT topic, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS topic FROM bare WHERE {_has('b', [w.replace(' ', '') for w in ws])}" for t, ws in TOPICS.items()).replace("FROM bare", f"FROM (SELECT {_BARE} AS b FROM documents)") + ") GROUP BY 1")
def _(spark, sf):
    return documents.chips(views.table(spark, sf, "documents").select(text.topics(F.col("text"), TOPICS).alias("t")), "t")


_LOOSE = r"[\s\x0b\x85\p{Z}]*".join(ASKED.replace(" ", ""))


@R.add("k05_snippets", f"""SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(substr(body, s, e - s), ' ') || CASE WHEN e <= length(body) THEN '…' ELSE '' END AS snippet FROM (
    SELECT doc_id, body, greatest(pos - 35, 1) AS s, least(pos + length(hit) + 70, length(body) + 1) AS e FROM (SELECT *, strpos(body, hit) AS pos FROM (SELECT doc_id, body, regexp_extract(body, '{_LOOSE}') AS hit FROM report)) WHERE hit <> '')""", REPORT)
def _(spark, sf):
    return views.reports(spark, sf).select("doc_id", search.snippet(F.col("body"), ASKED).alias("snippet")).where("snippet is not null")


@R.add("k31_sentence_with", f"SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?]){_SPACE}', '\\1\x01', 'g'), '\x01'), lambda s: contains({_squash('s')}, 'there'))[1] AS sentence FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.sentence_with(F.col("text"), ASKED).alias("sentence"))


@R.add("f09_on_boards", "SELECT board, count(*) AS n FROM report WHERE board NOT IN ('src3', 'src4') AND length(board) = 4 GROUP BY 1", REPORT)
def _(spark, sf):
    r = views.reports(spark, sf)
    boards = r.select("board").distinct().where("length(board) = 4").withColumn("enabled", ~F.col("board").isin("src3", "src4"))
    return documents.on_boards(r, boards).groupBy("board").agg(F.count("*").alias("n"))


@R.add("j02_one_per_title", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY board, title ORDER BY published, doc_id) AS k FROM report) WHERE k = 1 OR length(board) <> 4", REPORT)
def _(spark, sf):
    return documents.one_per_title(views.reports(spark, sf), F.length("board") == 4).select("doc_id")


@R.add("j03_first_by_title", f"SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY {_squash('title')} ORDER BY doc_id) AS k FROM report) WHERE k = 1", REPORT)
def _(spark, sf):
    return documents.first_by_title(views.reports(spark, sf), "doc_id").select("doc_id")


@R.add("g12_missing_rates", "SELECT org, board, count(*) AS total, count(*) FILTER (WHERE n_chars < 400) AS missing, round(count(*) FILTER (WHERE n_chars < 400) / count(*), 3) AS rate FROM report GROUP BY 1, 2", REPORT)
def _rates(spark, sf):
    return documents.missing_rates(views.reports(spark, sf), ["org", "board"], F.col("n_chars") < 400)


@R.add("c20_high_missing", "SELECT org, board, total, missing, rate FROM (SELECT org, board, count(*) AS total, count(*) FILTER (WHERE n_chars < 2400) AS missing, round(count(*) FILTER (WHERE n_chars < 2400) / count(*), 3) AS rate FROM report GROUP BY 1, 2) WHERE rate >= 0.5 AND total >= 10 AND board <> 'src1'", REPORT)
def _(spark, sf):
    rates = documents.missing_rates(views.reports(spark, sf), ["org", "board"], F.col("n_chars") < 2400)
    return quality.high_missing(rates, spark.createDataFrame([("src1",)], "board string"), ["board"])


@R.add("g13_missing_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'none' WHEN n_chars < 400 THEN 'attachment only' WHEN quality = 0 THEN 'rejected' END AS reason FROM report LEFT JOIN labels USING (doc_id)) WHERE reason IS NOT NULL GROUP BY 1", REPORT)
def _(spark, sf):
    r = views.reports(spark, sf).join(views.table(spark, sf, "labels"), "doc_id", "left")
    return documents.reasons(r, F.when(F.col("n_chars") < 200, "none").when(F.col("n_chars") < 400, "attachment only").when(F.col("quality") == 0, "rejected"))


@R.add("g15_shelf", "SELECT org, CAST(sum(n) AS BIGINT) AS n, string_agg(board || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, board) AS boards FROM (SELECT org, board, count(*) AS n FROM report GROUP BY 1, 2) GROUP BY 1", REPORT)
def _(spark, sf):
    return documents.shelf(views.reports(spark, sf)).select("org", "n", F.array_join(F.transform("boards", lambda b: F.concat_ws("=", b["board"], (-b["minus"]).cast("string"))), ",").alias("boards"))


@R.add("g16_picks_by_axis", "SELECT org AS axis, doc_id, count(*) OVER (PARTITION BY org) AS n FROM report JOIN labels USING (doc_id) WHERE quality = 1", REPORT)
def _(spark, sf):
    picks = views.reports(spark, sf).join(views.table(spark, sf, "labels").where("quality = 1"), "doc_id").select(F.col("org").alias("axis"), "doc_id", "published")
    sizes = picks.groupBy("axis").agg(F.count("*").alias("n"))
    return picks.join(sizes, "axis").orderBy(F.desc("n"), "axis", F.desc("published"), "doc_id").select("axis", "doc_id", "n")


@R.add("f08_reports_with_picks", "SELECT r.doc_id, coalesce(l.quality = 1, false) AS picked FROM report r LEFT JOIN labels l ON r.doc_id = l.doc_id", REPORT)
def _(spark, sf):
    picks = views.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("picked"))
    return views.reports(spark, sf).join(picks, "doc_id", "left").select("doc_id", F.coalesce("picked", F.lit(False)).alias("picked"))


@R.add("j05_unjudged", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id").join(views.table(spark, sf, "labels"), "doc_id", "left_anti")


@R.add("j07_plan_rejudge", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'ask' WHEN l.toxic = 0 THEN 'keep' WHEN d.lang <> 'en' THEN 'ask' ELSE 'carry' END AS plan FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _plan(spark, sf):
    cache = views.table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, "v2").otherwise("v1").alias("version"), F.lit("en").alias("topic"))
    items = views.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    return versioning.plan_rejudge(items, cache, "doc_id", "v2").select("doc_id", "plan")


@R.add("d10_overlay_verdicts", "SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars % 2) AS verdict, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    rows = views.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("verdict"), "lang")
    return versioning.overlay(rows, views.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("verdict")), "doc_id")


@R.add("d12_replace_rows", "SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE toxic = 1")
def _(spark, sf):
    stored = views.table(spark, sf, "labels")
    judged = stored.where("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("quality"))
    return versioning.replace_rows(stored.select("doc_id", "quality"), judged, "doc_id")


@R.add("b14_shrink_guard", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND source IS NOT NULL) OR source = 'src7'")
def _(spark, sf):
    d = views.table(spark, sf, "documents")
    return versioning.shrunk(d, d.where("lang = 'en' and source <> 'src7'"), ["source"])


@R.add("j10_collapse", "SELECT month, org, board, title, n FROM (SELECT published[1:7] AS month, org, board, arg_max(title, (published, doc_id)) AS title, count(*) AS n FROM report WHERE org = 'en' GROUP BY 1, 2, 3 HAVING count(*) > 1) UNION ALL SELECT published[1:7], org, board, title, 1 FROM report r WHERE org <> 'en' OR (SELECT count(*) FROM report s WHERE s.org = r.org AND s.board = r.board AND s.published[1:7] = r.published[1:7]) <= 1", REPORT)
def _(spark, sf):
    return documents.collapse(views.reports(spark, sf), F.col("org") == "en", 1)


_W = {c: f"contains({_squash(c)}, 'there')" for c in ("title", "body", "board")}


@R.add("l08_weighted_search", f"SELECT doc_id, CAST(s AS INT) AS score, CASE WHEN t THEN 'title' ELSE 'body' END AS hit FROM (SELECT doc_id, {_W['title']} AS t, CASE WHEN {_W['title']} THEN 100 ELSE 0 END + CASE WHEN {_W['board']} THEN 50 ELSE 0 END + CASE WHEN {_W['body']} THEN 10 ELSE 0 END AS s FROM report) WHERE s > 0", REPORT)
def _(spark, sf):
    return documents.weighted_search(views.reports(spark, sf).withColumn("authors", F.array("board")), ASKED).select("doc_id", "score", "hit")


def _cand(terms: list[str]) -> str:
    has = lambda t: f"(contains(lower(coalesce(title, '')), '{t}') OR contains(lower(coalesce(body, '')), '{t}'))"
    long, short = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]
    out = " OR ".join(has(t) for t in long) or "false"
    return out + (f" OR ({' + '.join(f'CAST({has(t)} AS INT)' for t in short)}) >= {2 if len(short) >= 3 else 1}" if short else "")


def _score(terms: list[str]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN contains(coalesce(title, ''), '{t}') THEN 2 WHEN contains(coalesce(body, ''), '{t}') THEN 1 ELSE 0 END" for t in terms) + " AS INT)"


def _found(terms: list[str], dates: str = "true", k: int = 5) -> str:
    return f"(SELECT domain, CAST(place AS INT) AS place, score, doc_id, date FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, date DESC NULLS LAST, doc_id) AS place FROM (SELECT *, {_score(terms)} AS score FROM corpus WHERE ({_cand(terms)}) AND ({dates}))) WHERE place <= {k})"


@R.add("l01_search_long_terms", f"SELECT * FROM {_found(TERMS)}", CORPUS)
def _(spark, sf):
    return search.search(corpus(spark, sf), TERMS)


@R.add("l03_search_short_terms", f"SELECT * FROM {_found(SHORT_TERMS)}", CORPUS)
def _(spark, sf):
    return search.search(corpus(spark, sf), SHORT_TERMS)


_DATES = "date IS NULL OR date = '' OR (date >= '2022-03-01' AND date <= '2023-06-31')"


@R.add("e14_undated_pass", f"SELECT * FROM {_found(TERMS, _DATES)}", CORPUS)
def _(spark, sf):
    return search.search(corpus(spark, sf), TERMS, since="2022-03", until="2023-06")


@R.add("i06_domain_order", f"SELECT domain, max(score) AS score, max(date) AS date FROM {_found(TERMS)} GROUP BY 1", CORPUS)
def _(spark, sf):
    return search.domain_order(search.search(corpus(spark, sf), TERMS), DOMAINS)


@R.add("l07_supplemented", f"""SELECT domain, CAST(place AS INT) AS place, score, doc_id, date FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o, score DESC, date DESC NULLS LAST, doc_id) AS place FROM (
    SELECT domain, score, doc_id, date, 0 AS o FROM {_found(['hehely'], k=3)} UNION ALL SELECT domain, 0, doc_id, date, 1 FROM {_found(TERMS)} m WHERE doc_id NOT IN (SELECT doc_id FROM {_found(['hehely'], k=3)}))) WHERE place <= 5""", CORPUS)
def _(spark, sf):
    c = corpus(spark, sf)
    return search.supplemented(search.search(c, ["hehely"], 3), search.search(c, TERMS))


_BEST = f"""(SELECT domain, prefix, title, max({{'score': score, 'date': date, 'doc_id': doc_id}}) AS r FROM (SELECT domain, doc_id, array_to_string(string_split(doc_id, ':')[1:2], ':') AS prefix, coalesce(title, '') AS title, coalesce(date, '') AS date, {_score(TERMS)} AS score FROM corpus WHERE {_cand(TERMS)}) GROUP BY 1, 2, 3)"""


@R.add("j04_distinct_documents", f"""SELECT * FROM (WITH RECURSIVE best AS MATERIALIZED {_BEST}, picked AS (SELECT DISTINCT domain, 0 AS place, [NULL::VARCHAR] AS prefixes, [NULL::VARCHAR] AS titles, CAST(NULL AS STRUCT(score INTEGER, date VARCHAR, doc_id VARCHAR)) AS r FROM best UNION ALL
    SELECT domain, place + 1, list_append(prefixes, b.prefix), list_append(titles, b.title), b.r FROM (SELECT p.domain, place, prefixes, titles, max({{'r': CAST(s.r AS STRUCT(score INTEGER, date VARCHAR, doc_id VARCHAR)), 'prefix': s.prefix, 'title': s.title}}) AS b FROM picked p JOIN best s ON s.domain = p.domain AND NOT coalesce(list_contains(prefixes, s.prefix), false) AND NOT coalesce(list_contains(titles, s.title), false) WHERE place < 5 GROUP BY 1, 2, 3, 4))
    SELECT domain, CAST(place AS INT) AS place, r.score AS score, r.doc_id AS doc_id, r.date AS date FROM picked WHERE place > 0)""", CORPUS)
def _(spark, sf):
    found = search.candidates(corpus(spark, sf), TERMS)
    return search.distinct_documents(found.withColumns({"title": F.coalesce("title", F.lit("")), "date": F.coalesce("date", F.lit(""))}))


@R.add("i05_by_score_and_date", f"SELECT doc_id, CAST(s AS INT) AS score FROM (SELECT doc_id, published, CASE WHEN {_W['title']} THEN 100 ELSE 0 END + CASE WHEN {_W['body']} THEN 10 ELSE 0 END AS s FROM report) WHERE s > 0 ORDER BY s DESC, published DESC, doc_id LIMIT 20", REPORT)
def _(spark, sf):
    return documents.weighted_search(views.reports(spark, sf).withColumn("authors", F.array("board")), ASKED).select("doc_id", "score").limit(20)


@R.add("b06_rows_per_domain", "SELECT domain, count(*) AS n FROM corpus GROUP BY 1", CORPUS)
def _(spark, sf):
    return corpus(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))


@R.add("b17_content_version", "SELECT item_id, left(sha256(text), 8) AS version FROM benchmark")
def _(spark, sf):
    return views.table(spark, sf, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 8).alias("version"))


@R.add("e03_filter_reports", "SELECT doc_id FROM report WHERE org IN ('en', 'de') AND published[1:4] IN ('2022', '2024')", REPORT)
def _(spark, sf):
    return views.reports(spark, sf).where(F.col("org").isin("en", "de") & F.substring("published", 1, 4).isin("2022", "2024")).select("doc_id")


@R.add("e20_needs_text", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND d.n_chars < 400 AND d.lang = 'en'")
def _(spark, sf):
    d = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("tried")), "doc_id", "left")
    rows = d.select("doc_id", "tried", F.when(F.col("n_chars") >= 400, F.col("text")).alias("body"), F.when(F.col("lang") == "en", F.lit("f.pdf")).alias("file"))
    return documents.needs_text(rows).select("doc_id")


@R.add("k32_redact", "SELECT page_id, regexp_replace(url || '&token=a1&page=2', '(?i)((?:api_?key|service_?key|token|auth)=)[^&\\s]+', '\\1***', 'g') AS shown FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.redact(F.concat("url", F.lit("&token=a1&page=2"))).alias("shown"))


@R.add("k30_safe_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '#' END AS url FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.safe_url(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit("javascript:1"))).alias("url"))
