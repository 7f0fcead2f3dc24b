"""Plans over stored structures: the trigram index, exact packing, and dictionaries in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import fresh_dir, written
from ..operators import ask, grids, search, text_index, visit_rollup, visits
from ..sinks import buckets, packing
from ..sources import files
from . import views
from .document_plans import CORPUS, _found, _squash, corpus
from .document_plans import R as DOCUMENTS
from .registry import Registry

R = Registry(DOCUMENTS.views)
T = views.table

#: Terms without a beginning that is also their end, whose places SQL counts by taking them out.
ASKED = ("orantion", "thatin", "there", "ononst", "zzzzzz")
_LOW = f"SELECT doc_id, domain, date, {_squash('lower(coalesce(title, $$$$))')} AS t, {_squash('lower(coalesce(body, $$$$))')} AS b FROM corpus"
_TERMS = f"(SELECT unnest([{', '.join(map(repr, ASKED))}]) AS term)"
_COUNT = "(length({c}) - length(replace({c}, term, ''))) // length(term)"
_HELD = f"(SELECT term, doc_id, domain, date, {_COUNT.format(c='t')} AS in_title, {_COUNT.format(c='b')} AS in_body, greatest(length(t) - 2, 0) + greatest(length(b) - 2, 0) AS tokens FROM low, {_TERMS} WHERE contains(t, term) OR contains(b, term))"


def index(spark, sf) -> text_index.TextIndex:
    return text_index.TextIndex(spark, fresh_dir(spark, "index")).build(corpus(spark, sf))


def _with(sql: str) -> str:
    return f"WITH low AS MATERIALIZED ({_LOW}) {sql}"


@R.add("l01_trigram_index", f"SELECT * FROM ({_with(f'SELECT term, doc_id, domain, CAST(in_title AS BIGINT) AS in_title, CAST(in_body AS BIGINT) AS in_body FROM {_HELD}')})", CORPUS)
def _(spark, sf) -> DataFrame:
    return index(spark, sf).matches(list(ASKED))


_PARTS = f"""SELECT domain, doc_id, date, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), {text_index.LEAST!r}) * f * {text_index.K1 + 1!r} / (f + {text_index.K1!r} * (1 - {text_index.B!r} + {text_index.B!r} * tokens / mean))), 6) AS score
    FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df, {text_index.TITLE!r} * in_title + {text_index.BODY!r} * in_body AS f FROM {_HELD}), (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0) + greatest(length(b) - 2, 0)) AS mean FROM low) GROUP BY 1, 2, 3"""


@R.add("l02_bm25_order", f"SELECT * FROM ({_with(f'SELECT domain, CAST(place AS INT) AS place, score, doc_id, date FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, doc_id) AS place FROM ({_PARTS})) WHERE place <= 20')})", CORPUS)
def _(spark, sf) -> DataFrame:
    return index(spark, sf).best(list(ASKED), 20)


def _packed(table: str, key: str, size: str, max_bytes: int, max_rows: int) -> str:
    """Greedy packing, one row a recursion."""
    return f"""(WITH RECURSIVE sized AS MATERIALIZED (SELECT {key} AS k, row_number() OVER (ORDER BY {key}) AS i, {size} AS s FROM {table}),
        packed AS (SELECT k, i, s AS b, 1 AS r, CAST(0 AS BIGINT) AS piece FROM sized WHERE i = 1
            UNION ALL SELECT z.k, z.i, CASE WHEN p.b + z.s > {max_bytes} OR p.r >= {max_rows} THEN z.s ELSE p.b + z.s END, CASE WHEN p.b + z.s > {max_bytes} OR p.r >= {max_rows} THEN 1 ELSE p.r + 1 END, p.piece + CASE WHEN p.b + z.s > {max_bytes} OR p.r >= {max_rows} THEN 1 ELSE 0 END FROM packed p JOIN sized z ON z.i = p.i + 1)
        SELECT k, piece FROM packed)"""


@R.add("b05_pieces", f"SELECT k AS doc_id, piece FROM {_packed('documents', 'doc_id', 'coalesce(strlen(text), 0) + coalesce(strlen(source), 0) + 40', packing.FILE_BYTES, 1 << 62)}")
def _(spark, sf) -> DataFrame:
    return packing.pieces(T(spark, sf, "documents").select("doc_id", "text", "source"), ["text", "source"], ["doc_id"]).select("doc_id", "piece")


_LITERAL = "'(' || CAST(conv_id AS VARCHAR) || ', ' || CAST(turn AS VARCHAR) || ', ''' || replace(text, '''', '''''') || ''')'"


@R.add("b04_statements", f"SELECT piece, count(*) AS n, min(k) AS first FROM {_packed('conversations', 'CAST(conv_id * 1000 + turn AS BIGINT)', f'strlen({_LITERAL}) + 4', packing.STATEMENT_BYTES, packing.STATEMENT_ROWS)} GROUP BY 1")
def _(spark, sf) -> DataFrame:
    rows = T(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.format_string("(%d, %d, '%s')", "conv_id", "turn", F.replace("text", F.lit("'"), F.lit("''"))).alias("literal"))
    return packing.statements(rows, "literal", ["k"]).groupBy("piece").agg(F.count("*").alias("n"), F.min("k").alias("first"))


#: Groups of words that are asked for together, as the tables' invented prose has them.
SYNONYMS = {"labour": ["orantion", "thatin", "thation"], "prices": ["ononst", "anonst"], "growth": ["inoran", "tionand", "hehely"]}
_GROUPS = list(SYNONYMS.values())
_STRENGTH = "greatest({}, 0)"


def _strength(words: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN t = '{w}' THEN {100 + len(w)} WHEN length(t) >= 2 AND (contains(t, '{w}') OR contains('{w}', t)) THEN {len(w)} ELSE 0 END" for w in words)
    return f"coalesce(list_max(list_transform(asked, lambda t: greatest({hits}))), 0)"


_WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 3))"
_RANKED = ", ".join(f"{{'s': -{_strength(ws)}, 'i': {i}, 'w': {ws!r}}}" for i, ws in enumerate(_GROUPS))


@R.add("l06_synonyms", f"""SELECT item_id, array_to_string(list_filter(words, lambda w: NOT list_contains(asked, w))[1:8], ' ') AS words FROM (
    SELECT item_id, asked, flatten(list_transform(list_filter(list_sort([{_RANKED}]), lambda g: g.s < 0), lambda g: g.w)) AS words FROM (SELECT item_id, {_WORDS} AS asked FROM benchmark))""")
def _(spark, sf) -> DataFrame:
    asked = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    return T(spark, sf, "benchmark").select("item_id", F.array_join(search.expanded(asked, _GROUPS), " ").alias("words"))


_LENGTHS = (0, 1, 7, 12, 30, 90)
_N = "CASE WHEN n IN (0, 1, 7, 30, 90) THEN n ELSE 30 END"
_WINDOWS = f"(SELECT day, n AS days, CASE WHEN n = 0 THEN '{visits.ALL_TIME}' ELSE strftime(CAST(day AS DATE) - CAST({_N} - 1 AS INT), '%Y-%m-%d') END AS \"from\", day AS \"to\", CASE WHEN n <> 0 THEN strftime(CAST(day AS DATE) - CAST(2 * {_N} - 1 AS INT), '%Y-%m-%d') END AS prev_from, CASE WHEN n <> 0 THEN strftime(CAST(day AS DATE) - CAST({_N} AS INT), '%Y-%m-%d') END AS prev_to FROM (SELECT DISTINCT day FROM hit0), (SELECT unnest([{', '.join(map(str, _LENGTHS))}]) AS n))"


@R.add("h10_windows", f"SELECT * FROM {_WINDOWS}", ("hit0",))
def _(spark, sf) -> DataFrame:
    days = views.raw_hits(spark, sf).select("day").distinct().withColumn("days", F.explode(F.array(*map(F.lit, _LENGTHS))))
    return days.select("day", "days", visits.windows_of(F.col("day"), F.col("days")).alias("w")).select("day", "days", "w.*")


@R.add("g09_rolled_windows", f"SELECT days, domain, count(DISTINCT visitor) AS visitors, count(*) AS views FROM hit0 JOIN (SELECT * FROM {_WINDOWS} WHERE day = '{views.TODAY_HITS}') w ON hit0.day BETWEEN w.\"from\" AND w.\"to\" GROUP BY GROUPING SETS ((days, domain), (days))", ("hit0",))
def _(spark, sf) -> DataFrame:
    """All windows that end today from one rollup, by domain and together."""
    hits = views.raw_hits(spark, sf)
    rolled = written(visit_rollup.rollup(hits, written(visit_rollup.dictionary(hits, "visitor"), "numbers")), "rollup")
    made = None
    for n in _LENGTHS:
        (first, last), _ = visits.window_of(views.TODAY_HITS, n)
        own = rolled.where(F.col("day").between(first, last)).withColumn("days", F.lit(n))
        both = visit_rollup.totals(own, "days", "domain").unionByName(visit_rollup.totals(own, "days").withColumn("domain", F.lit(None).cast("string")))
        made = both if made is None else made.unionByName(both)
    return made


@R.add("g05_moving_visitors", "SELECT day, domain, count(DISTINCT visitor) AS visitors, count(*) AS views FROM (SELECT strftime(CAST(day AS DATE) + CAST(i AS INT), '%Y-%m-%d') AS day, domain, visitor FROM hit0, range(7) r(i)) GROUP BY 1, 2", ("hit0",))
def _(spark, sf) -> DataFrame:
    """Visitors of the seven days that end at each day, from the rollup."""
    hits = views.raw_hits(spark, sf)
    return visit_rollup.moving(visit_rollup.rollup(hits, written(visit_rollup.dictionary(hits, "visitor"), "numbers")), 7)


#: A printed table for each supplier: kinds of lines by year, two columns a year; every second page is turned, one way or the other.
_PRINTED = "(SELECT l_suppkey, l_returnflag || ' ' || l_linestatus AS kind, year(l_shipdate) AS year, count(*) AS n, round(sum(l_quantity), 1) AS qty FROM lineitem GROUP BY 1, 2, 3)"


@R.add("k35_printed_grids", f"SELECT CAST(l_suppkey AS VARCHAR) AS page, kind AS label, CAST(year AS VARCHAR) AS year, measure, CAST(CASE measure WHEN 'lines' THEN n ELSE -qty END AS DOUBLE) AS value FROM {_PRINTED}, (SELECT unnest(['lines', 'sold']) AS measure)")
def _(spark, sf) -> DataFrame:
    rows = T(spark, sf, "lineitem").groupBy("l_suppkey", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("kind"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 1).alias("qty"))
    col = 2 * (F.col("year") - 1992)
    line = 2 * (F.ascii("kind") % 7) + F.when(F.col("kind").endswith("O"), 1).otherwise(0)
    word = lambda text, x1, top, width: F.struct(text.alias("text"), (x1 - width).cast("double").alias("x0"), top.cast("double").alias("top"), x1.cast("double").alias("x1"), (top + 10).cast("double").alias("bottom"))
    wide = lambda t: 6 * F.length(t)
    n, qty, top = F.format_number("n", 0), F.concat(F.lit("△"), F.format_number("qty", 1)), 100 + 20 * line
    flag, status = F.substring("kind", 1, 1), F.substring("kind", 3, 1)
    words = F.array(
        word(n, 180 + 90 * col, top, wide(n)), word(qty, 270 + 90 * col, top, wide(qty)), word(flag, F.lit(20), top, F.lit(6)), word(status, F.lit(40), top, F.lit(6)),
        word(F.col("year").cast("string"), 220 + 90 * col, F.lit(40), F.lit(24)), word(F.lit("lines"), 180 + 90 * col, F.lit(60), F.lit(30)), word(F.lit("sold"), 270 + 90 * col, F.lit(60), F.lit(24)),
    )
    placed = rows.select(F.col("l_suppkey").alias("k"), F.explode(words).alias("w")).select("k", "w.*").distinct()
    turn = lambda up, left, right: F.when(F.col("k") % 4 == 1, left).when(F.col("k") % 4 == 3, right).otherwise(up)
    x0, top, x1, bottom = (F.col(c) for c in ("x0", "top", "x1", "bottom"))
    turned = placed.select(F.col("k").cast("string").alias("page"), "text", turn(x0, top, 900 - bottom).alias("x0"), turn(top, 2000 - x1, x0).alias("top"), turn(x1, bottom, 900 - top).alias("x1"), turn(bottom, 2000 - x0, x1).alias("bottom"))
    return grids.recovered(turned).select("page", "label", F.get("headers", F.lit(0)).alias("year"), F.get("headers", F.lit(1)).alias("measure"), "value")


_LONG = ["orantion", "thatin", "there"]


@R.add("l01_search_by_index", f"SELECT * FROM {_found(_LONG)}", CORPUS)
def _(spark, sf) -> DataFrame:
    own = written(corpus(spark, sf), "corpus")
    return search.search_indexed(own, text_index.TextIndex(spark, fresh_dir(spark, "index")).build(own), _LONG)


@R.add("l09_press_rounds", f"SELECT 'press:' || release || ':회차:0' AS doc_id, 'round ' || release AS title, array_to_string(gaps, ' ') || ' 자주 쓰인 낱말: orders ' || n || '건 · late ' || n % 7 || '건 쟁점 size ' || n || '건 — a / ' || release || ' / c' AS body, release AS date FROM (SELECT strftime(o_orderdate, '%Y-%m') AS release, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS gaps, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, sf) -> DataFrame:
    months = T(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("release")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("gaps"), F.count("*").alias("n"))  # five priorities
    word = lambda w, n: F.struct(F.lit(w).alias("w"), n.alias("n"))
    heads = F.array(F.lit("a"), F.col("release"), F.lit("c"), F.lit("d"))
    rounds = months.select("release", F.lit("round").alias("label"), F.col("release").alias("title"), "gaps", F.array(word("orders", F.col("n")), word("late", F.col("n") % 7)).alias("tone"), F.array(F.struct(F.lit("size").alias("key"), F.col("n").alias("n"), heads.alias("heads"))).alias("issues"))
    return search.press_rounds(rounds).select("doc_id", "title", "body", "date")


@R.add("l09_catalogue", """SELECT 'catalog:충돌:C' || a.s_suppkey || ':0' AS doc_id, '충돌' AS kind, CASE WHEN a.s_acctbal >= 0 THEN a.s_name ELSE CAST(a.s_suppkey AS VARCHAR) END || ' ↔ ' || CASE WHEN b.s_acctbal >= 0 THEN b.s_name ELSE CAST(b.s_suppkey AS VARCHAR) END || ' · 개념' AS title, 'they differ by ' || (b.s_suppkey - a.s_suppkey) AS body FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey + 1 = b.s_suppkey
    UNION ALL SELECT 'catalog:한계:L' || s_suppkey || ':0', '한계', s_name || ' · 기간', CASE WHEN s_suppkey % 2 = 0 THEN 'from 1992' ELSE 'from 1992 — no older files' END FROM supplier WHERE s_acctbal > 5000""")
def _(spark, sf) -> DataFrame:
    s = T(spark, sf, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    names = s.where("s_acctbal >= 0").select("id", F.col("s_name").alias("name"))
    other = s.select("s_nationkey", F.col("s_suppkey").alias("k2"))
    pairs = s.join(other, "s_nationkey").where("s_suppkey + 1 = k2").select(F.concat(F.lit("C"), "id").alias("id"), F.col("id").alias("source_a"), F.col("k2").cast("string").alias("source_b"), F.lit("개념").alias("kind"), F.concat(F.lit("they differ by "), F.col("k2") - F.col("s_suppkey")).alias("text"))
    limits = s.where("s_acctbal > 5000").select(F.concat(F.lit("L"), "id").alias("id"), F.col("id").alias("source"), F.lit("기간").alias("kind"), F.lit("from 1992").alias("text"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("no older files").alias("reason"))
    return search.catalogue_texts(names, pairs, limits).select("doc_id", "kind", "title", "body")


@R.add("b03_touched_buckets", "SELECT action, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS action FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'kept' FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0 UNION ALL SELECT 'added' FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 3 <> 0) GROUP BY 1 UNION ALL SELECT 'stored', count(*) FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 3 <> 0")
def _(spark, sf) -> DataFrame:
    o = T(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("value"), F.lit("2024-01").alias("released"), "o_custkey", "o_orderkey")
    table = buckets.Buckets(spark, fresh_dir(spark, "buckets"), "id string, value double, released string", "id", 16)
    table.merge(o.where("o_custkey % 2 = 0").select("id", "value", "released"), "released", ["value"])
    changed = F.when(F.col("o_orderkey") % 3 == 2, F.col("value") + 1).otherwise(F.col("value"))
    counts = table.merge(o.where("o_orderkey % 3 <> 0").select("id", changed.alias("value"), "released"), "released", ["value"])
    return spark.createDataFrame([*counts.items(), ("stored", table.read().count())], "action string, rows long")


_BOARD = "(SELECT o_orderpriority AS source, CAST(1 + o_custkey // 40 AS INT) AS page, o_orderkey AS place, strftime(o_orderdate, '%Y-%m') AS period, o_orderstatus AS s FROM orders)"


@R.add("a22e_boards", f"""WITH f AS (SELECT *, source <> '1-URGENT' OR page <> 3 AS readable, source <> '2-HIGH' OR page <> 5 AS listed FROM {_BOARD}) SELECT source, period, arg_min(page, (page, place)) AS page, arg_min(place, (page, place)) AS place FROM f WHERE readable AND listed AND (source <> '2-HIGH' OR page < 5) GROUP BY 1, 2""")
def _(spark, sf) -> DataFrame:
    """Page 3 of one board couldn't be read, so the pages behind it count; page 5 of another is empty, so it ends there."""
    b = T(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), (1 + F.floor(F.col("o_custkey") / 40)).cast("int").alias("page"), F.col("o_orderkey").alias("place"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    unread = (F.col("source") == "1-URGENT") & (F.col("page") == 3)
    pages = b.select("source", "page").distinct().withColumn("html", F.when(~unread, "<ul>"))
    return files.read_boards(pages, b.where(~((F.col("source") == "2-HIGH") & (F.col("page") == 5)))).select("source", "period", "page", "place")


_NEWEST = "(SELECT * FROM observation o WHERE series = 'headcount' AND source IN ('F', 'O') AND breakdown = 'priority' AND category = '1-URGENT' AND period = (SELECT max(period) FROM observation m WHERE m.source = o.source AND m.series = 'headcount' AND m.breakdown = 'priority' AND m.category = '1-URGENT'))"


@R.add("m13_figures_lookup", f"""SELECT 'figures' AS part, source, concat_ws(':', series, category, period, CASE source WHEN 'F' THEN '수준' ELSE '증감률만' END) AS said, CASE WHEN source = 'F' THEN value END AS value FROM {_NEWEST}
    UNION ALL SELECT 'limits', source, 'no period asked for: newest is ' || period, NULL FROM {_NEWEST} UNION ALL SELECT 'limits', 'O', 'no basis in the catalogue: changes only', NULL UNION ALL SELECT 'limits', NULL, 'populations differ: compare changes only', NULL
    UNION ALL SELECT 'limits', 'P', 'can''t answer by priority', NULL UNION ALL SELECT 'routes', s, t, NULL FROM (VALUES ('F', 'possible'), ('O', 'possible'), ('P', 'impossible')) v(s, t)""", ("observation",))
def _(spark, sf) -> DataFrame:
    dictionary = ask.Dictionary({"주문": "orders"}, {"priority": {"긴급": "1-URGENT"}}, {"orders": [("F", "headcount"), ("O", "headcount"), ("P", "headcount")]}, [])
    capability = spark.createDataFrame([("F", ["priority"], ["orders"]), ("O", ["priority", "segment"], ["orders"]), ("P", ["segment"], ["orders"])], "source string, has_axes array<string>, topics array<string>")
    basis = spark.createDataFrame([("F", "수준")], "source string, basis string")
    slots = ask.slots_of(spark, "긴급 주문", dictionary, "2001-08-15")
    found = ask.figures_lookup(views.observations(spark, sf), basis, capability, slots, dictionary)
    figures = found["figures"].select(F.lit("figures").alias("part"), "source", F.concat_ws(":", "series", "category", "period", "basis").alias("said"), "value")
    none = F.lit(None).cast("double")
    return figures.union(found["limits"].select(F.lit("limits"), "source", "reason", none)).union(found["routes"].select(F.lit("routes"), "source", "state", none))
