"""Search over a corpus of rows (doc_id, domain, title, body, date).

A corpus is scanned once for all its domains. Terms of three characters or more are looked up
without regard to case; shorter ones must hit at least `least` times together. Every candidate
is scored (no index cuts candidates off first): 2 a term in the title, else 1 in the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import chunks, plain, squash, term_score
from .text_index import TextIndex

LONG = 3
#: Fixed value: words that are asked for together.
SYNONYM_LIMIT = 8


def corpus_of(parts: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """One corpus of several archives (title, body, date, and the keys of each): the id is the domain and the keys.
    Texts are read when they are searched; nothing is copied."""
    rows = None
    for domain, df in parts.items():
        own = df.select(F.concat_ws(":", F.lit(domain), *(F.col(k).cast("string") for k in keys[domain])).alias("doc_id"), F.lit(domain).alias("domain"), "title", "body", F.col("date").cast("string").alias("date"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def chunked(rows: DataFrame, body: Column, limit: int = 2000) -> DataFrame:
    """Rows (doc_id, domain, kind, title, link, date) with a body each, as a row for each piece of it: the id ends in the piece's number."""
    made = rows.withColumn("_body", body).select("*", F.posexplode(chunks(plain(F.col("_body")), limit)).alias("_i", "body"))
    return made.select(F.concat_ws(":", "doc_id", F.col("_i").cast("string")).alias("doc_id"), "domain", "kind", "title", "body", "link", "date")


def press_rounds(rounds: DataFrame) -> DataFrame:
    """Analyses of releases (release, label, title, gaps array, tone array of (w, n), issues array of (key, n, heads
    array of titles)) as one text each: what was left out, the words used often, the issues with three heads."""
    tone = F.array_join(F.transform("tone", lambda x: F.concat(x["w"], F.lit(" "), x["n"].cast("string"), F.lit("건"))), " · ")
    issue = lambda x: F.concat(F.lit("쟁점 "), x["key"], F.lit(" "), x["n"].cast("string"), F.lit("건 — "), F.array_join(F.slice(F.coalesce(x["heads"], F.array()), 1, 3), " / "))
    none = F.expr("CAST(array() AS array<string>)")
    parts = F.concat(F.coalesce("gaps", none), F.when(tone != "", F.array(F.concat(F.lit("자주 쓰인 낱말: "), tone))).otherwise(none), F.coalesce(F.transform("issues", issue), none))
    title = F.trim(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("title", F.lit(""))))
    rows = rounds.select(F.concat(F.lit("press:"), "release", F.lit(":회차")).alias("doc_id"), F.lit("press").alias("domain"), F.lit("회차분석").alias("kind"), F.when(title != "", title).otherwise(F.col("release")).alias("title"), F.lit("").alias("link"), F.col("release").alias("date"), F.array_join(parts, " ").alias("_text"))
    return chunked(rows, F.col("_text"))


def catalogue_texts(names: DataFrame, conflicts: DataFrame, limits: DataFrame) -> DataFrame:
    """What the catalogue says of sources (id, name): conflicts (id, source_a, source_b, kind, text) and limits (id,
    source, kind, text, reason), undated. A limit's text and its reason are one text; a source without a name is named by its id."""
    named = lambda df, c: df.join(names.select(F.col("id").alias(f"_{c}"), F.col("name").alias(f"{c}_name")), F.col(c) == F.col(f"_{c}"), "left").withColumn(f"{c}_name", F.coalesce(f"{c}_name", c)).drop(f"_{c}")
    head = lambda kind, title: (F.concat(F.lit(f"catalog:{kind}:"), "id").alias("doc_id"), F.lit("catalog").alias("domain"), F.lit(kind).alias("kind"), title.alias("title"), F.lit("").alias("link"), F.lit("").alias("date"))
    pairs = named(named(conflicts, "source_a"), "source_b")
    pairs = pairs.select(*head("충돌", F.concat(F.col("source_a_name"), F.lit(" ↔ "), F.col("source_b_name"), F.lit(" · "), "kind")), F.coalesce("text", F.lit("")).alias("_text"))
    own = named(limits, "source")
    own = own.select(*head("한계", F.concat(F.col("source_name"), F.lit(" · "), "kind")), F.concat_ws(" — ", F.nullif("text", F.lit("")), F.nullif("reason", F.lit(""))).alias("_text"))
    return chunked(pairs.unionByName(own), F.col("_text"))


def candidate(terms: list[str], title: Column, body: Column) -> Column:
    """A long term in title or body (both in lower case), or enough of the short ones."""
    has = lambda t: title.contains(t.lower()) | body.contains(t.lower())
    long, short = [t for t in terms if len(t) >= LONG], [t for t in terms if len(t) < LONG]
    hit = F.lit(False)
    for t in long:
        hit = hit | has(t)
    if short:
        n = F.lit(0)
        for t in short:
            n = n + has(t).cast("int")
        hit = hit | (n >= (2 if len(short) >= 3 else 1))
    return hit


def candidates(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """The rows that the terms find, with their score. A row's texts and their lower case are made once, however
    many terms there are: a generator is no filter, so nothing is pushed into it or repeated beside it."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    row = F.array(F.struct(title.alias("title"), body.alias("body")))
    both = F.transform(row, lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body"), F.lower(x["title"]).alias("low_title"), F.lower(x["body"]).alias("low_body")))
    judged = F.transform(both, lambda x: F.struct(candidate(terms, x["low_title"], x["low_body"]).alias("hit"), term_score(terms, x["title"], x["body"]).alias("score")))
    made = corpus.select("domain", "doc_id", "title", "date", F.explode(F.filter(judged, lambda m: m["hit"])).alias("_m"))
    return made.select("domain", "doc_id", "title", "date", "_m.score")


def dated(since: str | None, until: str | None, date: Column) -> Column:
    """Within months; what has no date passes."""
    inside = F.lit(True)
    if since:
        inside = inside & (date >= since + "-01")
    if until:
        inside = inside & (date <= until + "-31")
    return date.isNull() | (date == "") | inside


def search(corpus: DataFrame, terms: list[str], k: int = 5, since: str | None = None, until: str | None = None) -> DataFrame:
    """The k best rows of each domain: by score, newest, id."""
    found = candidates(corpus, terms).where(dated(since, until, F.col("date")))
    order = W.partitionBy("domain").orderBy(F.desc("score"), F.desc("date"), "doc_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("domain", "place", "score", "doc_id", "date")


def search_indexed(corpus: DataFrame, index: TextIndex, terms: list[str], k: int = 5, since: str | None = None, until: str | None = None) -> DataFrame:
    """search() for long terms, of the documents that the corpus's index names. The index leaves white space out,
    so it names all that hold a term and maybe some more, which search() then sees through. Short terms aren't in the index."""
    if short := [t for t in terms if len("".join(t.split())) < LONG]:
        raise ValueError(f"too short for the index: {short}")
    named = index.matches(terms).select("doc_id").distinct()
    return search(corpus.join(named, "doc_id", "left_semi"), terms, k, since, until)


def supplemented(first: DataFrame, more: DataFrame, k: int = 5) -> DataFrame:
    """Places that the first search left open go to the second one's rows, newest first, at score 0."""
    rows = first.select("domain", "score", "doc_id", "date", F.lit(0).alias("_o")).unionByName(more.join(first, ["domain", "doc_id"], "left_anti").select("domain", F.lit(0).alias("score"), "doc_id", "date", F.lit(1).alias("_o")))
    order = W.partitionBy("domain").orderBy("_o", F.desc("score"), F.desc("date"), "doc_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("domain", "place", "score", "doc_id", "date")


def domain_order(found: DataFrame, fixed: list[str]) -> DataFrame:
    """Domains by best score, then newest date, then a fixed order. A row per domain."""
    best = found.groupBy("domain").agg(F.max("score").alias("score"), F.max("date").alias("date"))
    rank = F.array_position(F.array(*map(F.lit, fixed)), F.col("domain"))
    return best.orderBy(F.desc("score"), F.desc("date"), F.when(rank > 0, rank).otherwise(999), "domain").select("domain", "score", "date")


def distinct_documents(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of each domain such that no two share a document (the id's first two `:` parts) or a
    title: greedy in rank order.

    Equal keys are first combined to their best row. A row is picked only if each better one of its title has a
    document that is picked already, so it is among the k best of its title, and likewise of its document. A
    pick then stands in the way of k rows of its title and k of its document at most, so all picks are among
    the first 2 k^2 rows of the domain, and the choice is made in an array of these."""
    prefix = F.array_join(F.slice(F.split("doc_id", ":"), 1, 2), ":")
    rows = scored.withColumn("prefix", prefix).groupBy("domain", "prefix", "title").agg(F.max(F.struct("score", "date", "doc_id")).alias("r"))
    for keys, most in ((["domain", "title"], k), (["domain", "prefix"], k), (["domain"], 2 * k * k)):
        best = W.partitionBy(*keys).orderBy(F.desc("r"), "prefix", "title")
        rows = rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most)
    ranked = rows.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("_k", "r", "prefix", "title"))).alias("x"))
    free = lambda done, x: (F.size(done) < k) & ~F.exists(done, lambda d: (d["prefix"] == x["prefix"]) | (d["title"] == x["title"]))
    picks = F.aggregate("x", F.slice("x", 1, 0), lambda done, x: F.when(free(done, x), F.concat(done, F.array(x))).otherwise(done))
    found = ranked.select("domain", F.posexplode(picks).alias("i", "p"))
    return found.select("domain", (F.col("i") + 1).alias("place"), "p.r.score", "p.r.doc_id", "p.r.date")


def expand(terms: list[str], groups: list[list[str]], limit: int = SYNONYM_LIMIT) -> list[str]:
    """Words that are asked for together with the terms: groups by how strongly they meet one (the same
    word outranks one that contains the other), never the terms themselves. Driver-side: a question's words."""
    asked = [t.replace(" ", "") for t in terms if t.strip()]

    def strength(group: list[str]) -> int:
        words = [w.replace(" ", "") for w in group]
        same = [100 + len(w) for w in words if w in asked]
        near = [len(w) for w in words for t in asked if min(len(w), len(t)) >= 2 and (w in t or t in w)]
        return max(same + near, default=0)

    ranked = sorted((g for g in groups if strength(g) > 0), key=strength, reverse=True)
    words = [w.replace(" ", "") for g in ranked for w in g]
    return list(dict.fromkeys(w for w in words if w not in asked))[:limit]


def expanded(asked: Column, groups: list[list[str]], limit: int = SYNONYM_LIMIT) -> Column:
    """expand() for a column of terms: the groups are a catalogue, the questions a table."""
    bare = F.filter(F.transform(asked, squash), lambda t: t != "")

    def strength(words: list[str]) -> Column:
        near = lambda t, w: (F.length(t) >= 2) & F.lit(len(w) >= 2) & (t.contains(w) | F.contains(F.lit(w), t))
        hit = lambda t, w: F.when(t == w, 100 + len(w)).when(near(t, w), len(w)).otherwise(0)
        return F.coalesce(F.array_max(F.transform(bare, lambda t: F.greatest(*(hit(t, w) for w in words), F.lit(0)))), F.lit(0))

    named = [["".join(w.split()) for w in group] for group in groups]
    ranked = [F.struct((-strength(words)).alias("strength"), F.lit(i).alias("i"), F.array(*map(F.lit, words)).alias("words")) for i, words in enumerate(named)]
    found = F.filter(F.array_sort(F.array(*ranked)), lambda g: g["strength"] < 0)
    return F.slice(F.array_except(F.flatten(F.transform(found, lambda g: g["words"])), bare), 1, limit)


def snippet(body: Column, term: str, before: int = 35, after: int = 70) -> Column:
    """The surroundings of a term's first place, which white space may interrupt: characters before and after it, with ellipses where text goes on."""
    loose = r"(?U)" + r"\s*".join("\\Q" + c + "\\E" for c in term.replace(" ", "") if c)
    at = F.regexp_instr(body, F.lit(loose))
    found = F.length(F.regexp_extract(body, loose, 0))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + found + after, F.length(body) + 1)
    piece = F.trim(body.substr(start, end - start))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), piece, F.when(end <= F.length(body), "…").otherwise("")))
