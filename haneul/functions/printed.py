"""Text as printed in releases: periods of titles, figures in lines, quotations. Columns, but for nfkc()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A figure of a printed table, and the marks that mean minus.
FIGURE = r"([-△▲−]?\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-△▲−]?\s?\d+(?:\.\d+)?)"
MINUS = "[△▲−]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatible composition, which has no built-in function."""
    return texts.str.normalize("NFKC")


def period_of_title(title: Column) -> Column:
    """'24년 3월' or '2024년 3월' in a title as yyyy-MM; null without one, or for a month that isn't."""
    year, month = F.regexp_extract(title, r"(\d{4}|\d{2})\s*년\s*(\d{1,2})\s*월", 1), F.regexp_extract(title, r"(\d{4}|\d{2})\s*년\s*(\d{1,2})\s*월", 2)
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    m = F.nullif(month, F.lit("")).cast("int")
    return F.when(m.between(1, 12), F.format_string("%s-%02d", y, m))


def unbolded(line: Column) -> Column:
    """A line whose every word is printed three times over (bold in some documents), letter by letter, once;
    any other line as it is, so 1,000 stays."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    thirds = lambda w: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)), F.lit(3)), lambda i: F.substring(w, i, F.lit(1))), "")
    tripled = lambda w: (F.length(w) % 3 == 0) & (F.regexp_replace(thirds(w), r"(?s)(.)", r"$1$1$1") == w)
    return F.when((F.size(words) > 0) & F.forall(words, tripled), F.array_join(F.transform(words, thirds), " ")).otherwise(line)


def row_label(line: Column) -> Column:
    """A table row's label: what stands before its first figure, without brackets and footnote marks."""
    bare = F.regexp_replace(line, r"\([^)]*\)|\[[^\]]*\]|\d+\)|[*†]", " ")
    return F.trim(F.regexp_replace(F.regexp_extract(bare, r"^([^0-9△▲−]*?)\s*(?:[-△▲−]?\s?\d.*)?$", 1), r"(?U)\s+", " "))


def row_figures(line: Column) -> Column:
    """A table row's figures in order; △ and ▲ mean minus; bracketed ones are notes and aren't taken."""
    bare = F.regexp_replace(line, r"\([^)]*\)|\[[^\]]*\]|\d+\)", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(FIGURE), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, MINUS, "-"), r"[,\s]", "").cast("double"))


def headline_change(text: Column) -> Column:
    """'27만 7천명 증가' as 277.0 (thousands); a decrease is negative, a text without a direction null."""
    part = lambda p: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(text, p, 1), ",", ""), F.lit("")).cast("double"), F.lit(0.0))
    n = part(r"([\d,.]+)\s*만") * 10 + part(r"([\d,.]+)\s*천\s*명") + part(r"만\s*(\d[\d,]*)\s*명") / 1000
    down, up = text.rlike("감소|줄"), text.rlike("증가|늘")
    return F.when(~text.rlike(r"\d\s*(만|천)"), None).when(down, -n).when(up, n)


def schedule_date(text: Column, year: int | Column) -> Column:
    """'2.9 (월)' or '2월 9일' of a year as a date; null if it isn't one."""
    at = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,2})\s*[.월]\s*(\d{1,2})", k), F.lit("")).cast("int"), F.lit(0))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year if isinstance(year, Column) else F.lit(year), at(1), at(2)), "yyyy-MM-dd")


def header_columns(header: Column) -> Column:
    """The columns of a printed header as array of struct(year, period): a year stands for the periods to its right
    until the next year; a year directly before another year, or last, is a column of its own, of the whole year."""
    words = F.filter(F.split(F.trim(header), r"(?U)\s+"), lambda w: w != "")
    year = lambda w: F.nullif(F.regexp_extract(w, r"^((?:19|20)\d{2})년?$", 1), F.lit("")).cast("int")
    seen = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("word"), year(w).alias("year")))
    shape = "struct<last:int,cols:array<struct<year:int,period:string>>>"
    start = F.struct(F.lit(None).cast("int").alias("last"), F.expr("CAST(array() AS array<struct<year:int,period:string>>)").alias("cols")).cast(shape)

    def step(state: Column, w: Column) -> Column:
        bare = w["year"].isNotNull()
        alone = bare & F.coalesce(year(F.get(words, w["i"] + 1)).isNotNull(), F.lit(False)) | bare & (w["i"] == F.size(words) - 1)
        own = F.struct(F.when(bare, w["year"]).otherwise(state["last"]).alias("year"), F.when(~bare, w["word"]).alias("period"))
        cols = F.when(~bare & state["last"].isNotNull() | alone, F.concat(state["cols"], F.array(own))).otherwise(state["cols"])
        return F.struct(F.when(bare, w["year"]).otherwise(state["last"]).alias("last"), cols.alias("cols")).cast(shape)

    return F.aggregate(seen, start, step)["cols"]


def tags_of(text: Column, tags: dict[str, list[str]], unrelated: list[str]) -> Column:
    """Tags with a word in the text, once words that merely contain one have been taken out."""
    bare = F.lower(text)
    for w in sorted(unrelated, key=len, reverse=True):
        bare = F.replace(bare, F.lit(w.lower()), F.lit(" "))
    hit = [F.when(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: bare.contains(w)), F.lit(t)) for t, words in tags.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def unknown_acronym(text: Column, known: list[str]) -> Column:
    """The first upper-case word that isn't a known acronym: a sign of bad character recognition."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-Z]{2,})(?![A-Za-z])"), F.lit(1))
    return F.get(F.filter(found, lambda w: ~w.isin(*known)), F.lit(0))


def quoted(quote: Column, source: Column, most: int = 300) -> Column:
    """Whether a source says a quotation word for word, but for white space and private-use characters; it must
    begin where a word does, be at most `most` long and not run over a blank line."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+|[\x{E000}-\x{F8FF}]", "")
    words = F.array_join(F.transform(F.split(F.trim(quote), r"(?U)\s+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("")), F.lit("\\E"))), r"[^\S\n]*\n?[^\S\n]*")
    begins = F.regexp_like(source, F.concat(F.lit(r"(?s)(?<![\p{L}\p{N}])"), words))
    return F.coalesce((F.length(quote) <= most) & (bare(quote) != "") & F.contains(bare(source), bare(quote)) & begins, F.lit(False))


def topic_particle(word: Column) -> Column:
    """은 after a final consonant, else 는; words that don't end in Hangul take 는."""
    code = F.ascii(F.substring(word, -1, 1))
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), "은").otherwise("는")


def trend_name(name: Column, same: dict[str, str]) -> Column:
    """A name without its last parenthesis, by its usual alias."""
    short = F.regexp_replace(name, r"(?U)\s*\(.*\)\s*$", "")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in same.items() for x in kv)), short), short) if same else short
