"""Text normalisation and matching, as columns. Patterns that meet white space ask for Unicode's."""

from __future__ import annotations

import contextlib
import json
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Korean particles that may follow a term, longest first.
PARTICLES = ("으로부터", "에서는", "이라는", "에서", "으로", "부터", "까지", "에게", "보다", "처럼", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def plain(c: Column) -> Column:
    """Text of HTML: control characters, comments, style and script blocks, tags, style rules in braces (four
    levels of nesting), entities and comment marks go; white space becomes single spaces."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<(style|script)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for _ in range(4):
        c = F.regexp_replace(c, r"\{[^{}]*[:;][^{}]*\}", " ")
    for entity, text in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        c = F.regexp_replace(c, f"&{entity};", text)
    c = F.regexp_replace(c, r"<!--|-->", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    """Search terms in order: word runs, one longest particle cut where two characters are left, at least two long, distinct."""
    words = F.split(c, r"[^\p{L}\p{N}]+")
    cut = lambda w: F.when(F.regexp_replace(w, f"({'|'.join(PARTICLES)})$", "").rlike("^..+"), F.regexp_replace(w, f"({'|'.join(PARTICLES)})$", "")).otherwise(w)
    return F.array_distinct(F.filter(F.transform(words, cut), lambda w: F.length(w) >= 2))


def chunks(c: Column, limit: int = 2000) -> Column:
    """Sentences packed greedily into pieces of at most `limit` characters; longer sentences are cut."""
    sentences = F.filter(F.split(c, r"(?<=[.!?。])(?U)\s+"), lambda s: s != "")
    parts = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(limit)), lambda i: F.substring(s, i, F.lit(limit)))))
    none = F.expr("CAST(array() AS array<string>)")

    def pack(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = (F.size(done) > 0) & (F.length(last) + 1 + F.length(s) <= limit)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(parts, none, pack)


def topics(c: Column, dictionary: dict[str, list[str]]) -> Column:
    """The topics with a keyword in the text, both without white space, in dictionary order."""
    bare = squash(c)
    hit = [F.when(F.exists(F.array(*[F.lit(w.replace(" ", "")) for w in words]), lambda w: bare.contains(w)), F.lit(t)) for t, words in dictionary.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def term_score(asked: list[str], title: Column, body: Column) -> Column:
    """2 for a term in the title, else 1 in the body."""
    total = F.lit(0)
    for t in asked:
        total = total + F.when(title.contains(t), 2).when(body.contains(t), 1).otherwise(0)
    return total


def sentence_with(c: Column, asked: str) -> Column:
    """The first sentence whose squashed text contains the squashed query."""
    return F.get(F.filter(F.split(c, r"(?<=[.!?])(?U)\s+"), lambda s: squash(s).contains(asked.replace(" ", ""))), F.lit(0))


def page_path(c: Column) -> Column:
    """First four segments of a hash path; `k=v` becomes `k=:id`, a segment with a digit `:id`."""
    segments = F.slice(F.filter(F.split(F.regexp_replace(c, r"^#", ""), "/"), lambda s: s != ""), 1, 4)
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.contains("="), F.concat(F.substring_index(s, "=", 1), F.lit("=:id"))).when(s.rlike(r"\d"), ":id").otherwise(s)), "/"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]+)", 1)), r"^www\.", "")


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://"), url).otherwise("#")


def redact(c: Column) -> Column:
    """Key and token values of query strings masked."""
    return F.regexp_replace(c, r"(?i)((?:api_?key|service_?key|token|auth)=)[^&\s]+", "$1***")


def device(ua: Column) -> Column:
    return F.when(ua.rlike(r"(?i)ipad|tablet|android(?!.*mobile)"), "tablet").when(ua.rlike(r"(?i)mobi|iphone|android"), "mobile").otherwise("desktop")


def is_bot(ua: Column) -> Column:
    return ua.isNull() | (ua == "") | ua.rlike(r"(?i)bot|crawl|spider|slurp|headless|preview|monitor|curl|wget|python")


def referrer_kind(name: Column) -> Column:
    label = lambda words: name.rlike(rf"(^|\.)({words})\.")
    return F.when(name.isNull() | (name == ""), "direct").when(label("facebook|instagram|twitter|x|youtube|kakao|linkedin|t"), "social").when(label("google|naver|daum|bing|yahoo|duckduckgo|zum"), "search").otherwise("link")


def bare_form(s: str | None) -> str:
    """NFKC without spaces and middle dots."""
    return unicodedata.normalize("NFKC", s or "").replace(" ", "").replace("·", "")


def automaton(forms: list[str]):
    """An Aho-Corasick automaton of the forms; its value at a hit is the form's place in the list."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, form in enumerate(forms):
        made.add_word(form, i)
    made.make_automaton()
    return made


def dictionary_matcher(dictionary: dict[str, str]):
    """A column function: the dictionary's keys found in a text as array of struct(key, axis), longest keys
    first, each at its first place that no longer key covers, in text order. One pass of an automaton
    finds all places of all keys, however many keys there are; only keys that are found take places. Texts and
    keys are taken in their bare form; texts come in Arrow batches."""
    by_form: dict[str, list[str]] = {}
    for key in sorted(dictionary):
        by_form.setdefault(bare_form(key), []).append(key)
    forms = sorted((f for f in by_form if f), key=lambda f: (-len(f), f))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("axis", T.StringType())])))
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found_in = automaton(forms) if forms else None
        for texts in batches:
            out = []
            for text in texts:
                bare, places, found = bare_form(text), {}, []
                for end, i in found_in.iter(bare) if forms else ():
                    places.setdefault(i, []).append(end + 1 - len(forms[i]))
                taken = bytearray(len(bare)) if places else b""
                for i in sorted(places):
                    size, free = len(forms[i]), iter(places[i])
                    for key in by_form[forms[i]]:
                        at = next((p for p in free if 1 not in taken[p : p + size]), None)
                        if at is None:
                            break
                        taken[at : at + size] = b"\x01" * size
                        found.append((at, key))
                out.append([{"key": k, "axis": dictionary[k]} for _, k in sorted(found)])
            yield pd.Series(out)

    return match


def topic_matcher(dictionary: dict[str, list[str]]):
    """topics() for large dictionaries: a column function that passes each text once, whatever the number of keywords."""
    topics_of: dict[str, set[int]] = {}
    for i, words in enumerate(dictionary.values()):
        for w in words:
            if bare := w.replace(" ", ""):
                topics_of.setdefault(bare, set()).add(i)
    forms, names = list(topics_of), list(dictionary)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found_in = automaton(forms) if forms else None
        for texts in batches:
            out = []
            for text in texts:
                found: set[int] = set()
                for _, i in found_in.iter("".join(text.split())) if forms and text else ():
                    found |= topics_of[forms[i]]
                out.append([names[i] for i in sorted(found)])
            yield pd.Series(out)

    return match


def _leaves(value, texts: list[str], figures: list[float]) -> None:
    if isinstance(value, str):
        texts.extend([value] if value else [])
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        figures.extend([float(value)] if math.isfinite(value) else [])
    elif isinstance(value, (list, dict)):
        for x in value if isinstance(value, list) else value.values():
            _leaves(x, texts, figures)


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("figures", T.ArrayType(T.DoubleType()))]))
def json_leaves(documents: pd.Series) -> pd.DataFrame:
    """All strings that aren't empty and all numbers in a JSON document, whatever its shape, in order; keys aren't
    among them. What isn't JSON has none."""
    rows = []
    for x in documents:
        texts, figures = [], []
        with contextlib.suppress(ValueError, TypeError):
            _leaves(json.loads(x), texts, figures)
        rows.append((texts, figures))
    return pd.DataFrame(rows, columns=["texts", "figures"])


def year_prefix(c: Column) -> Column:
    """The year that a date's text begins with."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")


def json_list(c: Column) -> Column:
    """A JSON array of strings; empty for anything that isn't one."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array()), lambda x: x.isNotNull())


def row_json(*columns: str) -> Column:
    """The columns of a row as one JSON object."""
    return F.to_json(F.struct(*columns))


def split_hit(c: Column) -> Column:
    """`axis:name` in its parts; a name may hold colons itself."""
    parts = F.split(c, ":", 2)
    return F.struct(parts[0].alias("axis"), parts[1].alias("name"))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """The usual named entities as characters."""
    for entity, text in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def clean(c: Column) -> Column:
    """A title of a search result: without its marks of emphasis, entities as characters."""
    return F.trim(unescaped(F.regexp_replace(c, "</?b>", "")))


def html_lines(c: Column) -> Column:
    """The lines of a fragment that line breaks and block tags part, without tags; blank ones are left out."""
    bare = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    cut = F.split(bare, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|tr|table|h[1-6])\b[^>]*>|\n")
    lines = F.transform(cut, lambda x: F.trim(F.regexp_replace(unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def find_date(c: Column) -> Column:
    """The first date of a fragment as year.month.day, or year.month where no day is printed."""
    at = lambda k: F.regexp_extract(c, r"(\d{4})\s*[.\-/년]\s*(\d{1,2})(?:\s*[.\-/월]\s*(\d{1,2}))?", k)
    made = F.concat_ws(".", at(1), at(2), F.nullif(at(3), F.lit("")))
    return F.when(at(1) != "", made)
