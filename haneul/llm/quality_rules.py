"""Quality rules whose thresholds adapt to each language and source.

Instead of fixed cutoffs, each measure's limit is read from a quantile sketch of its own
(language, source) group. A sketch is a table of counts over logarithmic bins (relative error
`ALPHA`), so sketches merge by adding counts: partial counts combine before the shuffle, and
those of languages and of all documents are sums of the groups'. Small groups lean on larger
ones by degrees: a language's sketch is its own counts and those of all documents as if they
were PRIOR rows, and a group's sketch is its own counts and its language's sketch as PRIOR rows.
No limit holds a constant share: each is a quantile of the group and a multiple of what the group
itself shows. Characters a word may lie WIDE spreads beyond the group's 20 % and 80 % quantiles, a
spread being half of the distance between these; it counts as half of the spread over all documents at
least, so a group that consists of copies doesn't lose the rest. Symbols a word are counted in the same
unit: they may exceed the group's 80 % quantile by NARROW spreads of its characters a word.
Repeated lines and words are zero in most texts, so their limit comes from the group's texts that
have any: FAR times the 95 % quantile of these; a group in which no text has any drops none.

Nulls: a null text has no words and fails the base rule; null languages and sources form
groups of their own. Empty tables give empty results; repeated rows count as rows each; a very
long text is measured whole, in memory of a few times its length. Other columns pass through;
those named quality_measures, base_failed or kept are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, materialize, sliced, spread_join, words_of

#: Fixed values of the contract.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = pa.struct([(x, pa.int64()) for x in (*BASE, "n_lines")])

#: Relative error of a quantile, and the sketch's resulting base.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Rows that the larger group's sketch counts as in a smaller one's.
PRIOR = 200
#: The bin of zeros.
ZERO = -1_000_000
#: Spreads that characters and symbols a word may lie beyond the group's bulk; times the 95 % quantile for repeated lines and words.
WIDE, NARROW, FAR = 8.0, 2.0, 3.0
#: Quantiles of all texts, and of those with a value above zero; the part of the spread over all documents that counts in any group.
OF_ALL, OF_POSITIVE, LEAST = (0.2, 0.8), (0.95,), 0.5
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The base measures of one whole text."""
    return all_measures(text)[:5]


def all_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base measures of one whole text, and its number of lines that hold a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    repeats = 0
    if len(ids) > 3:
        n = len(seen)
        if n < 2_000_000:
            windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        if twice.any():
            covered = np.zeros(len(ids), bool)
            for k in range(3):
                covered[k : len(ids) - 2 + k] |= twice
            repeats = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


@arrow_column("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>")
def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [all_measures(t) for part in sliced(texts) for t in part]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, fields=list(_TYPE))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _values(m: str) -> dict[str, Column]:
    f = lambda x: F.col(f"{m}.{x}").cast("double")
    n, lines = F.greatest(f("n_words"), F.lit(1.0)), F.greatest(f("n_lines"), F.lit(1.0))
    return {"symbol_share": f("n_symbols") / n, "dup_line_share": f("n_dup_lines") / lines, "repeat_share": f("n_repeat_words") / n, "word_length": f("word_chars") / n}


def sketch(df: DataFrame, groups: list[str], m: str) -> DataFrame:
    """Counts of each measure by logarithmic bin, a row per (group, measure, bin): a mergeable quantile sketch.
    Bin ZERO holds zeros; else bin b holds values in (GAMMA^(b-1), GAMMA^b]."""
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.when(v > 0, F.ceil(F.log(v) / math.log(GAMMA))).otherwise(ZERO).cast("int").alias("bin")) for k, v in _values(m).items()]))
    return df.select(*groups, bins.alias("x")).groupBy(*groups, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def _arrays(sketches: DataFrame, groups: list[str], out: str) -> DataFrame:
    """A row per (group, measure): the array of (bin, w) and its sum; a sketch's bins are a bounded number."""
    merged = sketches.groupBy(*groups, "measure", "bin").agg(F.sum("n").cast("double").alias("n"))
    return merged.groupBy(*groups, "measure").agg(F.collect_list(F.struct("bin", F.col("n").alias("w"))).alias(out), F.sum("n").alias(f"{out}_total"))


def _as_rows(bins: str, total: Column, rows: float) -> Column:
    """The sketch's bins, weighing `rows` rows together."""
    return F.transform(bins, lambda b: F.struct(b["bin"].alias("bin"), (b["w"] * rows / total).alias("w")))


def quantile(bins: Column, total: Column, q: float) -> Column:
    """The value below which a part q of the weights lies: the middle of the first bin that reaches it. Sums
    that differ from q by rounding alone reach it."""
    need = F.lit(q) * total * (1 - 1e-9)
    state = F.aggregate(bins, F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("int").alias("bin")), lambda s, b: F.struct((s["w"] + b["w"]).alias("w"), F.when(s["bin"].isNull() & (s["w"] + b["w"] >= need), b["bin"]).otherwise(s["bin"]).alias("bin")))["bin"]
    return F.when(state == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), state.cast("double")) / (1 + GAMMA))


def limits(finest: DataFrame, prior: float = PRIOR) -> DataFrame:
    """A row per (language, source): its map of measure to (low, high). finest: the groups' sketches."""
    own = _arrays(finest, ["_hn_lang", "_hn_source"], "own")
    lang = _arrays(finest, ["_hn_lang"], "of_lang")
    overall = _arrays(finest, [], "of_all")
    whole = F.sort_array("of_all")
    lang = lang.join(overall, "measure").withColumn("of_all_spread", (quantile(whole, F.col("of_all_total"), OF_ALL[1]) - quantile(whole, F.col("of_all_total"), OF_ALL[0])) / 2).withColumn("of_lang", F.concat("of_lang", _as_rows("of_all", F.col("of_all_total"), prior)))
    both = own.join(lang.select("_hn_lang", "measure", "of_lang", "of_lang_total", "of_all_spread"), ["_hn_lang", "measure"])
    both = both.withColumn("bins", F.sort_array(F.concat("own", _as_rows("of_lang", F.col("of_lang_total") + prior, prior))))
    total = F.col("own_total") + prior
    weight = lambda bins: F.aggregate(bins, F.lit(0.0), lambda w, b: w + b["w"])
    both = both.withColumn("positive", F.filter("bins", lambda b: b["bin"] != ZERO)).withColumn("positive_total", weight("positive"))
    q = F.struct(*(quantile(F.col("bins"), total, p).alias(f"q{round(100 * p)}") for p in OF_ALL), *(quantile(F.col("positive"), F.col("positive_total"), p).alias(f"p{round(100 * p)}") for p in OF_POSITIVE), F.col("of_all_spread").alias("all"))
    rows = both.groupBy("_hn_lang", "_hn_source").agg(F.map_from_entries(F.collect_list(F.struct("measure", q.alias("q")))).alias("q"))  # four measures
    of = lambda m, x: F.col("q")[m][x]
    spread = F.greatest((of("word_length", "q80") - of("word_length", "q20")) / 2, LEAST * of("word_length", "all"))
    limit = lambda low, high: F.struct((low / GAMMA).alias("low"), (high * GAMMA).alias("high"))  # a bin further, as far as quantiles may err
    far = lambda m: limit(F.lit(-1.0), FAR * of(m, "p95"))
    limits_ = {
        "symbol_share": limit(F.lit(-1.0), of("symbol_share", "q80") + NARROW * spread), "dup_line_share": far("dup_line_share"), "repeat_share": far("repeat_share"),
        "word_length": limit(of("word_length", "q20") - WIDE * spread, of("word_length", "q80") + WIDE * spread),
    }
    return rows.select("_hn_lang", "_hn_source", F.create_map(*(x for m in MEASURES for x in (F.lit(m), limits_[m]))).alias("_hn_limits"))


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", prior: float = PRIOR, keep_text: bool = True) -> DataFrame:
    """docs with the struct `quality_measures`, `base_failed` and `kept`.

    The measures are computed in one pass and their small rows (no text) are written to the
    shared folder, from which the sketches are counted. With keep_text they are computed anew
    beside each text instead of being joined to it, which would shuffle every text."""
    groups = {"_hn_lang": F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")), "_hn_source": F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))}
    own = materialize(docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in groups.items()), measures(F.col(text_col)).alias("quality_measures")), "measures")
    failed = base_failed(F.col("quality_measures.n_words"), F.col("quality_measures.n_repeat_words"))
    finest = materialize(sketch(own.where(~failed), ["_hn_lang", "_hn_source"], "quality_measures"), "sketch")
    of_group = materialize(limits(finest, prior), "limits")
    rows = docs.withColumns(groups | {"quality_measures": measures(F.col(text_col))}) if keep_text else own.withColumnRenamed("id", id_col)
    rows = spread_join(rows, of_group, ["_hn_lang", "_hn_source"], "left", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    inside = F.lit(True)
    for k, v in _values("quality_measures").items():
        limit = F.element_at("_hn_limits", k)
        inside = inside & F.coalesce((v <= limit["high"]) & (v >= limit["low"]), F.lit(True))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & inside}).drop("_hn_lang", "_hn_source", "_hn_limits")
