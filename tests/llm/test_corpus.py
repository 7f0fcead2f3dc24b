"""The corpus operators against brute force, libraries and exact round trips, with the edge cases of each docstring."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haneul.llm import bpe, chat, common, html_main, mixing, nbsvm, oracles, probminhash, quality_rules, queries, sketches, token_store, warc
from haneul.llm.shingles import WordHashes, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LONG = "Seven long words make this line of text. " * 2_000
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 15, 0.5, "x"), (2, "a b c d e f g h", "en", "s1", 15, 0.5, "x"), (2, "a b c d e f g h", "en", "s1", 15, 0.5, "x"),
    (3, None, "en", None, None, None, None), (4, "", None, "s2", 0, None, None), (5, "   \n\t ", "de", "s2", 6, None, None),
    (6, LONG, "en", "s1", len(LONG), None, None), (7, "one", "en", "s3", 3, None, None), (None, "no id here but words", "en", "s1", 4, None, None),
    (8, "Éa ßtraße ΣΑΣ 日本語 <|endoftext|> it's", "fr", "s1", 9, None, None), (9, "one", "en", "s3", 3, None, None),
]
WS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- WARC


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset long")


def test_warc_round_trip(spark):
    rows = [(5, "http://a/1", "<p>x</p>", "f", 1), (2, "http://a/2", "<p>x</p>", "f", 1), (2, "http://a/2", "<p>x</p>", "f", 1), (7, None, None, None, None), (8, "u\r\nv", "", "", 0), (9, "http://b", "é" * 50_000, "", 0), (None, "n", "<p>x</p>", "", 0), (None, "n", "alone", "", 0)]
    root = common.fresh_dir(spark, "t")
    index = warc.write_warc(_pages(spark, rows), root)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_warc(index, root).collect()), key=str)
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == collections.Counter((i, len((h or "").encode()), digest(h)) for i, _, h, _, _ in rows)
    of = {k: [(r[3], r[4]) for r in got if r[2] == digest(k)] for k in ("<p>x</p>", "", "alone")}
    assert sorted(of["<p>x</p>"], key=str) == [("response", None), ("revisit", 2), ("revisit", 2), ("revisit", 2)]
    assert sorted(of[""], key=str) == [("response", None), ("revisit", 7)]
    assert all(r[5] == "é" * 50_000 for r in got if r[0] == 9)
    one = index.where("page_id = 9")
    assert [r.page_id for r in warc.read_warc(one, root).collect()] == [9]


def test_warc_min_bytes_and_empty(spark):
    root = common.fresh_dir(spark, "t")
    got = warc.read_warc(warc.write_warc(_pages(spark, [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0)]), root, min_bytes=3), root)
    assert {r.record_type for r in got.collect()} == {"response"}
    root = common.fresh_dir(spark, "t")
    assert warc.read_warc(warc.write_warc(_pages(spark, []), root), root).count() == 0


def test_warc_query_is_whole(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in queries.op1_warc(spark, sf).collect():
        body = pages.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[body] == r.page_id else ("revisit", first[body]))
    assert not pages


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    made = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in made.description]
    rows = queries.queries()[name](spark, sf)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows.collect()))) == sorted(map(repr, made.fetchall()))


# -- quality classifier


def test_classifier_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in known]) > 0.95


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = nbsvm.train(docs, none)
    assert {round(r.s, 6) for r in nbsvm.score(docs, model, out="s").collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 7, 1)], "doc_id long, quality int, toxic int")
    assert nbsvm.score(docs, nbsvm.train(docs, odd), out="s").count() == len(ROWS)
    assert nbsvm.score(empty, model).count() == 0
    assert nbsvm.train(empty, odd).slope == 0.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=40))
def test_indicators_by_brute_force(text):
    raw, want = text.encode(), set()
    for n, odd in enumerate(nbsvm._ODD, 1):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big")
            want.add(((code * odd + (n - 1) * 0x632BE5AB) % 2**32) >> (32 - nbsvm.BITS))
    words = raw.split()
    for n, first in nbsvm.PATTERNS.items():
        for i in range(len(words) - n + 1):
            pairs = [words[i + a] == words[i + b] for a in range(n) for b in range(a + 1, n)]
            want.add(first + sum(x << k for k, x in enumerate(pairs)))
    assert nbsvm.features(text).tolist() == sorted(want)


def test_ratios_margins_and_curve_by_brute_force():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(80)]
    labels = (rng.random(80) < 0.7).astype(int)
    r = nbsvm.log_count_ratio(rows, labels, 1.0)
    count = lambda y: np.array([1.0 + sum(k in x for x, own in zip(rows, labels) if own == y) for k in range(30)] + [1.0] * (nbsvm.SIZE - 30))
    p, q = count(1), count(0)
    assert np.allclose(r, np.log(p / p.sum()) - np.log(q / q.sum()))
    w = rng.normal(size=nbsvm.SIZE)
    model = nbsvm.Model(w * r, r**2, 0.3, 1.0, 0.0)
    for x in rows[:10]:
        row = np.append(r[x], 1.0)  # the scaled indicators and the bias, at unit length
        assert np.isclose(model.margin(x), np.append(w[x], 0.3) @ row / np.linalg.norm(row))
    margins = rng.normal(size=80) + labels
    a, b = nbsvm.platt(margins, labels)
    t = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum() + 0.005 * (a - 1) ** 2

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_long_texts_are_told_apart(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = nbsvm.train(docs, labels)
    texts = collections.defaultdict(list)
    for r in docs.where("lang = 'en'").join(labels, "doc_id").collect():
        texts[r.quality].append(r.text)
    rng = random.Random(2)
    for y in (0, 1):  # some hundred thousand characters of one class
        scores = [model.score("\n".join(rng.choice(texts[y]) for _ in range(120))) for _ in range(5)]
        assert all((s >= 0.5) == y for s in scores)


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    y = np.array([1.0 if (x < 20).mean() > 0.5 else -1.0 for x in rows])
    r, cost = np.ones(nbsvm.DIM), np.full(60, 1.0)
    w, b = nbsvm.dual_coordinate_descent(rows, y, r, cost, 2000, 1e-6)  # r is 1: weights and scaled weights are the same
    scale = [1 / np.sqrt(len(x) + 1) for x in rows]

    def primal(w, b):
        return 0.5 * ((w**2).sum() + b * b) + sum(max(0, 1 - yi * s * (w[x].sum() + b)) for x, yi, s in zip(rows, y, scale))

    best = primal(w, b)
    for _ in range(200):
        step = np.zeros(nbsvm.DIM)
        step[:40] = rng.normal(0, 0.05, 40)
        assert primal(w + step, b + rng.normal(0, 0.05)) >= best - 1e-3


# -- quality rules


def _measure(text):
    words = re.findall(WS, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WS, x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#|é　\x1c", max_size=80))
def test_measures(text):
    assert quality_rules.measure_text(text) == _measure(text)


def test_rules(spark, docs, empty, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = _measure(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty).count() == 0
    got = quality_rules.apply_rules(docs)  # its column kept is replaced
    assert got.count() == len(ROWS) and dict(got.dtypes)["kept"] == "boolean" and got.where("kept and base_failed").count() == 0


def _quantile(bins, q):
    total, cum = sum(bins.values()), 0.0
    for b in sorted(bins):
        cum += bins[b]
        if cum >= q * total * (1 - 1e-9):
            return 0.0 if b == quality_rules.ZERO else 2 * quality_rules.GAMMA**b / (1 + quality_rules.GAMMA)


def test_sketches_merge_and_limits_lean_on_larger_groups(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [(l, s, (100, 400 + int(v) // 3, int(v), max(0, int(v) % 10 - 7), 0, 10)) for l, s, n, top in (("a", "x", 900, 300), ("a", "y", 30, 20), ("b", "x", 60, 90), ("b", "z", 1, 5)) for v in rng.integers(0, top, n)]
    df = spark.createDataFrame(rows, "_hn_lang string, _hn_source string, m struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>")
    groups = ["_hn_lang", "_hn_source"]
    whole = quality_rules.sketch(df, groups, "m")
    halves = quality_rules.sketch(df.where(F.col("m.n_symbols") % 2 == 0), groups, "m").unionByName(quality_rules.sketch(df.where(F.col("m.n_symbols") % 2 == 1), groups, "m"))
    read = lambda x, prior: {(r._hn_lang, r._hn_source): {k: (v.low, v.high) for k, v in r._hn_limits.items()} for r in quality_rules.limits(x, prior).collect()}
    assert read(whole, 50) == read(halves, 50)
    bins = {"sym": collections.defaultdict(collections.Counter), "dup": collections.defaultdict(collections.Counter), "len": collections.defaultdict(collections.Counter)}
    for l, s, m in rows:
        for name, v in (("sym", m[2] / 100), ("dup", m[3] / 10), ("len", m[1] / 100)):
            b = int(np.ceil(np.log(v) / np.log(quality_rules.GAMMA))) if v else quality_rules.ZERO
            for k in ((l, s), l, None):
                bins[name][k][b] += 1
    lean = lambda own, on, prior: {b: own.get(b, 0) + on.get(b, 0) * prior / sum(on.values()) for b in {*own, *on}}
    g = quality_rules.GAMMA
    above = lambda own: {b: w for b, w in own.items() if b != quality_rules.ZERO}
    for prior in (0.001, 50, 1000):
        for (l, s), found in read(whole, prior).items():
            own = {k: lean(x[l, s], lean(x[l], x[None], prior), prior) for k, x in bins.items()}
            spread = max((_quantile(own["len"], 0.8) - _quantile(own["len"], 0.2)) / 2, (_quantile(bins["len"][None], 0.8) - _quantile(bins["len"][None], 0.2)) / 4)
            assert found["symbol_share"] == (-1 / g, pytest.approx(g * (_quantile(own["sym"], 0.8) + 2 * spread)))
            assert found["word_length"] == (pytest.approx((_quantile(own["len"], 0.2) - 8 * spread) / g), pytest.approx(g * (_quantile(own["len"], 0.8) + 8 * spread)))
            assert found["dup_line_share"] == (-1 / g, pytest.approx(g * 3 * _quantile(above(own["dup"]), 0.95))) and found["repeat_share"] == (-1 / g, None)
    values = np.sort([m[2] for l, s, m in rows if (l, s) == ("a", "x")]) / 100
    words = np.sort([m[1] for l, s, m in rows if (l, s) == ("a", "x")]) / 100
    exact = lambda x, p: x[int(np.ceil(p * len(x))) - 1]
    assert abs(read(whole, 0.001)["a", "x"]["symbol_share"][1] - g * (exact(values, 0.8) + exact(words, 0.8) - exact(words, 0.2))) < 0.2


def test_limits_differ_and_decide_on_the_data(spark, sf):
    """At the size of the data here: groups have limits of their own on three measures at least, most of the marked junk goes and marked good texts stay."""
    from pyspark.sql import functions as F

    d = queries.table(spark, sf.replace("sf0.001", "sf0.1"), "documents")
    found = quality_rules.apply_rules(d, keep_text=False).join(queries.table(spark, sf.replace("sf0.001", "sf0.1"), "labels"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in found.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert counts[0, False] > 0.9 * (counts[0, False] + counts[0, True]) and counts.get((1, False), 0) < 0.002 * counts[1, True]
    groups = {"_hn_lang": F.concat(F.lit("="), "lang"), "_hn_source": F.concat(F.lit("="), "source")}
    own = d.select(*(c.alias(k) for k, c in groups.items()), quality_rules.measures(F.col("text")).alias("m")).where("m.n_words >= 50 and 2 * m.n_repeat_words <= m.n_words")
    limits = [r._hn_limits for r in quality_rules.limits(quality_rules.sketch(own, list(groups), "m")).collect()]
    assert len(limits) > 50 and sum(len({x[m].high for x in limits}) > 3 for m in quality_rules.MEASURES) >= 3


def test_short_repeated_lines_decide(spark):
    said = iter(range(100_000, 10**6))
    own = lambda lines, words: [" ".join(f"w{next(said)}" for _ in range(words)) for _ in range(lines)]
    rows = [(i, "\n".join([*own(20, 40), *["Share", "it"] * (1 + i % 3)]), "en", "s") for i in range(200)]
    rows.append((200, "\n".join([x for line in own(40, 100) for x in (line, "Share")] + ["Share"] * 20), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert got[200].quality_measures.n_dup_lines == 59 and got[200].quality_measures.n_lines == 100 and not got[200].base_failed
    assert {i for i in got if not got[i].kept} == {200}


def test_a_group_of_copies_keeps_the_rest(spark, sf):
    """A third of all rows are copies of one text, in one source: its other documents stay as they did."""
    from pyspark.sql import functions as F

    d = queries.table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    one = d.where("n_chars between 1500 and 2500 and lang = 'en'").orderBy("doc_id").limit(1)
    copies = one.select(F.explode(F.expr("sequence(1000001L, 1000500L)")).alias("doc_id"), "text", "lang", F.lit("src0").alias("source"), "n_chars")
    lost = lambda x: {r.doc_id for r in quality_rules.apply_rules(x, keep_text=False).where("not kept and not base_failed").select("doc_id").collect()}
    good = {r.doc_id for r in queries.table(spark, sf.replace("sf0.001", "sf0.01"), "labels").where("quality = 1").collect()}
    assert len(lost(d.unionByName(copies)) & good) <= 1


def test_thresholds_are_those_of_the_language_and_source(spark):
    said = iter(range(10**6))
    text = lambda symbols: " ".join(f"w{next(said)}{'#' * (k < symbols)}" for k in range(100))
    rows = [(k, text(30 + k % 5), "en", "code") for k in range(300)] + [(1000 + k, text(k % 3), "en", "news") for k in range(300)]
    rows += [(5000, text(40), "en", "code"), (5001, text(40), "en", "news")]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior=20).collect()}
    assert got[5000] and {i for i in got if not got[i]} == {5001}


# -- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def index():
    return bpe.PairIndex(queries.tokenizer_path())


@pytest.fixture(scope="module")
def store():
    return token_store.LibraryEncoder(queries.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="aàá́ÀIİıſKß'sT t\n<|endoft>xΣσς　\x85​ 한中١²Ⅷ🙂", max_size=50)))
def test_bpe_equals_the_library(index, store, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert index.encode_batch([text]).to_pylist() == [want]
    names = bpe.worker_names(queries.tokenizer_path())
    assert names.decode_batch(pa.array([want, None, [], [-1, *want, 10**6]], pa.list_(pa.int32()))).to_pylist() == [said := library.decode(want, skip_special_tokens=False), "", "", said]
    assert store.encode([text, None, text])[0].tolist() == want + want


def test_bpe_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_edges(docs, empty, library):
    path = queries.tokenizer_path()
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(got) == len(ROWS) and all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert bpe.encode(empty, path).count() == 0
    assert bpe.PairIndex(path).encode_batch(["a" * 100_000]).to_pylist()[0] == library.encode("a" * 100_000, add_special_tokens=False).ids


# -- token store


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=30))
def test_codes_round_trip(lists):
    ids = np.array([x for own in lists for x in own], np.uint32)
    ends = np.cumsum([len(x) for x in lists]).tolist()
    f = token_store.TokenFile(token_store.pack(ids, list(range(len(lists))), ends))
    assert [f[i] for i in range(len(ids))] == ids.tolist()
    for s, e, own in zip([0, *ends], ends, lists):
        assert f.slice(s, e).tolist() == own


def test_token_store_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, start = {r.doc_id: r for r in queries.op5_token_store(spark, sf).collect()}, 0
    for i in sorted(texts):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_edges(spark, docs, empty, library):
    root = common.fresh_dir(spark, "t")
    manifest = token_store.write_tokens(docs, root, queries.tokenizer_path(), rows_per_range=3, max_ids=20)
    rows = sorted(token_store.read_tokens(manifest, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    of = {r[0]: r[1] for r in ROWS}
    assert all(list(r.ids) == library.encode(of[r.doc_id] or "", add_special_tokens=False).ids + [2] for r in rows)
    root = common.fresh_dir(spark, "t")
    assert token_store.read_tokens(token_store.write_tokens(empty, root, queries.tokenizer_path()), root).count() == 0


# -- chat


def test_quotes_are_linked(spark):
    said = "The plan is fine.\nShip it on Monday."
    rows = [
        (1, 0, "user", said, "x"), (1, 1, "assistant", "Second thought.", "x"), (1, 2, "user", "Other talk.", "x"), (1, 3, "user", "> the  PLAN is fine\n> ship it on monday\n\nAgreed!", "x"),
        (1, 4, "user", "> > Second thought!\n> Agreed!\nYes.\n> never said", "x"), (2, 0, "user", "> Agreed!\nno link here", "x"), (3, 0, None, None, "x"), (3, None, "user", "late", "x"), (None, 0, "user", "> q", "x"), (4, 1, "user", "same", "x"), (4, 1, "user", "same", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    got = {(r.conv_id, r.turn): r for r in chat.reply_order(df).collect() if r.conv_id == 1}
    assert got[1, 3].reply_to == 0 and got[1, 3].content == "Agreed!" and (got[1, 3].n_quotes, got[1, 3].n_linked) == (1, 1)
    assert got[1, 4].reply_to == 3 and got[1, 4].content == "Yes." and (got[1, 4].n_quotes, got[1, 4].n_linked) == (3, 2)
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position)] == [0, 1, 3, 2, 4]
    made = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert made[1].turns == "0 1 3 2 4" and made[2].n_linked == 0 and made[3].turns == "0 ?" and made[4].n_messages == 2 and made[None].n_messages == 1
    assert made[3].chat.startswith("<|unknown|>\n<|end|>")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_trimmed_quotes_are_linked(spark):
    lines = [f"Line {k} of the plan." for k in range(4)]
    paragraphs = ["First matter,\nin two lines.", "Second matter.", "Third matter."]
    rows = [
        (1, 0, "user", "\n".join(lines)), (1, 1, "assistant", "\n\n".join(paragraphs)), (1, 2, "user", lines[0] + "\nOther talk."), (1, 3, "user", "More talk."),
        (1, 4, "user", f"> {lines[0]}\n> {lines[1]}\nYes."), (1, 5, "user", "> First matter, in\n> two lines.\n>\n> Second matter.\nNo."),
        (1, 6, "user", f"> {lines[2]}\n> not said\nHalf."), (1, 7, "user", "\n".join(lines[:3])), (1, 8, "user", f"> {lines[1]}\n> {lines[2]}\nLater."),
    ]
    got = {r.turn: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: got[t].reply_to for t in (4, 5, 6, 8)} == {4: 0, 5: 1, 6: None, 8: 7}
    assert {t: (got[t].n_quotes, got[t].n_linked) for t in (4, 5, 6, 8)} == {4: (1, 1), 5: (1, 1), 6: (1, 0), 8: (1, 1)}


def _norm(x):
    return " ".join(re.findall(r"[^\W_]+", x.lower()))


def _units(own):
    return {u for u in map(_norm, [own, *re.split(r"\n\s*\n", own), *own.split("\n")]) if u}


def _linked(rows):
    """Brute force: (turn, text) -> (reply_to, quotes, linked, content) of one conversation, every quote against every earlier message."""
    said = {}
    for turn, text in rows:
        own = "\n".join(x for x in (text or "").split("\n") if not re.match(r"\s*>", x)).strip()
        if turn is not None:
            said.setdefault(turn, set()).update(_units(own))
    out = {}
    for turn, text in rows:
        passages, before = [], None
        for x in (text or "").split("\n"):
            level = re.match(r"(\s*(?:>\s?)*)", x)[1].count(">")
            if level:
                plain = re.sub(r"^\s*(?:>\s?)*", "", x)
                if level == before:
                    passages[-1][1].append(plain)
                else:
                    passages.append((level, [plain]))
            before = level
        found = []
        for level, lines in passages if turn is not None else []:
            whole = [t for t, units in said.items() if _norm("\n".join(lines)) in units]
            at = min(whole, default=None)
            if at is None or at >= turn:
                blocks = [(_norm(b), [n for n in map(_norm, b.split("\n")) if n]) for b in re.split(r"\n\s*\n", "\n".join(lines))]
                each = [(b, n) for b, own in blocks for n in own]
                scores = [(sum(b in said[t] or n in said[t] for b, n in each), t) for t in said if t < turn]
                best = max((x for x in scores if 2 * x[0] > len(each)), default=None)
                at = best[1] if best else None
            found.append((level, at))
        linked = [(level, -at) for level, at in found if at is not None]
        own = "\n".join(x for x in (text or "").split("\n") if not re.match(r"\s*>", x)).strip()
        out[turn, text] = (-min(linked)[1] if linked else None, len(found), len(linked), own)
    return out


def _conversations():
    """Generated talks with nested, trimmed and altered quotes, null and repeated turns, as (conv_id, turn, role, text)."""
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        talk = []
        for turn in range(rng.randrange(1, 14)):
            lines = []
            for _ in range(rng.randrange(3)):  # quotes of earlier messages, their lines trimmed, nested or altered
                if talk:
                    cut = rng.choice(talk)[1].split("\n")
                    k = rng.randrange(len(cut))
                    mark = rng.choice(["> ", "> > ", ">", " >> "])
                    lines += [mark + (x.upper() if rng.random() < 0.2 else x + "?" if rng.random() < 0.5 else "never said") for x in cut[k : k + rng.randrange(1, 4)]]
                    lines += [""] * rng.randrange(2)
            lines += [rng.choice(["", "Yes.", "Agreed, all of it.", f"Line {rng.randrange(6)} of the plan.", f"Own words {rng.randrange(10**6)}."]) for _ in range(rng.randrange(5))]
            talk.append((turn if rng.random() < 0.95 else None, "\n".join(lines)))
            if rng.random() < 0.1:
                talk.append((turn, rng.choice([talk[-1][1], "Another voice."])))
        rows += [(conv, t, rng.choice(["user", "assistant"]), x) for t, x in talk]
    return rows


def test_chat_sql_links_the_same(spark, tmp_path):
    seen = set()
    rows = [r for r in _conversations() if not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]  # ties are ordered by a hash here
    df = spark.createDataFrame([*rows, (None, 1, "user", "> q"), (70, 0, None, None), (70, 1, "user", "> ")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    made = con.execute(oracles.OP6)
    names = [d[0] for d in made.description]
    want, got = made.fetchall(), [tuple(r[c] for c in names) for r in chat.format_chats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[names.index("n_linked")] for r in want) > 100


def test_links_by_brute_force(spark):
    rows = _conversations()
    got = chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    want = collections.Counter((c, t, *w) for c in range(60) for own in [[(t, x) for i, t, _, x in rows if i == c]] for t, x in own for w in [_linked(own)[t, x]])
    assert collections.Counter((r.conv_id, r.turn, r.reply_to, r.n_quotes, r.n_linked, r.content) for r in got) == want
    assert sum(k[4] * n for k, n in want.items()) > 100
    for c in range(60):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        at = [(1 << 62) - 1 if r.reply_to is None and r.turn is None else r.turn - 1 if r.reply_to is None else r.reply_to for r in own]
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and at == sorted(at)


def test_replies_to_one_post_spread_over_tasks(spark):
    df = spark.range(3000).selectExpr("1L conv_id", "id turn", "'user' role", "case when id = 0 then 'First post here.' else concat('> First post here.\nReply ', id) end text")
    got = sorted(chat.reply_order(df).collect(), key=lambda r: r.position)
    assert [r.turn for r in got] == list(range(3000)) and {r.reply_to for r in got[1:]} == {0}


def test_long_conversations_come_in_parts(spark):
    df = spark.range(2500).selectExpr("7L conv_id", "id turn", "'user' role", "concat('m', id) text")
    parts = sorted(chat.format_chats(df).collect(), key=lambda r: r.part)
    assert [r.n_messages for r in parts] == [256] * 9 + [196]
    assert " ".join(r.turns for r in parts).split() == [str(i) for i in range(2500)]


# -- mixing


def _targets(sizes, weights=(5, 2, 1), share=1.5, top=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > top * sizes[s] or sizes[s] == 0}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = top * sizes[s]
        free, left = free - over, left - sum(top * sizes[s] for s in over)
    return out


@pytest.mark.parametrize("which", ["data", "odd"])
def test_mixing(spark, sf, docs, which):
    df = spark.read.parquet(f"{sf}/documents.parquet") if which == "data" else docs
    plan = mixing.plan_mix(df)
    rows = plan.collect()
    own = [(r.source, len(re.findall(WS, r.text or ""))) for r in df.collect()]
    sizes = collections.Counter()
    for s, n in own:
        sizes[s] += n
    want = _targets(dict(sizes))
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert sum(c.words for c in r.copies) == r.taken and all(0 <= c.position < 1 for c in r.copies)
        taken[r.source] += r.taken
    assert len(rows) == len(own) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {(r.doc_id, r.size): r.taken for r in mixing.plan_mix(df.repartition(7)).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in rows)


def test_schedule_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3).withColumn("rank", F.col("id")).crossJoin(spark.range(101).select((F.col("id") / 101).alias("u"))).select("rank", "u", mixing.invert(F.col("u"), mixing.segments()).alias("t")).collect()
    for r in rows:
        knots = mixing.SCHEDULES[r.rank]
        x = np.linspace(0, 1, 20001)
        w = np.interp(x, *zip(*knots))
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(x))])
        assert abs(np.interp(r.t, x, done / done[-1]) - r.u) < 1e-6


def test_mix_repeats_and_orders(spark, empty):
    df = spark.createDataFrame([(i, "w " * 20, "s%d" % (i % 3)) for i in range(60)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    n = collections.Counter(r.source for r in got)
    assert n["s0"] == 40 and abs(sum(n.values()) - 90) <= 2
    places = {(r.doc_id, c.copy): c.position for r in mixing.plan_mix(df).collect() for c in r.copies if 2 * c.words >= r.size}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in places)
    assert [r.doc_id for r in got] == [i for (i, _), _ in sorted(places.items(), key=lambda x: (x[1], x[0][0]))]
    assert mixing.plan_mix(empty).count() == mixing.mix(empty).count() == 0


def test_mix_takes_rows_and_not_ids(spark):
    df = spark.createDataFrame([(1, "a " * 30, "s"), (1, "b " * 10, "s"), (1, "b " * 10, "s"), (None, "c " * 5, None), (None, None, None)], "doc_id long, text string, source string")
    got = collections.Counter((r.text or "")[:1] for r in mixing.mix(df, share=2.0).collect())
    assert got == {"a": 2, "b": 4, "c": 2} and mixing.mix(df).columns == df.columns


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 5, 50, 500, 5000]) for k in range(700)} | {None: 40}
    rows = [(f"={s}" if s else "", s, n) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "key string, source string, source_size long").repartition(5), (5, 2, 1), 1.5, 2).collect()
    want = _targets(sizes)
    assert len(got) == len(want) and all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got)


# -- near duplicates


def _classes(rows, threshold=0.8):
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None and r[0] is not None)):
        first.setdefault(t, i)
    sets = {}
    for t, i in first.items():
        w = re.findall(r"\w+", t.lower()) or t.split()
        k = min(5, len(w))
        sets.setdefault(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {(i, t): top(first[t]) if t is not None and i is not None else i for i, t in rows}


def test_near_duplicates_by_brute_force(spark, sf):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(220)]
    for k in range(60):  # a hot group of near copies, each edited apart
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    shared = " ".join(base[:60])
    rows += [(20_000 + k, shared + " " + " ".join(f"own{k}x{j}" for j in range(70))) for k in range(40)]  # a shared passage alone
    got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _classes(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in want.items()}


def test_near_duplicates_edges(spark, docs, empty):
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 9: 7, None: None, 8: 8}
    assert probminhash.near_duplicates(empty).count() == 0
    kept = probminhash.one_of_each(docs, probminhash.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 7, 8, None]
    again = docs.union(docs).union(docs.where("doc_id = 1"))  # repeated rows of a representative: one stays
    assert sorted((r.doc_id for r in probminhash.one_of_each(again, probminhash.near_duplicates(again)).collect()), key=str) == [1, 3, 4, 5, 6, 7, 8, None]
    assert probminhash.one_of_each(empty, probminhash.near_duplicates(empty)).count() == 0


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    wa, wb = rng.uniform(1, 3, 250), rng.uniform(1, 3, 250)
    x, y = np.sort(a[:250]), np.sort(a[50:])
    hits = np.mean([probminhash.signature(np.sort(x + np.uint64(k)), wa) == probminhash.signature(np.sort(y + np.uint64(k)), wb) for k in range(40)])
    p, q = dict(zip(x.tolist(), wa)), dict(zip(y.tolist(), wb))
    want = sum(1 / sum(max(p.get(z, 0) / p[e], q.get(z, 0) / q[e]) for z in p.keys() | q.keys()) for e in p.keys() & q.keys())
    assert abs(hits - want) < 0.03


def test_pairs_that_differ_by_a_repeated_passage_are_linked(spark):
    rows = []
    for k in range(25):
        base = " ".join(f"c{k}x{j}" for j in range(104))
        for m in (0, 20):  # 100 common shingles; the passage adds its m - 4 and 4 at its border
            rows.append((2 * k + (m > 0), base + " " + " ".join([f"r{k}x{j}" for j in range(m - 4)] * 50)))
    got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(50)} == {i: c for (i, _), c in _classes(rows).items()}


def test_bits_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    far = 0
    for n in [8, 40, 100] * 60:  # common shingles; a ninth of each text is its own
        x = rng.integers(0, 2**63, n + n // 4, dtype=np.int64).astype(np.uint64)
        own = n // 8
        a, b = np.sort(x[: n + own]), np.sort(np.concatenate([x[:n], x[n + own : n + 2 * own]]))
        bits = [np.unpackbits(probminhash.register_bits(probminhash.signature(z, np.ones(len(z))))) for z in (a, b)]
        far += int((bits[0] != bits[1]).sum() > probminhash.MAX_BITS)
    assert far == 0


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(11)
    met = 0
    for n in [8, 40, 200] * 80:  # common shingles; a ninth of each text is its own: similarity 0.8
        x = rng.integers(0, 2**63, n + n // 4, dtype=np.int64).astype(np.uint64)
        own = n // 8
        kept = [probminhash.signature(z, np.ones(len(z))).reshape(probminhash.BANDS, probminhash.ROWS) for z in (np.sort(x[: n + own]), np.sort(np.concatenate([x[:n], x[n + own : n + 2 * own]])))]
        met += bool((kept[0] == kept[1]).all(1).any())
    assert met == 240


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    rows = [(k, " ".join([f"s{j}" for j in range(60)] + [f"o{k // 2}x{j}" for j in range(40)] + ([f"end{k}"] if k % 2 else []))) for k in range(80)]
    want = _classes(rows)
    for size in (3, 1024):
        monkeypatch.setattr(probminhash, "BLOCK_ROWS", size)
        got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in want.items()} == {i: i - i % 2 for i in range(80)}


def test_components_on_chains(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 150), (100, 150)]
    got = {r.node: r.label for r in probminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 150: 100}


# -- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="ad">Buy %d!</div><div class="x1">Same on all pages</div>
<article class="post"><header><h1>Title &amp;  %d</h1></header><p>First&nbsp;para <b>bold<br>text <!-- c --> here<p title="a > b">Second &#233; %d
<div class="comments"><p>Reader says</p></div><ul><li>item<li>two</ul><form><input value=x><label>Mail</label></form><aside>Side</aside></article>
<section id="comments">More</section><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i), "n") for i in range(8)] + [(20, None, None, ""), (21, "x", "", ""), (22, "http://o.example/", "plain & text <b", ""), (23, "http://h.example/0", PAGE % (0, 0, 0), "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got[3] == "Title & 3\nFirst para bold text here\nSecond é 3\nitem\ntwo"
    assert got[20] == got[21] == "" and got[22] == "plain & text" and got[23] == got[0] and len(got) == 12
    assert html_main.extract(df.limit(0)).count() == 0


def test_style_tree_finds_repeated_branches(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=q7>Menu of the site</div><div class=z9><p>Story {i} is about {i * i}</p></div></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.extract(df).collect()} == {i: f"Story {i} is about {i * i}" for i in range(9)}
    alone = spark.createDataFrame(rows[:2], "page_id long, url string, html string")
    assert {r.text for r in html_main.extract(alone).collect()} == {f"Menu of the site\nStory {i} is about {i * i}" for i in range(2)}


def test_pages_of_the_data(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from html import unescape

    for r in queries.op9_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


STORY = "<h1>Title</h1><p>" + "A long story is told here. " * 8 + "</p><p>And it ends.</p>"
TOLD = "Title\n" + " ".join(["A long story is told here."] * 8) + "\nAnd it ends."


@pytest.mark.parametrize("page", [
    "<article class='post comments-open'>%s</article>", "<main class='no-sidebar'>%s</main>", "<div id='page' class='cookie-banner-shown'><article>%s</article></div>",
    "<div class='cookie-banner-shown'>%s</div>", "<article><section class='discussion'>%s</section></article>", "<form action=x><div>%s</div></form>",
    "<div data-id='ad-5' data-state='hidden'>%s</div>", "<p>Intro.</p><div title='a hidden id=ad' data-hidden>%s</div>", "<div style='display:none'>%s</div>",
    "<div class='header-fixed'>%s</div>", "<article>%s</article><div class='comments'><article>Reader says</article></div>", "<div class='page-header'>Site</div><div class='no-sidebar'>%s</div><div class='sidebar'>Side</div>",
])
def test_words_of_markup_do_not_lose_the_article(spark, page):
    df = spark.createDataFrame([(1, "http://h.example/", f"<html><body>{page % STORY}</body></html>")], "page_id long, url string, html string")
    assert html_main.extract(df).collect()[0].text == ("Intro.\n" if "Intro" in page else "") + TOLD


@pytest.mark.parametrize("part,want", [
    ("<article class='post tag-social'><p>Hello world article</p></article>", "Hello world article"),
    ("<article><p>Before.</p><section class='discussion'>We discuss results.</section></article>", "Before.\nWe discuss results."),
    ("<article><p>Before.</p><div class='alert'>Mind the gap.</div></article>", "Before.\nMind the gap."),
    ("<article><p>Before.</p><p class='related-work'>Others did so.</p></article>", "Before.\nOthers did so."),
    ("<main><p>Before.</p><div class='cookie-recipe'>Butter and sugar.</div></main>", "Before.\nButter and sugar."),
    ("<main><p>Before.</p><div id='search-results'>One found.</div></main>", "Before.\nOne found."),
    ("<div><p>A tale of some length is told here.</p><div class='cookie-recipe'>Butter.</div></div><div class='cookie-banner'>We use some</div><div id='siteFooter'>End</div>", "A tale of some length is told here.\nButter."),
    ("<article><p>Before it all.</p><div class='comment-list'>Reader says</div><div class='ad-slot'>Buy</div></article>", "Before it all."),
])
def test_names_tell_only_as_a_whole(spark, part, want):
    df = spark.createDataFrame([(1, "http://h.example/", f"<html><body>{part}</body></html>", "kept")], "page_id long, url string, html string, text string")
    assert html_main.extract(df).collect()[0].text == want


def test_importance_leans_on_the_prior(spark):
    page = "<body><div class=q7>Menu of the site</div><article><p>Story %d of many words is told</p><p class=s>Sign of the house</p></article></body>"
    for n, dropped in ((4, ()), (5, ("Menu of the site",)), (18, ("Menu of the site",)), (20, ("Menu of the site", "Sign of the house"))):
        rows = [(i, "http://h.example/x", page % i) for i in range(n)]
        tree = {(r.main, round(r.importance, 3)): r.pages for r in html_main.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert tree[False, 0.0] == n
        low = {t for (t, main) in (("Menu of the site", False), ("Sign of the house", True)) if (p := html_main.PRIOR_PAGES_IN_MAIN if main else html_main.PRIOR_PAGES) / (p + n) < html_main.LOW}
        assert low == set(dropped)
        if n in (18, 20):
            got = {r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
            assert got == {f"Story {i} of many words is told" + ("\nSign of the house" if n == 18 else "") for i in range(n)}


@pytest.mark.parametrize("page,want", [
    ("<div id=story>%s</div><article class=card>One</article><article class=card>Two</article>", TOLD + "\nOne\nTwo"),
    ("<div id=story>%s</div><article class=card>One</article>", TOLD + "\nOne"),
    ("<p>Site</p><h1>Head</h1><p>Lead.</p><article>%s</article><p>After</p>".replace("%s", STORY.replace("h1", "h2").replace("%", "%%")) + "%.0s", "Head\nLead.\n" + TOLD),
    ("<main>%s</main><div>Else</div>", TOLD), ("<main><article>Card one</article><article>Card two</article>%s</main><p>x</p>", "Card one\nCard two\n" + TOLD),
])
def test_main_is_taken_alone_only_as_the_larger_part(spark, page, want):
    df = spark.createDataFrame([(1, "http://h.example/", f"<!DOCTYPE html><html><body>{page % STORY}</body></html>")], "page_id long, url string, html string")
    assert html_main.extract(df).collect()[0].text == want


@pytest.mark.parametrize("name", ["newsletter-signup", "sidebar", "site-notice", "cookie_bar", "nav-menu"])
def test_boxes_inside_an_article_go(spark, name):
    said = "A long story is told here. " * 9 + "It ends."
    page = f'<body><article><h1>Title</h1><p>{said}</p><div class="{name}">We use cookies. Sign up!</div><div class="notice-of-the-day recipe">Stays.</div></article></body>'
    got = html_main.extract(spark.createDataFrame([(1, "http://h.example/", page)], "page_id long, url string, html string")).first().text
    assert got == f"Title\n{said}\nStays."


# -- fingerprints


def test_fingerprints(spark, sf, docs, empty):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = {r.doc_id: r for r in sketches.fingerprints(spark.read.parquet(f"{sf}/documents.parquet"), rows_per_range=30).collect()}
    h = WordHashes()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (sketches.sketch(x, h) for x in (t, edited, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (sketches.to_text(a), sketches.to_text(b))
        assert (r.near_edited, r.near_next) == (sketches.resemblance(a, b), sketches.resemblance(a, c))
    assert len(got) == len(rows)
    odd = sketches.fingerprints(docs, rows_per_range=2).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odd)
    assert len({r.fingerprint for r in odd if r.doc_id in (1, 2)}) == 1
    assert sketches.fingerprints(empty).count() == 0


def test_likeness_is_near_the_exact_one(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf).collect()}
    sets = lambda t: {tuple(w[j : j + 5]) for w in [re.findall(r"\w+", t.lower())] for j in range(len(w) - 4)}
    off = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        a, b = sets(t), sets(t[: len(t) - half] + nxt[:half])
        if len(a) > 100 and len(b) > 100:
            off.append(got[i].near_edited - len(a & b) / len(a | b))
    assert len(off) > 50 and abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.3
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_sketches_merge_and_estimate(spark):
    h, rng = WordHashes(), random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    small, large = " ".join(words[2_000:6_000]), " ".join(words)
    a, b = sketches.sketch(small, h), sketches.sketch(large, h)
    assert abs(sketches.containment(a, b) - 1) < 0.01 and sketches.containment(b, a) < 0.2
    left, right = " ".join(words[:15_000]), " ".join(words[14_996:])
    both = sketches.merge(sketches.sketch(left, h), sketches.sketch(right, h))
    assert (both[sketches.HEAD :] == b[sketches.HEAD :]).all() and both[0] == b[0] and abs(int(both[1]) / int(b[1]) - 1) < 0.03
    assert sketches.containment(a, both) == sketches.containment(a, b) and sketches.resemblance(both, b) == 1
    assert (sketches.from_text(sketches.to_text(a)) == a).all()
    part = " ".join(words[:1_500] + words[20_000:21_500])
    x, y = set(shingles(part, h).tolist()), set(shingles(" ".join(words[:3_000]), h).tolist())
    assert abs(sketches.resemblance(sketches.sketch(part, h), sketches.sketch(" ".join(words[:3_000]), h)) - len(x & y) / len(x | y)) < 0.06


def test_one_threshold_for_all_texts(spark, sf):
    """However short or long, a text retains just the hashes below the fraction; few retained hashes make no false likeness."""
    h, limit = WordHashes(), 0xFFFFFFFF // sketches.FRACTION
    texts = ["", "one", "two", "One", "a b c", " ".join(f"w{i}" for i in range(19)), " ".join(f"w{i}" for i in range(300)), LONG]
    made = [sketches.sketch(t, h) for t in texts]
    assert all(m[0] == limit and (m[sketches.HEAD :] < limit).all() for m in made)
    assert {r.fingerprint[:8] for r in queries.op10_fingerprints(spark, sf).collect()} == {f"{limit:08x}"}
    for i, a in enumerate(made):
        for j, b in enumerate(made):
            alike = i == j or {texts[i], texts[j]} == {"one", "One"}
            assert (sketches.resemblance(a, b) == 1) == alike and (sketches.containment(a, b) == 1 or not alike)
    sizes = [len(m) - sketches.HEAD for m in (sketches.sketch(" ".join(f"x{k}y{i}" for i in range(104)), h) for k in range(300))]
    assert abs(np.mean(sizes) / (100 / sketches.FRACTION) - 1) < 0.05


# -- pipeline


def test_stages_on_odd_tables(spark, sf):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"word{k}x{j}" for j in range(80))
    rows = [(1, words(1), "en", "s", 9), (1, words(1), "en", "s", 9), (2, words(1), "en", None, 9), (3, None, None, "s", None), (None, words(2), None, None, 1), (None, None, None, None, None), (4, "", "en", "s", 0), (5, words(3) + " " + "long " * 20_000, "en", "s", 1), (6, words(4), "de", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = bool(docs.count())
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            assert made.columns == (docs.columns if stage is not corpus_pipeline.encode else ["doc_id", "source", "ids", "n_tokens"])
            got = sorted((r.doc_id or 0 for r in made.collect()))
            assert got == [] or some
            if some and stage is corpus_pipeline.dedup:
                assert got == [0, 0, 1, 3, 4, 5, 6]
            if some and stage is corpus_pipeline.rules:
                assert set(got) <= {0, 1, 2, 6} and len(got) == 5
            if some and stage is corpus_pipeline.encode:
                assert len(got) == len(rows)


def test_pipeline(spark, sf, library):
    import corpus_pipeline

    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, sf).cache()
    ruled = corpus_pipeline.rules(spark, kept, sf).cache()
    single = corpus_pipeline.dedup(spark, ruled, sf).cache()
    assert kept.columns == ruled.columns == single.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in single.collect()}
    good = [i for i in labels if labels[i] == 1]
    labelled = [labels[r.doc_id] for r in kept.collect() if r.doc_id in labels]
    assert sum(labelled) > 0.95 * len(good) and np.mean(labelled) > 0.97
    want = _classes([(r.doc_id, r.text) for r in ruled.collect()])
    assert left == {i for (i, _), c in want.items() if c == i}
    mixed = corpus_pipeline.mix(spark, single, sf)
    assert {r.doc_id for r in mixed.collect()} <= left and mixed.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in mixed.collect())
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows[:100])
