"""The trigram index and the dictionary automaton against plain scans."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from haneul.functions import text
from haneul.operators import text_index

WORDS = ["aaa", "aaaa", "Banana", "청년 고용률", "고용률", "ß", "x", "청년고용률이 올랐다", "aa a", "", "É ana", "the", "\U0001f600\U0001f601\U0001f602"]
ASKED = ["aaa", "anan", "청년고용", "고용률", "É an", "the the", "\U0001f600\U0001f601\U0001f602", "nowhere", "xx"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(f"d{i}", rng.choice("pq"), rng.choice([None, " ".join(rng.choices(WORDS, k=2))]), " ".join(rng.choices(WORDS, k=rng.randrange(8))), "2024-01-01") for i in range(400)]
    return [*made, ("long", "p", "t", "banana " * 30_000, None), ("none", "q", None, None, None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    corpus = spark.createDataFrame(rows, "doc_id string, domain string, title string, body string, date string").repartition(5)
    return text_index.TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).build(corpus)


def bare(s):
    return "".join((s or "").split()).lower()


def places(term, s):
    return sum(s.startswith(term, i) for i in range(len(s)))


def held(rows):
    return {(bare(t), d): (places(bare(t), bare(title)), places(bare(t), bare(body))) for t in ASKED if len(bare(t)) > 2 for d, _, title, body, _ in rows if bare(t) in bare(title) or bare(t) in bare(body)}


def test_index_finds_what_a_scan_finds(index, rows):
    got = {(r.term, r.doc_id): (r.in_title, r.in_body) for r in index.matches(ASKED).collect()}
    assert got == held(rows) and len(got) > 300
    assert index.matches(["ab", ""]).count() == 0 and index.best([]).count() == 0


def test_index_ranks_by_bm25_of_all_rows(index, rows):
    found, size = held(rows), {d: max(len(bare(t)) - 2, 0) + max(len(bare(b)) - 2, 0) for d, _, t, b, _ in rows}
    mean, n = sum(size.values()) / len(rows), len(rows)
    score = dict.fromkeys(size, 0.0)
    for term in {t for t, _ in found}:
        own = {d: v for (t, d), v in found.items() if t == term}
        idf = max(math.log((n - len(own) + 0.5) / (len(own) + 0.5)), 1e-6)
        for d, (a, b) in own.items():
            f = 10 * a + b
            score[d] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[d] / mean))
    domain = {r[0]: r[1] for r in rows}
    want = []
    for p in "pq":
        ranked = sorted(((-round(s, 6), d) for d, s in score.items() if domain[d] == p and d in {x for _, x in found}))[:7]
        want += [(p, k, pytest.approx(-s, abs=2e-6), d) for k, (s, d) in enumerate(ranked, 1)]
    assert [tuple(r)[:4] for r in index.best(ASKED, 7).orderBy("domain", "place").collect()] == want


def test_a_question_reads_its_own_lists_alone(index):
    assert index.share_read(["고용률"]) < 0.05 < 0.5 < index.share_read(["banana"])
    plan = index.postings(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in plan or "PushedFilters: [IsNotNull(trigram), EqualTo(trigram" in plan


def test_places_are_packed_and_found_again():
    rng = np.random.default_rng(3)
    for n, docs, longest in ((1, 1, 1), (5, 1, 1 << 31), (5000, 4096, 20_000), (5000, 3, 1 << 20)):
        lists = np.sort(rng.integers(0, min(n, 40), n))
        place = rng.integers(0, docs, n) << text_index.FIELD + 1 | rng.integers(0, 2, n) << text_index.FIELD | rng.integers(0, longest, n)
        order = np.lexsort((place, lists))
        lists, place = lists[order], place[order]
        fresh = np.append(True, np.diff(lists) != 0)
        data, ends = text_index._packed(place, fresh)
        again, counts = text_index._unpacked(data, np.diff(ends, prepend=0))
        assert again.tolist() == place.tolist() and counts.tolist() == np.unique(lists, return_counts=True)[1].tolist()


def test_postings_are_small_and_not_shuffled(index):
    rows = index.spark.read.parquet(f"{index.root}/postings")
    letters = index.docs().agg(F.sum("tokens")).first()[0]
    assert rows.agg(F.sum(F.length("places").cast("long"))).first()[0] < 4 * letters
    for path in rows.inputFiles():  # each task's own file, sorted
        grams = [r.trigram for r in index.spark.read.parquet(path).coalesce(1).collect()]
        assert grams == sorted(grams)
    docs = index.docs().select("block").distinct().count()
    assert rows.select("block").distinct().count() <= docs


def test_index_of_an_empty_corpus(spark, tmp_path):
    none = text_index.TextIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame([], "doc_id string, domain string, title string, body string, date string"))
    assert none.matches(["the"]).count() == 0 and none.best(["the"]).count() == 0


def slow_matches(s, keys):
    """Keys longest first, each at its first place that is free."""
    form = lambda x: unicodedata.normalize("NFKC", x).replace(" ", "").replace("·", "")
    s, found, taken = form(s), [], set()
    for k in sorted(keys, key=lambda k: (-len(form(k)), form(k), k)):
        f = form(k)
        at = next((i for i in range(len(s)) if f and s.startswith(f, i) and not taken & set(range(i, i + len(f)))), None)
        if at is not None:
            taken |= set(range(at, at + len(f)))
            found.append((at, k))
    return [k for _, k in sorted(found)]


def test_automaton_equals_the_slow_matcher(spark):
    rng = random.Random(9)
    letters = "abㄱ가·Ａ "
    keys = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(80)} | {"a b", "ab", "a·b"})
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(500)]
    match = text.dictionary_matcher(dict.fromkeys(keys, "x"))
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: [m.key for m in r.m] for r in df.select("i", match("t").alias("m")).collect()}
    assert got == {-1: []} | {i: slow_matches(t, keys) for i, t in enumerate(texts)}
    assert text.dictionary_matcher({}) and spark.range(1).select(text.dictionary_matcher({"": "x"})(__import__("pyspark").sql.functions.lit("a")).alias("m")).first().m == []


def test_topics_in_one_pass_equal_topics(spark):
    from pyspark.sql import functions as F

    dictionary = {"a": ["고용", "취 업"], "b": ["정년", "고용률"], "none": ["zz"], "c": ["x y", "y"]}
    rng = random.Random(4)
    texts = [None, "", *(" ".join(rng.choices(["고용", "고용률", "취", "업", "정 년", "x", "y", "z"], k=rng.randrange(6))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    made = df.select("i", text.topic_matcher(dictionary)("t").alias("m"), text.topics(F.coalesce("t", F.lit("")), dictionary).alias("n")).collect()
    assert all(r.m == r.n for r in made) and any(len(r.m) > 2 for r in made)
