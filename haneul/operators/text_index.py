"""An inverted index of a corpus (doc_id, domain, title, body, date): trigrams with their positions.

Texts are indexed in lower case without white space, so a question's term is found wherever its
letters stand in a row, whatever white space is between them. The index is two tables below one folder:

* `docs`: a row per document, in blocks of at most DOCS documents and about CHARS characters;
* `postings`: a row per trigram and block: the sorted places where it stands, each the
  document's number in the block, the field and the position in one long, packed as differences
  of a few bytes. Each task that reads documents writes a file of its own, sorted by trigram, so no
  posting is shuffled and a file is as large as its documents are, however common a trigram; a
  question's filter on its few trigrams reaches each file's statistics, and only their pages are read.
  A trigram that every document holds is cut by blocks and is no hot key.

A term's places are those of its first trigram at which each further one stands as many places on:
one intersection of sorted arrays a block, the rarest first, without reading a text. They are all
its places (overlapping ones too), so document frequencies, and with them bm25, are exact; since
a phrase's document frequency is known only when all its blocks are, no block can be skipped
by a bound on its score, and the best k are taken by a window that Spark limits before its shuffle.

Terms of fewer than three characters aren't trigrams and aren't found. Null titles and bodies are
empty. A folder's index belongs to the corpus it was built from; an empty corpus has an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import squash

DOCS, CHARS = 4096, 1_000_000
#: Bits of a place: the document's number in its block, one for the field (0 title, 1 body), the position.
AT, FIELD = 31, 32
#: bm25 with weights of title and body, and the least inverse document frequency.
K1, B, TITLE, BODY, LEAST = 1.2, 0.75, 10.0, 1.0, 1e-6
_BITS = 21
#: Bytes of a page of postings, the least that a question reads of a file.
PAGE = 1 << 16


def _indexed(c: str) -> Column:
    return squash(F.lower(F.coalesce(F.col(c), F.lit(""))))


def trigrams(text: str) -> list[int]:
    """The trigrams of a text in order, three code points in a long each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]).tolist() if len(points) > 2 else []


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their block (of this task) and number in it."""
    block, n, chars = 0, 0, 0
    for batch in batches:
        at = []
        for size in batch.column("tokens").to_pylist():
            if n and (n == DOCS or chars + size > CHARS):
                block, n, chars = block + 1, 0, 0
            at.append((block, n))
            n, chars = n + 1, chars + size
        yield batch.append_column("_block", pa.array([b for b, _ in at], pa.int64())).append_column("local", pa.array([k for _, k in at], pa.int64()))


def _packed(place: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of lists, each begun where `fresh` says so, as bytes, and the end of each list's.

    A list is its number of position bits, then a number for each place: in the field of the place before, twice
    the difference of positions; else twice (the difference of fields, then the position in its bits), plus 1.
    Numbers are written seven bits a byte, lowest first; all but a number's last byte have the eighth bit."""
    field, at = place >> FIELD, place & (1 << FIELD) - 1
    bits = int(at.max()).bit_length()
    before = np.where(fresh, 0, np.append(0, field[:-1]))
    moved = fresh | (field != before)
    value = np.where(moved, ((field - before) << bits | at) << 1 | 1, (at - np.append(0, at[:-1])) << 1)
    value = np.insert(value, np.flatnonzero(fresh), bits)
    size = np.ones(len(value), np.int64)
    for k in range(7, int(value.max()).bit_length(), 7):
        size += value >> k > 0
    ends = np.cumsum(size)
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(size.max())):
        own = size > k
        out[(ends - size)[own] + k] = (value[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    lasts = np.append(np.flatnonzero(fresh)[1:], len(place)) + np.arange(fresh.sum())
    return out, ends[lasts]


def _unpacked(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of lists of so many bytes each, and their number in each list."""
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    value = np.add.reduceat((data & 127).astype(np.int64) << shift, first)
    heads = np.searchsorted(first, np.cumsum(sizes) - sizes)
    counts = np.diff(np.append(heads, len(value))) - 1
    bits, value = np.repeat(value[heads], counts), np.delete(value, heads)
    moved, rest = value & 1 == 1, value >> 1
    field, at = np.cumsum(np.where(moved, rest >> bits, 0)), np.cumsum(np.where(moved, rest & (1 << bits) - 1, rest))
    starts = np.cumsum(counts) - counts
    field -= np.repeat(np.append(0, field)[starts], counts)
    runs = np.flatnonzero(moved)
    at -= np.repeat(np.append(0, at)[runs], np.diff(np.append(runs, len(at))))
    return field << FIELD | at, counts


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of postings with their places as arrays of longs."""
    for batch in batches:
        lists = batch.column("places")
        if not len(lists):
            continue
        sizes = np.array([len(x) for x in lists.to_pylist()], np.int64)
        places, counts = _unpacked(np.frombuffer(b"".join(lists.to_pylist()), np.uint8), sizes)
        arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(places))
        yield pa.RecordBatch.from_arrays([batch.column("trigram"), batch.column("block"), arrays], names=["trigram", "block", "places"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of docs, in order, as rows of postings; a block that two tasks or batches share is two rows."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for rows in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
            grams, places = [], []
            for field in (0, 1):
                texts = batch.column(("low_title", "low_body")[field]).take(pa.array(rows)).to_pylist()
                locals_ = batch.column("local").to_numpy()[rows]
                for local, text in zip(locals_.tolist(), texts):
                    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                    if len(points) > 2:
                        grams.append(points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])
                        places.append((local << FIELD + 1 | field << FIELD) + np.arange(len(points) - 2))
            if not grams:
                continue
            gram, place = np.concatenate(grams), np.concatenate(places)
            order = np.lexsort((place, gram))
            gram, place = gram[order], place[order]
            fresh = np.append(True, np.diff(gram) != 0)
            data, ends = _packed(place, fresh)
            made = gram[fresh]
            lists = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.full(len(made), blocks[rows[0]])), lists], names=["trigram", "block", "places"])


class TextIndex:
    """The index in a folder. `build` writes it; questions read it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, corpus: DataFrame) -> TextIndex:
        rows = corpus.select("doc_id", "domain", "title", "date", _indexed("title").alias("low_title"), _indexed("body").alias("low_body"))
        rows = rows.withColumn("tokens", F.greatest(F.length("low_title") - 2, F.lit(0)) + F.greatest(F.length("low_body") - 2, F.lit(0)))
        placed = rows.mapInArrow(_placed, StructType([*rows.schema.fields, StructField("_block", LongType()), StructField("local", LongType())]))
        placed.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("_block")).drop("_block").write.parquet(f"{self.root}/docs")
        posted = self.docs().select("block", "local", "low_title", "low_body").mapInArrow(_posted, "trigram long, block long, places binary")
        posted.sortWithinPartitions("trigram", "block").write.options(**{"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.page.size": PAGE}).parquet(f"{self.root}/postings")
        return self

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/docs")

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of postings that the terms' trigrams name, by a filter that is pushed down."""
        return self.spark.read.parquet(f"{self.root}/postings").where(F.col("trigram").isin(sorted({g for t in terms for g in trigrams(t)})))

    def places(self, terms: list[str]) -> DataFrame:
        """term, block, local, in_title, in_body: how often each document holds each term; terms are taken in lower case without white space."""
        asked = list(dict.fromkeys("".join(t.split()).lower() for t in terms))
        wanted = [(t, i, g) for t in asked for i, g in enumerate(trigrams(t))]
        if not wanted:
            return self.spark.createDataFrame([], "term string, block long, local long, in_title long, in_body long")
        of = self.spark.createDataFrame(wanted, "term string, i int, trigram long")  # a question's trigrams: as many as its letters
        moved = self.postings(asked).mapInArrow(_listed, "trigram long, block long, places array<long>").join(F.broadcast(of), "trigram").select("term", "i", "block", F.transform("places", lambda p: p - F.col("i")).alias("places"))
        lists = moved.groupBy("term", "block", "i").agg(F.flatten(F.collect_list("places")).alias("places"))
        lists = lists.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct(F.size("places").alias("n"), "places"))).alias("lists"))
        whole = reduce(lambda c, t: c.when(F.col("term") == t, len(trigrams(t))), asked, F.when(F.lit(False), 0))
        hits = lists.where(F.size("lists") == whole)
        hits = hits.select("term", "block", F.explode(F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0))["places"], lambda a, x: F.array_intersect(a, x["places"]))).alias("place"))
        field = F.shiftright("place", FIELD).bitwiseAND(1)
        return hits.groupBy("term", "block", F.shiftright("place", FIELD + 1).alias("local")).agg(F.count_if(field == 0).alias("in_title"), F.count_if(field == 1).alias("in_body"))

    def share_read(self, terms: list[str]) -> float:
        """The part of the bytes of all stored places that a question about the terms reads."""
        n = lambda df: df.agg(F.sum(F.length("places"))).first()[0] or 0
        return n(self.postings(["".join(t.split()).lower() for t in terms])) / max(1, n(self.spark.read.parquet(f"{self.root}/postings")))

    def matches(self, terms: list[str]) -> DataFrame:
        """term, doc_id, domain, in_title, in_body of every document that holds a term."""
        return self.places(terms).join(self.docs().select("block", "local", "doc_id", "domain"), ["block", "local"]).select("term", "doc_id", "domain", "in_title", "in_body")

    def best(self, terms: list[str], k: int = 5) -> DataFrame:
        """The k best documents of each domain that hold any of the terms, by bm25 over the whole corpus, then id."""
        docs = self.docs()
        size = docs.agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
        found = self.places(terms)
        rare = found.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST))
        scored = found.join(F.broadcast(rare.select("term", idf.alias("idf"))), "term").join(docs.select("block", "local", "doc_id", "domain", "date", "tokens"), ["block", "local"])  # a row per term
        f = TITLE * F.col("in_title") + BODY * F.col("in_body")
        part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("tokens") / F.lit(size["mean"] or 1.0)))
        scored = scored.groupBy("domain", "doc_id", "date").agg(F.round(F.sum(part), 6).alias("score"))
        order = W.partitionBy("domain").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("domain", "place", "score", "doc_id", "date")
