"""Near-duplicate documents by ProbMinHash.

A text is a set of five-word shingles, all of weight 1. Each shingle sends points of a Poisson
process whose rate is its weight; every point falls into one of REGISTERS registers, which
keeps the earliest point and its shingle. Points later than the latest register end a
shingle's process early. Two texts agree in a register with their probability Jaccard
similarity, which for equal weights is the Jaccard similarity of the sets, as links need it:
a passage repeated many times counts once in both. Registers are banded; texts that share a band are candidates, and a
candidate pair becomes a link if the exact Jaccard similarity of its shingle sets is at least
the threshold. Classes are the connected components of the links.

How it scales:
* equal texts meet by hash in a combined count; only one row per text goes on;
* in each bucket every text is held against the bucket's hub (the text with the most bucket
  company), a pair per row, so a group of thousands of near copies costs thousands of pairs;
* buckets that then still hold texts of several classes are resolved across classes. A pair
  leaves the join only if two sketches allow the threshold: one bit a register (a pair at the
  threshold or above passes but for about 1 in 10^6) and a map of occupied cells, whose bound
  on the common shingles is exact; so near copies that are just too far apart make no rows.
  A large bucket is compared in blocks of BLOCK_ROWS texts, each dealt to a task of its own;
* shingle sets are rebuilt from the texts of candidates only;
* joins to texts and to shingle sets are merge joins at every size, and every iteration is
  written to the shared folder.

A pair at similarity 0.8 shares no band with a probability of about 5e-6 (REGISTERS in bands
of ROWS). Shingles are compared as 32-bit hashes.

Nulls: a null text is a class of its own, and so is a text without words unless an equal text
exists. The class id is the smallest document id of the class. Repeated rows are one document;
texts that share an id have one class if either's is. Very long texts are read whole. Empty
tables give empty results; columns besides id and text are ignored here and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, materialize, sliced
from .shingles import WordHashes, mix, shingles

ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
#: Arrivals made at a time.
BLOCK = 2048
#: Texts of an open bucket that one task holds against all of the bucket's.
BLOCK_ROWS = 1024
#: Bits that may differ between the one-bit sketches of a pair at similarity 0.8: a tenth is expected.
MAX_BITS = 52


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that each register keeps. Arrival j of an element is drawn from its hash and
    j; arrivals are made in blocks of about BLOCK, until each element's next one comes later
    than every register's earliest."""
    first = np.full(registers, np.inf)
    kept = np.zeros(registers, np.uint64)
    at, own, rate, j = np.zeros(len(elements)), elements, weights, 0
    with np.errstate(over="ignore"):
        while len(own):
            n = max(1, BLOCK // len(own))
            step = np.arange(2 * j + 1, 2 * (j + n), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            drawn = mix(own[:, None] + step)
            slot = (mix(drawn + np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64).ravel()
            times = at[:, None] - np.cumsum(np.log1p(-((drawn >> np.uint64(11)) * 2.0**-53)), 1) / rate[:, None]
            at, flat, who = times[:, -1], times.ravel(), np.repeat(own, n)
            order = np.argsort(-flat, kind="stable")  # the earliest of a register is written last
            here, holder = np.full(registers, np.inf), np.zeros(registers, np.uint64)
            here[slot[order]], holder[slot[order]] = flat[order], who[order]
            better = here < first
            first[better], kept[better] = here[better], holder[better]
            going = at < first.max()
            own, rate, at, j = own[going], rate[going], at[going], j + n
    return kept


def register_bits(kept: np.ndarray) -> np.ndarray:
    """A bit a register, drawn from its shingle and its number, so that a shingle kept by many registers has
    no single bit in all of them: two registers with different shingles differ in half of all cases."""
    with np.errstate(over="ignore"):
        drawn = mix(kept + np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.packbits(np.pad((drawn >> np.uint64(17)).astype(np.uint8) & 1, (0, 256 - REGISTERS)))


#: Cells of an occupancy map, and its words of 64 bits (two bits a cell).
CELLS = 256
WORDS = 2 * CELLS // 64
_SIGNED = pa.struct([("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("cells", pa.list_(pa.int64())), ("over", pa.int32())])


def occupancy(elements: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles dealt over CELLS cells: bitmaps of the cells with one and with two or more, and how many lie
    beyond two in a cell. The set bits that two maps share, and the lesser excess, bound the common shingles
    from above, so a pair below a bound is below it for certain."""
    counts = np.bincount((elements % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    return np.packbits(np.concatenate([counts > 0, counts > 1])).view(np.int64), int(np.maximum(counts - 2, 0).sum())


@arrow_column("struct<n:int,bands:array<bigint>,bits:array<bigint>,cells:array<bigint>,over:int>")
def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of distinct shingles, a hash per band, a bit per register, and the occupancy map of each whole text."""
    hashes = WordHashes()
    odd = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF for i in range(ROWS)], np.uint64)
    which = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    for texts in batches:
        rows = []
        for part in sliced(texts):
            for text in part:
                elements = np.unique(shingles(text, hashes))
                if not len(elements):
                    rows.append((0, [], [], [], 0))
                    continue
                kept = signature(elements, np.ones(len(elements)))
                with np.errstate(over="ignore"):
                    bands = mix((mix(kept.reshape(BANDS, ROWS)) * odd).sum(1, dtype=np.uint64) + which)
                rows.append((len(elements), bands.view(np.int64), register_bits(kept).view(np.int64), *occupancy(elements)))
        yield pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SIGNED)] if rows else [pa.array([], t.type) for t in _SIGNED], fields=list(_SIGNED))


@arrow_column("binary")
def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sorted distinct shingles of a whole text, 32 bits each."""
    hashes = WordHashes()
    for texts in batches:
        yield pa.array([np.unique((shingles(t, hashes) >> np.uint64(32)).astype(np.uint32)).tobytes() for part in sliced(texts) for t in part], pa.binary())


@arrow_column("double")
def jaccard(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The exact Jaccard similarity of two such sets."""
    for left, right in batches:
        found = []
        for a, b in zip(left, right):
            x, y = (np.frombuffer(v.as_py() or b"", np.uint32) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
        yield pa.array(found, pa.float64())


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(jaccard("of_a", "of_b") >= threshold).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links: label is the smallest node it is connected with.
    Each round takes the smallest label among neighbours (combined before the shuffle), then
    jumps to that label's own label, until no label falls; rounds are written to the shared folder."""
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, text_md5, class_id, for every distinct id and text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.md5(F.col("text").cast("binary"))
    own = materialize(texts.select("doc_id", F.unhex(key).alias("key"), signed("text").alias("s")), "signed")
    members = own.select("doc_id", "key").distinct()
    # a row per distinct text: its smallest id stands for it
    reps = materialize(own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("s").alias("s")).where("rep is not null"), "reps")
    bands = reps.where("s.n > 0").select("rep", F.explode("s.bands").alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(bands.join(full, "band").select("band", "rep", "n"), "bands")
    company = shared.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "rep").groupBy("band").agg(F.max(F.struct("company", (-F.col("rep")).alias("rep"))).alias("hub"))
    stars = shared.join(hubs.select("band", (-F.col("hub.rep")).alias("hub")), "band").where("rep <> hub")
    stars = materialize(stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "stars")
    # shingle sets of candidates alone, from their texts
    wanted = company.select(F.col("rep").alias("doc_id"))
    sets = texts.where("text is not null").join(wanted.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.unhex(key).alias("key"), "text")
    sets = materialize(sets.select("rep", "key", shingle_set("text").alias("shingles")), "sets")
    # an id may stand for several texts; each pair is held against the text that it stands for
    sets = sets.join(reps.select("key", "rep"), ["key", "rep"], "left_semi").dropDuplicates(["rep", "key"])
    links = materialize(verify(stars, sets, threshold), "links")
    classes = components(links)
    # buckets whose texts aren't yet in one class: pairs across classes, sketches first
    placed = shared.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    rest = placed.join(open_, "band", "left_semi").join(reps.select("rep", "s.n", "s.bits", "s.cells", "s.over").withColumnRenamed("n", "size"), "rep").select("band", "rep", "label", "size", "bits", "cells", "over", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    rest = materialize(rest, "open")
    # each text of a block meets its bucket's texts: a large bucket's blocks are compared in tasks of their own
    a = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("x")
    b = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")
    bit = lambda i: F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i]))
    near = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size")) & (bit(0) + bit(1) + bit(2) + bit(3) <= MAX_BITS)
    shared_cells = F.least("x.over", "y.over")
    for i in range(WORDS):
        shared_cells = shared_cells + F.bit_count(F.col("x.cells")[i].bitwiseAND(F.col("y.cells")[i]))
    near = near & (shared_cells >= threshold / (1 + threshold) * (F.col("x.size") + F.col("y.size")) - 1e-6)
    across = a.join(b, (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    across = across.join(stars, ["a", "b"], "left_anti")
    more = materialize(verify(across, sets, threshold), "links")
    if more.limit(1).count():
        links = links.union(more)
        classes = components(links)
    known = reps.select("key", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("label", "rep").alias("class_id"))
    return members.join(known, "key", "left").select("doc_id", F.col("key").alias("text_md5"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class: that of its smallest id (one of each text, if its id has several texts
    or none). found: what near_duplicates() says of docs. Texts are shuffled once, by id and text."""
    none_id, none_key = F.lit(-(1 << 63)), F.unhex(F.lit(""))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", none_id).alias("_hn_id"), F.coalesce("text_md5", none_key).alias("_hn_key"))
    rows = docs.withColumns({"_hn_id": F.coalesce(F.col(id_col).cast("long"), none_id), "_hn_key": F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), none_key)})
    return rows.join(kept.hint("merge"), ["_hn_id", "_hn_key"], "left_semi").dropDuplicates(["_hn_id", "_hn_key"]).select(*docs.columns)
