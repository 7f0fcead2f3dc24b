"""Document fingerprints: threshold-scaled sketches.

A sketch retains every shingle hash below one fixed fraction of the hash range, the same for all
texts. Sketches merge by union and estimate the containment of a short text in a long one without
bias, since both are complete below the threshold. A likeness errs by about sqrt(p (1 - p) / m) for m
hashes retained of both texts; a text of n distinct shingles retains n / FRACTION of them, so short
texts' likenesses are rough. The fingerprint is the threshold, the number of distinct shingles, a
digest of them all, and the retained hashes, ascending, 8 hexadecimal digits each. By the digest
equal texts are known as such however few hashes they retain; different texts of which neither
retains any have likeness 0.

Shingles are five words long; texts of fewer than SHORT words also give their five-character
shingles, marked by the last bit, which count only against texts that have such too.

Nulls: a null text is the empty text; its fingerprint retains nothing, and it is
like only other texts without shingles (likeness 1). Equal texts have equal fingerprints.
Equal ids are ordered by their text; the next document of the last is the first. Repeated rows
are each other's next; all rows of one id (or of none) lie in one range. Very long texts are
read whole. Empty tables give empty results; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shingles import WordHashes, mix, shingles

FRACTION = 4  # a quarter of all hashes is retained
SHORT = 20
MAX_RANGES = 65_536
_TOP = 0xFFFFFFFF
#: Numbers before the retained hashes: threshold, distinct shingles, digest.
HEAD = 3


def sketch(text: str | None, hashes: WordHashes) -> np.ndarray:
    """[threshold, distinct shingles, digest, retained hashes ascending], 32 bits each."""
    own = (shingles(text, hashes) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
    if text and len(own) + 4 < SHORT:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        k = min(5, len(points))
        code = np.zeros(len(points) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                code = mix(code + points[i : len(points) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
        own = np.concatenate([own, (code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)])
    own = np.unique(own)
    limit = _TOP // FRACTION
    with np.errstate(over="ignore"):
        digest = mix(own.astype(np.uint64)).sum(dtype=np.uint64) >> np.uint64(32)
    return np.concatenate([np.array([limit, len(own), digest], np.uint32), own[: np.searchsorted(own, limit)]])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the two texts' union, whose number of shingles is estimated and whose digest is of what it retains."""
    limit, both = min(a[0], b[0]), np.union1d(a[HEAD:], b[HEAD:])
    both = both[both < limit]
    with np.errstate(over="ignore"):
        digest = mix(both.astype(np.uint64)).sum(dtype=np.uint64) >> np.uint64(32)
    return np.concatenate([np.array([limit, min(len(both) * _TOP // int(limit), _TOP), digest], np.uint32), both])


def _common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Retained hashes that both hold, that a holds, that b holds."""
    limit = min(a[0], b[0])
    x, y = (v[HEAD : HEAD + np.searchsorted(v[HEAD:], limit)] for v in (a, b))
    if not ((x & 1).any() and (y & 1).any()) and (x & 1 == 0).any() and (y & 1 == 0).any():
        x, y = x[x & 1 == 0], y[y & 1 == 0]
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the texts have the same shingles."""
    return bool((a[1:HEAD] == b[1:HEAD]).all())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's shingles that b has."""
    both, n, _ = _common(a, b)
    return 1.0 if same(a, b) else both / n if n else 0.0


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of the shingle sets."""
    both, n, m = _common(a, b)
    return 1.0 if same(a, b) else both / (n + m - both) if n + m else 0.0


def to_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int) -> DataFrame:
    """Rows dealt by ranges of ascending ids and sorted there, each range followed by the first row of the
    next one (guard true), and the last by the first row of all. One shuffle of the texts.

    Ranges begin at ids that a hash chooses, one of about rows_per_range, and at the least id. There are
    about MAX_RANGES of them at most, so what every task knows of them is bounded; several share a task."""
    none = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", none))
    every = max(rows_per_range, rows.count() // MAX_RANGES, 1)
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).select("k").union(rows.agg(F.min("k").alias("k")).where("k is not null"))
    cuts = np.array(sorted(r.k for r in chosen.distinct().collect()), np.int64)

    @arrow_udf("array<struct<range:int,guard:boolean>>")
    def places(keys: pa.Array) -> pa.Array:
        k = keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, k, "right") - 1
        begins = cuts[at] == k  # such rows also close the range before
        ends = np.cumsum(1 + begins)
        own = ends - 1 - begins
        ranges, guards = np.zeros(ends[-1] if len(ends) else 0, np.int32), np.zeros(ends[-1] if len(ends) else 0, bool)
        ranges[own] = at
        ranges[own[begins] + 1], guards[own[begins] + 1] = (at[begins] - 1) % len(cuts), True
        entries = pa.StructArray.from_arrays([pa.array(ranges, pa.int32()), pa.array(guards)], ["range", "guard"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), entries)

    dealt = rows.withColumn("x", F.explode(places("k"))).select(F.col("x.range").alias("_hn_range"), F.col("x.guard").alias("guard"), "doc_id", "text")
    return dealt.repartition("_hn_range").sortWithinPartitions("_hn_range", "guard", F.asc_nulls_first("doc_id"), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 512) -> DataFrame:
    """Per document: its fingerprint, that of its text with the second half replaced by the next
    document's beginning, and the likeness of its fingerprint to that and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), None

        def made(held, text, own) -> tuple:
            doc_id, was, fp = held
            half = len(was) // 2
            edited = was[: len(was) - half] + text[:half]
            other = sketch(edited, hashes)
            return doc_id, len(was), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(fp), to_text(other), resemblance(fp, other), resemblance(fp, own), containment(fp, other)

        closed = None  # the range whose guard has been met
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for at, guard, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if guard and at == closed:
                        continue  # rows with the same id as the guard
                    own = sketch(text, hashes)
                    if held is not None:
                        out.append(made(held, text, own))
                    held, closed = (None, at) if guard else ((doc_id, text, own), None)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if held is not None:
            raise RuntimeError("a range of documents came without the first of the next")

    names = [x.split()[0] for x in OUT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
    return with_next(docs, id_col, text_col, rows_per_range).mapInArrow(run, OUT)
