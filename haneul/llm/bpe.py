"""BPE encoding and decoding with a pair occurrence index.

A task takes the distinct white-space-free chunks of its rows (those of INDEXED characters of
text at a time), brings them into the tokenizer's normal form, cuts them into pieces, and lays
the pieces' symbols end to end. The index maps the rank of each pair to all its positions.
Active ranks are applied in ascending order, each at all its positions at once, and the lists
of the pairs that begin beside a merge are updated. Chunks already encoded by the task are
kept, so a word is merged once, however often it occurs. White space never becomes part of a
token of this tokenizer, so encoding chunk by chunk equals encoding the whole text; tests hold
it against the tokenizers library.

Nulls: a null text is encoded as the empty text (no ids); null ids decode to the empty text.
Whole texts are encoded, whatever their length. Repeated rows are encoded alike, empty tables
give empty results. Other columns pass through; one named as the result is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .chunks import ChunkIds, gather
from .common import SLICE, released

#: Characters of text whose new chunks share an index; their chunks and ids are in memory at one time.
INDEXED = 1 << 20
#: Chunks that need no normaliser but lower case, the pre-tokenizer's pattern on those, and other white space.
PRINTABLE = re.compile(r"[\x21-\x7e]+")
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SPACE = re.compile(r"\s")
NONE = np.iinfo(np.int32).max


class PairIndex:
    """The tokenizer of a BPE file with word ends, encoding many pieces together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or model["continuing_subword_prefix"]:
            raise ValueError("a BPE tokenizer without decoder and prefix is needed")
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs)))
        self.base = max(self.vocab.values()) + 1
        keys, first = np.unique(left * self.base + right, return_index=True)
        self.keys, self.key_rank, self.made = keys, first.astype(np.int32), made
        use = np.full(self.base, len(pairs))
        np.minimum.at(use, np.concatenate([left, right]), np.tile(np.arange(len(pairs)), 2))
        self.lowers = use[made] < np.arange(len(pairs))  # ranks whose product stands in a pair of a lower rank
        self.inside, self.last = np.full(0x200, -1), np.full(0x200, -1)
        for c, end in ((c, e) for c in range(0x200) for e in ("", self.end)):
            (self.last if end else self.inside)[c] = self.vocab.get(chr(c) + end, -1)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = ChunkIds(self.encode_new)

    def pieces_of(self, chunks: list[str]) -> Iterator[list[str | int]]:
        """The pre-tokens of each chunk; special tokens are ids already."""
        slow = [c for c in chunks if not PRINTABLE.fullmatch(c) and not SPACE.search(c) and "<|" not in c]
        joined = dict(zip(slow, self._cut_together(slow)))
        for c in chunks:
            if c in joined:
                yield joined[c]
            elif self.cut_special and "<|" in c:
                yield [x for part in self.cut_special.split(c) if part for x in ([self.special[part]] if part in self.special else self._cut(part))]
            elif PRINTABLE.fullmatch(c):
                yield ASCII.findall(c.lower())
            else:
                yield self._cut(c)

    def _cut(self, text: str) -> list[str]:
        return [x for x, _ in self.cut(self.normal(text))]

    def _cut_together(self, chunks: list[str]) -> Iterator[list[str]]:
        """Chunks without any white space, normalised and cut in few calls of the library."""
        for i in range(0, len(chunks), 512):
            normal = self.normal(" ".join(chunks[i : i + 512]))
            ends = np.cumsum([len(x) + 1 for x in normal.split(" ")])
            cut = self.cut(normal)
            at = np.searchsorted(ends, [e for _, (_, e) in cut], "left")
            found: list[list[str]] = [[] for _ in ends]
            for k, (piece, _) in zip(at, cut):
                found[k].append(piece)
            yield from found

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and the number of each one's, from one pair index.

        Symbols stand at positions, linked to their neighbours within the piece. `lists` maps the rank of each
        pair that occurs to the positions where it begins. Ranks are taken in ascending order; a rank's pairs
        are merged at all its positions, and the positions beside them go to the lists of the pairs that begin
        there now. Entries whose pair has gone are passed over when their rank's turn comes."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not lens.sum():
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        sym = self.inside[points]
        ends = np.cumsum(lens)[lens > 0] - 1
        sym[ends] = self.last[points[ends]]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        sym, word = sym[sym >= 0].astype(np.int32), word[sym >= 0]
        n = len(sym)
        inner = np.flatnonzero(word[1:] == word[:-1])
        right, left = np.full(n, n, np.int32), np.full(n, -1, np.int32)
        right[inner], left[inner + 1] = inner + 1, inner
        rank = np.full(n, NONE, np.int32)  # of the pair that begins at each position
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            positions = positions[rank[positions] < NONE]
            if not len(positions):
                return
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for start, stop in zip(cuts, cuts[1:]):
                r = int(ranks[start])
                if (own := lists.get(r)) is None:
                    lists[r] = [positions[start:stop]]
                    heappush(active, r)
                else:
                    own.append(positions[start:stop])

        enter(np.arange(n, dtype=np.int32))
        while active:
            r = heappop(active)
            hit = np.concatenate(lists.pop(r))
            hit = np.sort(hit[rank[hit] == r])
            if len(hit) > 1:
                # of hits that overlap (a a a), every second one of the run from its left
                near = np.concatenate([[False], right[hit[:-1]] == hit[1:]])
                if near.any():
                    k = np.arange(len(hit))
                    hit = hit[(k - np.maximum.accumulate(np.where(near, 0, k))) % 2 == 0]
                if self.lowers[r]:  # a lower rank may become active beside a merge: the leftmost alone, then again
                    first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
                    if not first.all():
                        lists[r] = [hit[~first]]
                        heappush(active, r)
                        hit = hit[first]
            if not len(hit):
                continue
            gone = right[hit]
            after = right[gone]
            sym[hit], right[hit] = self.made[r], after
            alive[gone] = False
            rank[gone] = NONE
            rank[hit] = NONE
            here, behind = hit[after < n], after[after < n]
            left[behind] = here
            rank[here] = self._rank(sym[here], sym[behind])
            before = left[hit]
            before = before[np.concatenate([before[:1] >= 0, (before[1:] >= 0) & (before[1:] != hit[:-1])])]
            rank[before] = self._rank(sym[before], sym[right[before]])
            enter(np.concatenate([here, before]))
        return sym[alive].astype(np.int32), np.bincount(word[alive], minlength=len(pieces))

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, and the number of each one's; all their distinct pieces are in one index."""
        cut = list(self.pieces_of(chunks))
        place: dict[str | int, int] = {}
        at = np.array([place.setdefault(p, len(place)) for ps in cut for p in ps], np.int64)
        flat, lens = self.merge(["" if isinstance(p, int) else p for p in place])
        for p, k in place.items():
            if isinstance(p, int):  # a special token is a piece of one id
                flat, lens[k] = np.insert(flat, lens[:k].sum(), p), 1
        starts = np.cumsum(lens) - lens
        counts = np.array([len(ps) for ps in cut], np.int64)
        ends = np.concatenate([[0], np.cumsum(lens[at])])[np.cumsum(counts)]
        return gather(flat, starts[at], lens[at]), np.diff(ends, prepend=0)

    def encode_batch(self, texts: pa.Array | list[str | None]) -> pa.Array:
        """The ids of whole texts, as a list array."""
        ids, ends = self.chunks.encode(texts)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


class Names:
    """The tokens' names by id, which decoding needs alone."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        names = {i: x for x, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """The library's decoding without a decoder: the names, of special tokens too, joined by a space. Ids
        without a name are passed over; null lists give the empty text."""
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        named = (flat >= 0) & (flat < len(self.names))
        named[named] = self.names.is_valid().to_numpy(zero_copy_only=False)[flat[named]]
        ends = np.concatenate([[0], np.cumsum(named)])[np.cumsum(lens)] if len(lens) else np.zeros(0, np.int64)
        taken = self.names.take(pa.array(flat[named], pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), taken), " ")


@lru_cache(1)
def worker_index(path: str) -> PairIndex:
    """The index of a Python worker; it serves all tasks that the worker runs."""
    index = PairIndex(path)
    released()  # the file's JSON
    return index


@lru_cache(1)
def worker_names(path: str) -> Names:
    return Names(path)


def encode_batches(index: PairIndex, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ids of a task's texts, INDEXED characters at a time. The chunks that the index knows go with the task: Spark
    keeps more workers than run, takes the one that is idle longest, and they live on through other stages."""
    held, size = [], 0
    try:
        for texts in batches:
            for i in range(0, len(texts), SLICE):
                held.append(texts.slice(i, SLICE))
                size += pc.sum(pc.utf8_length(held[-1])).as_py() or 0
                if size >= INDEXED:
                    yield index.encode_batch(pa.concat_arrays(held))
                    held, size = [], 0
                    released()
        if held:
            yield index.encode_batch(pa.concat_arrays(held))
    finally:
        held = texts = None
        index.chunks.clear()
        released()


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of every whole text."""

    @arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encode_batches(worker_index(path), batches)

    return docs.withColumn(out, encoded(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for."""

    @arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = worker_names(path)
        for ids in batches:
            for i in range(0, len(ids), SLICE):
                yield names.decode_batch(ids.slice(i, SLICE))

    return docs.withColumn(out, decoded(F.col(ids_col)))
