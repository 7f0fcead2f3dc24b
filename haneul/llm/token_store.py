"""Token ids in files of directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k stores the k-th chunks of
the ids that have one, a bitmap that says whether a further chunk follows, and a rank
directory (set bits before each block of BLOCK bits). Token i's chunk is read at i; if its bit
is set, its next chunk stands at rank(i) one level below, and so on: any token is reached
without decoding a block.

Documents are written in ascending id order: Spark deals ranges of ids to tasks, which sort
them; a task encodes 1,024 texts at a time and writes files of about `max_ids` ids at most (a
file ends after the batch that reaches them). A file carries the documents' ids and ends, so reading needs only the files and their manifest,
whose running total of ids (a row per file) gives every file its place.

Nulls: a null text is the end id alone; a null document id comes first. Rows with equal ids
are ordered by their text's hash, and ranges part them by it too. Very long texts are encoded
whole. An empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import Kept, gather, ids_of_texts, strings
from .warc import _open

MAGIC = b"DAC1"
CHUNK_BITS = 8
BLOCK = 512
#: Tasks that documents are dealt to at most; beyond, each takes more.
MAX_RANGES = 16_384
_NULL_ID = -(1 << 63)
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
MANIFEST = "range int, part int, file string, n_ids long, n_docs long"


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: list[int]) -> bytes:
    """The bytes of a file: header, documents, then levels of chunks, bitmap and rank directory."""
    out = [np.array([_NULL_ID if x is None else x for x in doc_ids], "<i8").tobytes(), np.array(ends, "<u8").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        low, high = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), rest >> CHUNK_BITS
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_COUNTS[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))]).astype("<u8")
        out += [struct.pack("<Q", len(rest)), low.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = high[more], levels + 1
    return MAGIC + struct.pack("<IQQ", levels, len(ids), len(doc_ids)) + b"".join(out)


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n_ids, n_docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_bits = -(-(-(-n // 8)) // (BLOCK // 8)) * (BLOCK // 8)
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 8 + n)
            ranks = np.frombuffer(data, "<u8", n_bits * 8 // BLOCK + 1, at + 8 + n + n_bits).astype(np.int64)
            self.levels.append((low, bits, ranks))
            at += 8 + n + n_bits + ranks.nbytes

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = self.levels[level]
        block, byte = i // BLOCK, i // 8
        inside = int(_COUNTS[bits[block * BLOCK // 8 : byte]].sum(dtype=np.int64)) if i % BLOCK else 0
        return int(ranks[block]) + inside + (int(_COUNTS[bits[byte] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << (CHUNK_BITS * k)
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(k, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop: each level's chunks of the range lie together."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, (low, bits, _) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= low[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            where = where[more]
            start = self._rank(k, start)
            stop = start + len(where)
        return out


#: Words that the library encodes in one text, and chunks that this tokenizer surely cuts into one piece of letters
#: and one of signs behind them, if any. Its pieces end in ids of their own.
JOINED = 64
LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = rf"^(?P<word>[{LETTERS}]+)(?P<signs>[!-&(-/:-@\[-`{{-~]*)$"
#: Pieces that a worker keeps at most; beyond, it starts anew.
PIECES = 400_000


class LibraryEncoder:
    """The tokenizers library over the distinct chunks of texts, and within these over the distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.closing[[i for x, i in names.items() if x.endswith("</w>")]] = True
        letters = [chr(i) for i in range(256) if re.match(f"[{LETTERS}]", chr(i))]
        normal = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.lowers = all(normal(x) == normal(x.lower()) for x in letters)  # so words may be told apart by their lower case
        self.clear()

    def clear(self) -> None:
        self.kept = Kept()
        self.kept.add([""], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the place where each text's end."""
        if len(self.kept.known) > PIECES:
            self.clear()
        return ids_of_texts(texts, self._of_chunks)

    def _learn_words(self, words: list[str]) -> None:
        """Keep the new ones of words, encoded JOINED at a time and told apart by the ids that end a piece."""
        new = [x for x in words if x not in self.kept.known]
        groups, found, lens, ids = [new[i : i + JOINED] for i in range(0, len(new), JOINED)], [], [], []
        for group, own in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.closing[own]) + 1
            if len(ends) == len(group) and ends[-1] == len(own):
                found += group
                lens.append(np.diff(ends, prepend=0))
                ids.append(own)
            else:
                self.kept.known.update(dict.fromkeys(group, -1))  # the library cuts them otherwise
        if found:
            self.kept.add(found, np.concatenate(ids), np.concatenate(lens))

    def _learn_signs(self, behind: dict[str, str]) -> None:
        """Keep new signs, each tried behind a word: they count as a piece if they change none of its ids."""
        for x, word in behind.items():
            both, own, alone = self._ids([word + x, x, word])
            if self.closing[own].sum() == 1 and self.closing[own[-1]] and np.array_equal(both, np.concatenate([alone, own])):
                self.kept.add([x], own, np.array([len(own)]))
            else:
                self.kept.known[x] = -1

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks: those of their pieces where they surely have one or two, which many chunks
        share; other chunks are encoded each. The fast calls leave out offsets."""
        plain = pc.extract_regex(chunks, PLAIN if self.closing.any() else "^(?P<word>)(?P<signs>)$")
        sure = plain.is_valid().to_numpy(zero_copy_only=False).copy()
        words, signs = (plain.filter(plain.is_valid()).field(x) for x in ("word", "signs"))
        words, signs = ((pc.utf8_lower(words) if self.lowers else words).dictionary_encode(), signs.dictionary_encode())
        word_at, sign_at = (x.indices.to_numpy(zero_copy_only=False) for x in (words, signs))
        words, signs = strings(words.dictionary), strings(signs.dictionary)
        self._learn_words(words)
        if fresh := [k for k, x in enumerate(signs) if x not in self.kept.known]:
            first = np.zeros(len(signs), np.int64)
            first[sign_at[::-1]] = np.arange(len(sign_at))[::-1]
            self._learn_signs({signs[k]: words[word_at[first[k]]] for k in fresh})
        pieces = np.full((len(chunks), 2), -1)
        pieces[sure, 0], pieces[sure, 1] = self.kept.numbers(words)[word_at], self.kept.numbers(signs)[sign_at]
        sure = (pieces >= 0).all(1)
        starts, lens = (np.where(sure[:, None], np.array(x, np.int64)[pieces], 0) for x in (self.kept.starts, self.kept.lens))
        flat, at = [np.array(self.kept.ids, np.int32)], len(self.kept.ids)
        for k, ids in zip(np.flatnonzero(~sure).tolist(), self._ids(chunks.filter(pa.array(~sure)).to_pylist())):
            starts[k, 0], lens[k, 0] = at, len(ids)
            flat.append(ids)
            at += len(ids)
        lens_of = lens.sum(1)
        return gather(np.concatenate(flat), starts.ravel(), lens.ravel()), np.cumsum(lens_of) - lens_of, lens_of

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 4096):
            yield from (np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False))


@lru_cache(1)
def worker_encoder(path: str) -> LibraryEncoder:
    """The encoder of a Python worker, with the chunks it knows; it serves all tasks that the worker runs."""
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, root: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, rows_per_range: int = 4_000, max_ids: int = 1 << 24) -> DataFrame:
    """Encode, write the files below `root` and return their manifest, a row per file. Documents are dealt
    to tasks by ranges of about rows_per_range rows, at most MAX_RANGES of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    parts = min(max(1, -(-rows.count() // rows_per_range)), MAX_RANGES)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (fs, folder) = worker_encoder(path), _open(f"{root}/files")
        ids, doc_ids, ends, at, part = array("i"), [], [], None, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, ends, part
            fs.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(pack(np.frombuffer(ids, np.uint32), doc_ids, ends))
            made = (at, part, name, len(ids), len(doc_ids))
            ids, doc_ids, ends, part = array("i"), [], [], part + 1
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(made, types)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                at = some.column(0)[0].as_py()  # all rows of a task are of one range
                found, stops = encoder.encode(some.column(2))
                lens = np.diff(stops, prepend=0) + 1
                own = np.full(lens.sum(), end_id, np.int32)
                closing = np.zeros(len(own), bool)
                closing[np.cumsum(lens) - 1] = True
                own[~closing] = found
                doc_ids += some.column(1).to_pylist()
                ends += (len(ids) + np.cumsum(lens)).tolist()
                ids.frombytes(own.tobytes())
                if len(ids) >= max_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    names, types = [x.split()[0] for x in MANIFEST.split(", ")], [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    rows.select(F.spark_partition_id().alias("range"), "doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_tokens(manifest: DataFrame, root: str, with_ids: bool = True) -> DataFrame:
    """A row per document from the files: doc_id, start (its place among all ids), n_tokens,
    ids_crc32, and its ids. A task reads a file at a time, of bounded size."""
    order = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("file", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(f"{root}/files")
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    file = TokenFile(f.read())
                starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
                for i in range(0, len(starts), 1024):
                    own = [file.slice(s, e) for s, e in zip(starts[i : i + 1024], file.ends[i : i + 1024])]
                    columns = [pa.array([None if x == _NULL_ID else int(x) for x in file.doc_ids[i : i + 1024]], pa.int64()), pa.array(starts[i : i + 1024] + base, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array(own, pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    n = max(1, manifest.count())
    return placed.repartition(min(n, 4096), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
