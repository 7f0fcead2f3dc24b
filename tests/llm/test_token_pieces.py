"""The store's encoder asks the library once for a word, whatever signs stand behind it, and gives its ids."""

import random

import pyarrow as pa

from haneul.llm import bpe, queries, token_store

ODD = ["", None, "a's don't 's", "<|endoftext|> x<|endoftext|>", "ÀÉîöÿ! Straße?! ﬁ ß", "á, b,​c", "x1, 12% (a) a-b a_b ``q''", "é, É; ÷, ×.", "</w> a</w>, @@ ##"]


def test_ids_are_the_librarys():
    rng = random.Random(5)
    words, signs = ["the", "Tion", "éa", "x" * 300, "ion", "re", "s", "t"], ["", ",", ".", "!?", "...", "-", ")", '"', "$%", "'s", "</", "|>", "<|"]
    texts = ODD + [" ".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(50)]
    encoder = token_store.LibraryEncoder(queries.tokenizer_path())
    for _ in range(2):
        ids, ends = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_encoded_once(monkeypatch):
    encoder = token_store.LibraryEncoder(queries.tokenizer_path())
    encoder.encode(["tionand, the. of! it?"])
    asked = []
    inner = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or inner(texts))
    encoder.encode(["tionand. tionand! the, it, of? the! tionand?"])
    assert asked == []


def test_a_word_is_encoded_once_in_whatever_case(monkeypatch):
    encoder = token_store.LibraryEncoder(queries.tokenizer_path())
    encoder.encode(["Tionand straße,"])
    asked = []
    inner = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or inner(texts))
    ids, _ = encoder.encode(["TIONAND tionand, STRAßE, Straße"])
    assert asked == [] and ids.tolist() == encoder.library.encode("TIONAND tionand, STRAßE, Straße", add_special_tokens=False).ids


def test_an_arrow_array_is_encoded_without_python_strings_of_it():
    texts = ["x"] + ODD + [" a\x0bb\x0c\r\n", "c\x1cd\x85e\xa0f g  ", "\n\n"]
    encoder = token_store.LibraryEncoder(queries.tokenizer_path())
    ids, ends = encoder.encode(pa.array(texts).slice(1))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def test_an_idle_worker_keeps_no_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "INDEXED", 100)
    index, texts = bpe.worker_index(queries.tokenizer_path()), ODD + ["some words " * 30] + ODD
    library = token_store.LibraryEncoder(queries.tokenizer_path()).library
    parts = bpe.encode_batches(index, iter([pa.array(texts[:5]), pa.array(texts[:0], pa.string()), pa.array(texts[5:])]))
    got = next(parts).to_pylist()
    assert index.chunks.kept.known
    for part in parts:
        got += part.to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not index.chunks.kept.known
