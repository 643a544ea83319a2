import random
import zlib

import numpy as np
import pytest
from loomgraph.llm import packing, tokens

ODD = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "\xa0", "'s", "'ll", "é", "中", "１", "½", "_", "<|endoftext|>", "😀", "é", "​", "the ", "ing", "!!!", "aaaa", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def odd_texts():
    random.seed(11)
    return ["".join(random.choices(ODD, k=random.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 2500 + "x", "".join(random.choices("abcdefgh", k=9000))]


def test_counts_equal_the_library(library):
    texts = odd_texts()
    assert tokens.RankMerger(tokens.vocabulary_path()).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_go_in_slices(library, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 50)
    texts = [t for t in odd_texts() if len(t) > 60][:200]
    assert tokens.RankMerger(tokens.vocabulary_path()).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_count_rows(edge_docs, empty_docs, library):
    rows = tokens.token_counts(edge_docs).collect()
    assert len(rows) == 13 and tokens.token_counts(empty_docs).collect() == []
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_bytes, by[1].n_tokens, by[1].over_limit) == (0, 0, False)
    assert by[8].over_limit and by[9].n_bytes == 8 and by[5].n_tokens == len(library.encode("Same Text here").ids)


def test_ids_equal_the_library(library):
    e = packing.Encoder(tokens.vocabulary_path())
    for t in odd_texts():
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids


def test_pack_whole_documents(edge_docs, empty_docs, library):
    assert packing.pack(empty_docs).collect() == []
    rows = packing.pack(edge_docs, size=64, per_group=5).collect()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for ident, held in by.items():
        ids = np.array([*library.encode(texts[ident], add_special_tokens=False).ids, 2], "<u4")
        times = 2 if ident == 11 else 1
        assert sum(r.length for r in held) == times * len(ids)
        for r in held:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 64 or r.piece == 0
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))] and sum(r.length for r in held) <= 64


def test_best_two_fit_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 5000)
    bin_of, offset = packing.best_two_fit(lengths)
    load = np.bincount(bin_of, weights=lengths)
    assert load.max() <= 1024 and len(load) <= lengths.sum() / 1024 * 1.03 + 1
    assert (offset + lengths <= 1024).all()


def test_two_fit_replaces_the_smallest():
    # 600 + 300 leaves 124; 250 + 170 fill the 424 better than 300
    bin_of, _ = packing.best_two_fit(np.array([600, 300, 250, 170]), 1024)
    assert sorted(np.bincount(bin_of, weights=[600, 300, 250, 170]).tolist()) == [300.0, 1020.0]
