"""Every registered query of the subpackage that has no SQL, through the registry on whole tables, against brute force."""

import base64
import hashlib
import os
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from loomgraph.llm.queries import ORACLES, QUERIES
from tokenizers import Tokenizer

from .test_near_dedup import brute as near_brute
from .test_passages import brute as passage_brute

DATA = Path(os.environ.get("SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def held(ident, n, k):
    return zlib.crc32(str(ident).encode()) % n == k


def test_what_has_no_sql_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"op2_warc", "op3_toxicity", "op5_token_counts", "op7_passages", "op8_near_dedup", "op9_language", "op10_packing"}


def test_op2(spark):
    pages = table(spark, "pages")
    best = {}
    for p in pages:
        body = p.html or ""
        best[body] = max(best.get(body, p.page_id), p.page_id)
    want = {
        (p.page_id, len((p.html or "").encode()), base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode(), *(("response", None) if best[p.html or ""] == p.page_id else ("revisit", best[p.html or ""])))
        for p in pages
    }
    out = QUERIES["op2_warc"](spark, str(DATA))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(pages) and set(rows) == want


def test_op3(spark):
    out = QUERIES["op3_toxicity"](spark, str(DATA))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in table(spark, "documents"))
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic = {x.doc_id: x.toxic for x in table(spark, "labels")}
    score = {y: [r.score for r in rows if toxic.get(r.doc_id) == y] for y in (0, 1)}
    assert np.mean(score[1]) > np.mean(score[0])


def test_op5(spark):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_token_counts"](spark, str(DATA)).collect()}
    for d in table(spark, "documents"):
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert got.pop(d.doc_id) == (len((d.text or "").encode()), n, n > 512)
    assert not got


def test_op7(spark):
    rows = [(d.doc_id, d.text) for d in table(spark, "documents")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_passages"](spark, str(DATA)).collect()}
    assert got == passage_brute(rows)


def test_op8(spark):
    rows = [(d.doc_id, d.text) for d in table(spark, "documents")]
    want, sizes = near_brute(rows)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in QUERIES["op8_near_dedup"](spark, str(DATA)).collect()}
    assert got == {d: (c, n, c == d) for (d, _), c, n in zip(rows, want, sizes, strict=True)}


def test_op9(spark):
    docs = {d.doc_id: d for d in table(spark, "documents")}
    rows = QUERIES["op9_language"](spark, str(DATA)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        lettered = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not lettered)
    judged = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in judged) / len(judged) > 0.95


def test_op10(spark):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op10_packing"](spark, str(DATA)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d in table(spark, "documents"):
        ids, place = [*library.encode(d.text or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(pieces.pop(d.doc_id), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, place) and r.ids_crc32 == zlib.crc32(np.array(ids[place : place + r.length], "<u4").tobytes())
            assert r.length == 1024 or k == 0
            place += r.length
        assert place == len(ids)
    assert not pieces
    for held_in in bins.values():
        place = 0
        for offset, length in sorted(held_in):
            assert offset == place
            place += length
        assert place <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.05 + 1


def test_repeated_rows_are_confirmed_once(spark):
    """Two near documents, each repeated 60 times: one text a document, one pair."""
    from loomgraph.llm import near_dedup

    base = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, base)] * 60 + [(2, base + " more")] * 60, "doc_id long, text string").repartition(4)
    seen, source = [], near_dedup.confirmed

    def counted(pairs, texts):
        out = near_dedup.frozen(source(pairs, texts), "counted")
        seen.append((out.count(), texts.count()))
        return out

    near_dedup.confirmed = counted
    try:
        rows = near_dedup.near_duplicates(docs).collect()
    finally:
        near_dedup.confirmed = source
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1)} and len(rows) == 120
    assert seen[0] == (1, 2) and sum(n for n, _ in seen) == 1


def test_a_hub_meets_its_partners_in_blocks(spark, monkeypatch):
    from loomgraph.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    monkeypatch.setattr(near_dedup, "SHINGLES", 500)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(80)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    pairs = spark.createDataFrame([(0, k) for k in range(1, 80)], "a long, b long")
    texts = spark.createDataFrame(rows, "rid long, text string")
    met = near_dedup.gathered(pairs, texts, ["text"]).collect()
    assert len({r.block for r in met}) == 8 and sum(r.b < 0 for r in met) == 8 and len(met) == 79 + 8
