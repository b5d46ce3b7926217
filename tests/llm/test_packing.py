import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapscan.llm.packing import best_fit, pack_documents
from gapscan.llm.tokens import ChunkTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunk_ids_equal_plain_encoding():
    plain, cached = Tokenizer.from_file(PATH), ChunkTokenizer(PATH, max_chunks=20)
    texts = [
        "It's ’ don't ́abc é  x　y ΑΣ ΣΑΣ İstanbul ... a.b, (x)!!! %%% don't. 12a3 ÉTÉ; 7.",
        "<|endoftext|> a\x1cb <|startoftext|>",
        "",
        "   \n",
        "the The THE the, the. the.. the's 'the' l'eau " * 30,
        "ß ẞ ſ K Å ﬁ ½ ² x² ٣ 漢字 😀 a​b",
    ]
    for text in texts + texts:
        assert np.frombuffer(cached.id_bytes(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_mixed_scripts_equal_plain_encoding():
    plain, cached = Tokenizer.from_file(PATH), ChunkTokenizer(PATH, max_chunks=500)
    rng = random.Random(6)
    spans = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x400), (0x400, 0x530), (0x590, 0x700), (0x900, 0x980), (0x1100, 0x1200),
             (0x1E00, 0x2070), (0x2100, 0x2150), (0x3040, 0x3100), (0xAC00, 0xAD00), (0xFB00, 0xFB07), (0x1F600, 0x1F650)]

    def word():
        if rng.random() < 0.4:
            return "".join(rng.choice("abeISTİıÉßΣς") for _ in range(rng.randint(1, 5))) + rng.choice([".", "!", "?,", "...", "'s", '"', ")"])
        lo, hi = rng.choice(spans)
        return "".join(chr(rng.randrange(lo, hi)) if rng.random() < 0.8 else rng.choice("İı'.-") for _ in range(rng.randint(1, 6)))

    texts = ["aİ.", "TATİLİ!", "Aİ, b", "aİb cİ dd"] + [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(cached.id_bytes(text), "<u4").tolist() == want.ids, text


def test_best_fit_prefers_the_tightest_bin():
    bins = best_fit([60, 50, 40, 50, 100], 100)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3], [4]]


def check(pieces, texts, capacity):
    plain = Tokenizer.from_file(PATH)
    want = {k: plain.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    seen = {}
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert len(ids) == p.length and p.start == p.piece * capacity
        assert p.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        seen[p.doc_id] = seen.get(p.doc_id, 0) + p.length
    assert seen == {k: len(v) for k, v in want.items()}
    spans = {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for members in spans.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans), sum(map(len, want.values()))


def test_round_trip_and_fill(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = pack_documents(docs.repartition(6), PATH).collect()
    n, total = check(pieces, texts, 2048)
    assert n <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("capacity", [4, 64])
def test_edges(spark, capacity):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 700, "c"), (4, "one two three", None), (5, " \n", "x"), (6, "…" * 300, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    pieces = pack_documents(docs, PATH, capacity=capacity, slack=1, held=5, fan_in=2).collect()
    check(pieces, {r[0]: r[1] for r in rows}, capacity)


def test_empty_and_null_id(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    out = pack_documents(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string"), PATH).collect()
    assert sorted(str(r.doc_id) for r in out) == ["7", "7", "None"] and len({r.sequence_id for r in out}) == 1
