import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapscan.llm import collocations as C
from gapscan.llm.quotient import QuotientFilter, permute, restore


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.lists(st.integers(0, 2**64 - 1), min_size=0, max_size=80), st.integers(0, 6))
def test_filters_count_without_loss(bits, m, numbers, block_bits):
    ids = np.array([[(x >> j) & ((1 << bits) - 1) for j in range(m)] for x in numbers], np.uint64).reshape(len(numbers), m)
    assert (restore(permute(ids, bits), bits) == ids).all()
    half = len(ids) // 2
    parts = [QuotientFilter.load(QuotientFilter.of(x, bits).dump()) for x in (ids[:half], ids[half:], ids)]
    whole = parts[0].merge(*parts[1:])
    want = Counter({k: 2 * n for k, n in Counter(map(tuple, ids.tolist())).items()})
    assert Counter(dict(zip(map(tuple, whole.keys().tolist()), whole.counts.tolist(), strict=True))) == want
    cut = list(whole.blocks(min(block_bits, bits)))
    assert sum(len(f.counts) for _, f in cut) == len(whole.counts) and len({b for b, _ in cut}) == len(cut)
    assert (whole.at_least(3).counts >= 3).all()


def plain(rows, least, top):
    n, f = Counter(), {}
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, b in candidates.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    if 100 * b >= 100 * counts[q[i : i + m]]:
                        gone.add(q[i : i + m])
        found = []
        for p, a in candidates.items():
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus():
    rng, rows = random.Random(7), []
    words = [f"w{i}" for i in range(30)] + ["Don't", "ÄÖ", "的", "x-y", "#1"]
    for i in range(150):
        drawn = [rng.choice(words[: 4 + i % 30]) for _ in range(rng.choice([0, 3, 40, 200]))]
        text = "".join(w + rng.choice([" ", "\t", "  ", ". ", ",", "\r\n", "!?"]) if rng.random() < 0.3 else w + " " for w in drawn)
        if i % 4 == 0:
            text += " New York City hall is here." * rng.randrange(6)
        rows.append((i % 20 if i % 7 else None, text, rng.choice(["en", "de", None, "und"])))
    return [*rows, (1, None, "en"), (2, "", "en"), (3, " .,", None), (4, "go " * 900, "fr"), (5, "y" * 3_000_000 + " go go " * 40, "fr")]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (12, 7)])
def test_against_plain_counts(spark, least, top):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, lang string, phrase string").repartition(6)
    got = sorted(tuple(r) for r in C.collocations(docs, least=least, top=top, block_words=200).collect())
    assert got == plain(rows, least, top) and got
    if least == 5:
        con = duckdb.connect()
        documents = docs.toPandas()  # noqa: F841
        assert sorted(con.sql(C.oracle_sql(least=least, top=top)).fetchall()) == got


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert C.collocations(docs.limit(0)).count() == 0 and C.collocations(docs, least=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    key = bytes(7) + b"\x01" + bytes(7) + b"\x02"
    big = [(b, a, lang, 9 * 10**15, w) for b, a, lang, w in [(key[:8], 4 * 10**9, "en", "a"), (key[8:], 3 * 10**9, "en", "b")]]
    singles = spark.createDataFrame([(bytearray(k), *r) for k, *r in big], "key binary, a long, lang string, n long, word string")
    phrases = spark.createDataFrame([(bytearray(key), 2 * 10**9, 2)], "key binary, a long, m int")
    out = C._spelled(C._ranked(phrases, singles, 5, 10), singles, 10).collect()
    assert [tuple(r) for r in out] == [("en", 1, "a b", 2 * 10**9, 4 * 10**9, 3 * 10**9, 9 * 10**15, 1000 * 2 * 10**9 * 9 * 10**15 // (12 * 10**18))]


def test_shared_ids_are_found(spark, monkeypatch):
    """Under a hash that takes all words of a length for one, every seed fails and says so."""
    monkeypatch.setattr(C.Words, "ids", lambda self, langs, seed, bits=64: (self.end - self.start).astype(np.uint64) << np.uint64(50))
    batch = spark.createDataFrame([("aa bb aa bb cc", "en")], "text string, lang string").toArrow().to_batches()
    counted = [r for b in C._count_words(batch, 0) for r in b.to_pylist()]
    assert sum(r["n"] for r in counted) == 5 and {r["word"] for r in counted} == {"aa", "bb", "cc"} and len({r["id"] for r in counted}) == 1


def test_segments_and_whole_agree(monkeypatch):
    text = b"alpha beta. gamma\tdelta, " * 3000 + b"z" * 5000
    whole = C.Words([text, None, b"alpha"])
    monkeypatch.setattr(C, "_SEGMENT", 700)
    cut = C.Words([text, None, b"alpha"])
    for name in ("hash", "piece", "start", "end", "text"):
        assert (getattr(whole, name) == getattr(cut, name)).all(), name
    assert whole.text[-1] == 2 and whole.hash[-1] == whole.hash[0]
