import random
import re
import zlib
from collections import Counter

import pytest

from gapscan.llm.spelling import grouped, near_words, spelling_variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = next((k for k, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))
    return u[i + (len(u) == len(v)) :] == v[i + 1 :]


def plain(rows, shortest=7, least=2, times=10):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def corpus():
    rng, rows = random.Random(4), []
    bases = ["".join(rng.choices("abcdeéß", k=rng.randrange(6, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab", "babababa", "bananas"]
    for i in range(120):
        words = []
        for _ in range(60):
            w = list(rng.choice(bases[: 1 + i % len(bases)]))
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice("abcÉ") * rng.randrange(2)
            words.append("".join(w).capitalize() if rng.random() < 0.1 else "".join(w))
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "1", "-", "ı"]).join(words)))
    return [*rows, (7, None), (8, ""), (9, "9 _ ×÷"), rows[3], rows[3], (10, ("q" * 3000 + " ") * 3 + ("q" * 2999 + " ") * 2), (11, "straße " * 50)]


@pytest.mark.parametrize("most_words", [4096, 6, 1])
def test_against_all_pairs(spark, most_words):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted(tuple(r) for r in spelling_variants(docs, most_words=most_words).collect())
    want = plain(rows)
    assert got == want and any(r[1] for r in want) and max(r[4] for r in want) > 3


def test_short_words_of_every_length(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=random.Random(i).randrange(1, 7))) for i in range(300)})
    docs = spark.createDataFrame([(w, 10 * i + 1) for i, w in enumerate(words)], "word string, n long")
    for most in (500, 3):
        got = {r.word: (r.n_near, r.other) for r in near_words(docs, most).collect()}
        for w in words:
            near = [v for v in words if one_edit(w, v)]
            assert got[w] == (len(near), max(near, key=words.index, default=None))


def test_large_groups_are_cut(spark):
    """A third of all words share their first half: no group stays beyond its bound."""
    rng = random.Random(2)
    words = {"common" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(1500)} | {"".join(rng.choices("abcdefgh", k=12)) for _ in range(3000)}
    rows = grouped(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most_words=60)
    assert rows.groupBy("L", "key").count().agg({"count": "max"}).first()[0] <= 60


def test_chains_of_forms(spark):
    """Each form is ten times as common as the last; roots lead to the end."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    words = [(i, (w + " ") * 2 * 11**i) for i, w in enumerate(chain)]
    docs = spark.createDataFrame(words, "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling_variants(docs).collect()}
    want = {r[0]: (r[1], r[2]) for r in plain(words)}
    assert got == want and got["abcdefgh"][1] == "abcdezyx"


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
