import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from gapscan.llm.divergence import CLASSES, LONGEST, judge_quality, oracle_sql

WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


def plain(rows, common_words=100, min_docs=20, most_char=0.25, most_word=0.5, min_chars=200, min_words=50):
    """The same rules, text by text."""

    def kind(c):
        n = ord(c)
        for name, hit in {
            "lower": "a" <= c <= "z", "upper": "A" <= c <= "Z", "digit": "0" <= c <= "9", "white": c in " \t\n\v\f\r", "stop": c in ".,;:!?\"'()-", "symbol": c in "#*$%&|<>",
            "ascii": n < 128, "mark": n < 0xC0 or 0x2000 <= n < 0x3000, "latin": n < 0x800, "script": n < 0x10000,
        }.items():
            if hit:
                return name
        return "far"

    docs = []
    for id_, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        low = [re.sub(r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in words]
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        base = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed]
        docs.append((id_, lang or "und", Counter(map(kind, text)), Counter(low), base))
    classes, words_, sizes = {}, {}, Counter()
    for _, lang, c, w, base in docs:
        if not base[5]:
            sizes[lang] += 1
            for k, n in c.items():
                classes.setdefault(lang, Counter())[k] += 1_000_000 * n // sum(c.values())
            for k, n in w.items():
                if 0 < len(k) <= LONGEST:
                    words_.setdefault(lang, Counter())[k] += 1_000_000 * n // base[0]

    def distance(p, q):
        bits = lambda x, m: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return round(math.sqrt(max(0, (bits(p, m) + bits(q, m)) / 2)), 6)

    out = []
    for id_, lang, c, w, base in docs:
        cd = wd = None
        if sizes[lang] >= min_docs:
            if base[1] >= min_chars:
                ref = [classes[lang][k] for k in CLASSES]
                cd = distance([c[k] / sum(c.values()) for k in CLASSES], [x / sum(ref) for x in ref])
            if base[0] >= min_words:
                best = sorted(words_[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:common_words]
                ref = [n / (1e6 * sizes[lang]) for _, n in best]
                mine = [w[k] / base[0] for k, _ in best]
                wd = distance([*mine, 1 - sum(mine)], [*ref, max(0, 1 - sum(ref))])
        kept = not base[5] and not (cd is not None and cd > most_char) and not (wd is not None and wd > most_word)
        out.append((id_, *base, kept, cd, wd))
    return out


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=repr), sorted(b, key=repr), strict=True):
        assert x[:8] == y[:8]
        assert all((p is None) == (q is None) and (p is None or abs(p - q) < 3e-6) for p, q in zip(x[8:], y[8:], strict=True)), (x, y)


def corpus():
    rng, rows = random.Random(1), []
    for i in range(90):
        n = rng.choice([10, 30, 60, 200])
        words = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choices("aeionrst", k=5)) for _ in range(n)]
        text = " ".join(words).capitalize() + ".\n"
        if i % 9 == 0:
            text = " ".join(w + "###" for w in words)
        if i % 11 == 0:
            text = text * 3
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n\v\f\r ", "en"), (None, rows[5][1], "xx"), (5, rows[5][1], "en"), (103, "Ünï “q” 漢字 😀 \x00\x85 " * 40, "en"), (104, "\n a b\n\n a b\n a b \n" * 9, "en")]
    rows += [(105, "w" * 300_000 + " " + "x y z " * 60_000, "en")]
    return rows


def test_against_plain_rules(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, "z") for i, t, g in rows], "doc_id long, text string, lang string, kept string").repartition(5)
    got = [tuple(r) for r in judge_quality(docs).collect()]
    want = plain(rows)
    close(got, want)
    assert {r[7] for r in want} == {True, False} and any(not r[6] and not r[7] for r in want)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert judge_quality(docs.limit(0)).count() == 0
    nothing = judge_quality(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(corpus()) and all(r.base_failed and not r.kept and r.n_words == 0 for r in nothing)


def test_against_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = judge_quality(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in out if r.quality], [r for r in out if not r.quality]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_sql_twin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    twin = con.sql(oracle_sql())
    assert twin.columns == judge_quality(docs).columns
    close([tuple(r) for r in judge_quality(docs).collect()], twin.fetchall())
