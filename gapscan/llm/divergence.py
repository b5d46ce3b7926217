"""Quality rules with a verdict by distribution divergence.

1. One pass over the whole texts works out the base rules and adds up, for each language,
   character-class and word histograms of all documents that pass them: every document
   weighs one million parts, so that long ones do not drown the others.
2. A language's reference is its mean character-class histogram and the mean shares of
   its ``common_words`` commonest words, the rest of the words being one more bin.
   A language has one if at least ``min_docs`` documents and one in ``rarest`` of all stand
   behind it; at most ``rarest`` languages can, so what is broadcast is bounded.
3. A second pass compares each document with the reference of its language by the
   Jensen-Shannon distance (root of the divergence in bits, 0 to 1).  It is kept when both
   distances are within their bounds.  Short documents scatter: characters are compared
   from ``min_chars`` on and words from ``min_words`` on, fewer are taken as they are.

Words are what stands between ASCII white space; as common words they are lower-cased
(A-Z), stripped of the punctuation at both ends, and of at most 32 characters.

Defined cases: a null or empty text, or one of white space, has no words and fails the
base rules; a null language is ``und``; a document of a language without a reference is
judged by the base rules alone; null and repeated ids are judged row by row, rows alike in
text and language alike; among words of equal weight the smaller in byte order is the
commoner; a distance of just the bound is kept; very long texts are read whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

STRIPPED = b".,;:!?\"'()"
LONGEST = 32
CLASSES = ("lower", "upper", "digit", "white", "stop", "symbol", "ascii", "latin", "mark", "script", "far")
_SKIP = len(CLASSES)
_FLUSH = 200_000


def _byte_classes() -> np.ndarray:
    """The class of a code point by the first byte of its UTF-8 form; further bytes are skipped."""
    of = np.full(256, CLASSES.index("ascii"), np.uint8)
    ranges = {"lower": b"az", "upper": b"AZ", "digit": b"09", "white": b"\x09\x0d", "latin": b"\xc3\xdf", "script": b"\xe0\xef", "far": b"\xf0\xff"}
    for name, (low, high) in ranges.items():
        of[low : high + 1] = CLASSES.index(name)
    for name, members in {"white": b" ", "stop": STRIPPED + b"-", "symbol": b"#*$%&|<>", "mark": b"\xc2\xe2"}.items():
        of[list(members)] = CLASSES.index(name)
    of[0x80:0xC0] = _SKIP
    return of


_CLASS = _byte_classes()


def class_counts(data: np.ndarray, sizes: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Code points of each class in each of the texts that lie end to end in ``data``."""
    n, width = len(sizes), _SKIP + 1
    out, owner_end = np.zeros(n * width, np.int64), np.cumsum(sizes)
    for at in range(0, len(data), step):
        part = data[at : at + step]
        owner = np.searchsorted(owner_end, np.arange(at, at + len(part)), side="right")
        out += np.bincount(owner * width + _CLASS[part], minlength=n * width)
    return out.reshape(n, width)[:, :_SKIP]


def _segments(raw: bytes, size: int = 1 << 20):
    """``raw`` in pieces that end before white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int, window: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of eight found twice or more in it.  Windows
    are named by doubling: a pair of names of half windows gets a name of its own, so
    equal names are equal windows and nothing is hashed."""
    if len(ids) < window:
        return np.zeros(docs, np.int64)
    names, span = ids.astype(np.int64), 1
    while span < window:
        names = np.unique(names[:-span] * (names.max() + 1) + names[span:], return_inverse=True)[1]
        span *= 2
    within = np.flatnonzero(doc[: len(names)] == doc[window - 1 :])
    of, times = np.unique(doc[within] * np.int64(names.max() + 1) + names[within], return_inverse=True, return_counts=True)[1:]
    hit = within[times[of] > 1]
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + window, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=docs)


class Texts:
    """The measures of a batch of whole texts."""

    def __init__(self, column: pa.Array, min_words: int = 20, most_repeated: int = 30):
        column = column.cast(pa.large_binary()).fill_null(b"")
        n, offsets = len(column), np.frombuffer(column.buffers()[1], np.int64)
        offsets = offsets[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.classes = class_counts(data, np.diff(offsets))
        self.word_chars = self.classes.sum(1) - self.classes[:, CLASSES.index("white")]
        self.symbols = self.classes[:, CLASSES.index("symbol")]
        self.dup_lines, counts, parts = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        seen: dict[bytes, int] = {}
        for i in range(n):
            raw = column[i].as_py()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            self.dup_lines[i] = len(lines) - len(set(lines))
            for piece in _segments(raw):
                words = piece.split()
                counts[i] += len(words)
                parts.append(np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int32, len(words)))
        self.n_words = counts
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.doc = np.repeat(np.arange(n), counts)
        self.repeat_words = repeated_words(self.ids, self.doc, n)
        self.base_failed = (counts < min_words) | (100 * self.repeat_words > most_repeated * counts)
        self.words = [w.lower().strip(STRIPPED) for w in seen]


def _shares(part, whole):
    return 1_000_000 * part // np.maximum(whole, 1)


def _count(batches, min_words: int, most_repeated: int):
    """``(lang, term, parts)``: what documents that pass the base rules add to their language."""
    found: Counter = Counter()

    def out():
        keys = list(found)
        return pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "term": [k[1] for k in keys], "parts": list(found.values())})

    for batch in batches:
        t = Texts(batch.column(0), min_words, most_repeated)
        langs = batch.column(1).to_pylist()
        good = ~t.base_failed
        for i in np.flatnonzero(good):
            found[langs[i], "d:"] += 1
            for name, share in zip(CLASSES, _shares(t.classes[i], t.classes[i].sum()).tolist(), strict=True):
                found[langs[i], "c:" + name] += share
        names = sorted(set(langs))
        lang = np.array([names.index(x) for x in langs], np.int64)
        at = good[t.doc]
        width, terms = len(t.words), [w.decode("utf-8", "replace") if 0 < len(w) <= 4 * LONGEST else "" for w in t.words]
        merged: dict[str, int] = {}
        term = np.fromiter([merged.setdefault(x if len(x) <= LONGEST else "", len(merged)) for x in terms], np.int64, width)
        of, times = np.unique(t.doc[at] * np.int64(width + 1) + (term[t.ids[at]] if width else 0), return_counts=True)
        doc, term = of // (width + 1), of % (width + 1)
        key, back = np.unique(lang[doc] * np.int64(width + 1) + term, return_inverse=True)
        parts = np.bincount(back, _shares(times, t.n_words[doc]), minlength=len(key)).astype(np.int64)
        texts = list(merged)
        for k, share in zip(key.tolist(), parts.tolist(), strict=True):
            if texts[k % (width + 1)]:
                found[names[k // (width + 1)], "w:" + texts[k % (width + 1)]] += share
        if len(found) > _FLUSH:
            yield out()
            found.clear()
    if found:
        yield out()


def language_references(
    docs: DataFrame, common_words: int = 100, min_docs: int = 20, rarest: int = 10_000, min_words: int = 20, most_repeated: int = 30,
    text_col: str = "text", lang_col: str = "lang",
) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """``lang -> (class shares, common word -> bin, word shares with the rest last)``."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    parts = read.mapInArrow(lambda it: _count(it, min_words, most_repeated), "lang string, term string, parts long")
    sums = common.staged(parts.groupBy("lang", "term").agg(F.sum("parts").alias("parts")), "histograms")
    sizes = sums.filter("term = 'd:'")
    least = sizes.agg(F.sum("parts")).first()[0] or 0
    known = sizes.filter((F.col("parts") >= min_docs) & (F.col("parts") * rarest >= least)).select("lang", F.col("parts").alias("docs"))
    order = Window.partitionBy("lang").orderBy(F.desc("parts"), "term")
    words = sums.filter("term LIKE 'w:%'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= common_words)
    rows = words.drop("place").unionByName(sums.filter("term LIKE 'c:%'")).join(F.broadcast(known), "lang").collect()
    common.discard(sums)
    out = {}
    for lang in {r["lang"] for r in rows}:
        mine = [r for r in rows if r["lang"] == lang]
        of = {r["term"]: r["parts"] / (1e6 * r["docs"]) for r in mine}
        best = sorted((r for r in mine if r["term"].startswith("w:")), key=lambda r: (-r["parts"], r["term"].encode()))
        shares = np.array([of[r["term"]] for r in best])
        classes = np.array([of.get("c:" + c, 0.0) for c in CLASSES])
        out[lang] = classes / classes.sum(), {r["term"][2:].encode(): i for i, r in enumerate(best)}, np.append(shares, max(0.0, 1 - shares.sum()))
    return out


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The distance between each row of ``counts``, taken as shares, and ``reference``."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    mean = (p + reference) / 2

    def bits(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(mean > 0, mean, 1)), 0.0).sum(1)

    return np.sqrt(np.clip((bits(p) + bits(np.broadcast_to(reference, p.shape))) / 2, 0, 1))


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "char_distance double, word_distance double"
)


def _judge(batches, references, limits, min_words: int, most_repeated: int):
    for batch in batches:
        t = Texts(batch.column(1), min_words, most_repeated)
        langs = np.array(batch.column(2).to_pylist(), object)
        char_d, word_d = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
        for lang in set(langs) & references.keys():
            classes, bins, shares = references[lang]
            mine = np.flatnonzero(langs == lang)
            far = mine[t.word_chars[mine] >= limits["min_chars"]]
            char_d[far] = jensen_shannon(t.classes[far], classes)
            long = mine[t.n_words[mine] >= limits["min_words"]]
            row = np.full(len(langs), -1)
            row[long] = np.arange(len(long))
            at = np.flatnonzero(row[t.doc] >= 0)
            place = np.fromiter((bins.get(w, len(bins)) for w in t.words), np.int64, len(t.words))
            width = len(shares)
            hits = np.bincount(row[t.doc[at]] * width + place[t.ids[at]], minlength=len(long) * width)
            word_d[long] = jensen_shannon(hits.reshape(len(long), width), shares)
        char_d, word_d = np.round(char_d, 6), np.round(word_d, 6)
        kept = ~t.base_failed & ~(char_d > limits["most_char"]) & ~(word_d > limits["most_word"])
        numbers = [t.n_words, t.word_chars, t.symbols, t.dup_lines, t.repeat_words]
        columns = [batch.column(0), *map(pa.array, numbers), pa.array(t.base_failed), pa.array(kept)]
        columns += [pa.array(x, mask=np.isnan(x)) for x in (char_d, word_d)]
        yield pa.RecordBatch.from_arrays(columns, ["id", *(f.split()[0] for f in FIELDS.split(", "))])


def judge_quality(
    docs: DataFrame, most_char: float = 0.25, most_word: float = 0.5, min_chars: int = 200, min_words: int = 50,
    base_min_words: int = 20, base_most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **reference,
) -> DataFrame:
    """One row per document: its base measures, both distances (null where a guard or a
    missing reference leaves them out) and whether it is kept."""
    references = language_references(docs, min_words=base_min_words, most_repeated=base_most_repeated, text_col=text_col, lang_col=lang_col, **reference)
    limits = {"most_char": most_char, "most_word": most_word, "min_chars": min_chars, "min_words": min_words}
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {FIELDS}"
    return read.mapInArrow(lambda it: _judge(it, references, limits, base_min_words, base_most_repeated), schema).withColumnRenamed("id", id_col)


def oracle_sql() -> str:
    """The same result, with the default parameters."""
    kept = {
        "lower": "a-z", "upper": "A-Z", "digit": "0-9", "white": r"\x20\x09-\x0D", "stop": r".,;:!?\"''()\-", "symbol": "#*$%&|<>", "ascii": r"\x00-\x7F",
        "latin": r"\x{00C0}-\x{07FF}", "mark": r"\x{0080}-\x{00BF}\x{2000}-\x{2FFF}", "script": r"\x{0800}-\x{1FFF}\x{3000}-\x{FFFF}", "far": r"\x{10000}-\x{10FFFF}",
    }
    size = {c: f"length(regexp_replace(t, '[^{kept[c]}]', '', 'g'))" for c in CLASSES}
    size["ascii"] += "".join(f" - {size[c]}" for c in ("lower", "upper", "digit", "white", "stop", "symbol"))
    counts = ", ".join(f"{{'name': '{c}', 'n': {size[c]}}}" for c in CLASSES)
    ends = "[.,;:!?\"''()]+"
    bits = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({1} + {2}) / 2)) ELSE 0 END"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
        win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 7)),
        rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
        cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
        ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
        cl AS (SELECT r, lang, x.name AS name, x.n AS n FROM (SELECT r, lang, unnest([{counts}]) AS x FROM d)),
        tot AS (SELECT r, sum(n) AS total, sum(n) FILTER (name <> 'white') AS word_chars, sum(n) FILTER (name = 'symbol') AS n_symbols FROM cl GROUP BY r),
        b AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines,
                     coalesce(cov.n, 0) AS n_repeat_words, total FROM w JOIN tot USING (r) LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
        known AS (SELECT lang, count(*) AS docs FROM f WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 20 AND 10000 * count(*) >= (SELECT count(*) FROM f WHERE NOT base_failed)),
        cref AS (SELECT cl.lang, name, sum(1000000 * n // total) AS parts FROM cl JOIN f USING (r) WHERE NOT base_failed GROUP BY ALL),
        cq AS (SELECT lang, name, parts / sum(parts) OVER (PARTITION BY lang) AS q FROM cref JOIN known USING (lang)),
        cd AS (SELECT r, round(sqrt(greatest(0, least(1, sum({bits.format("p", "p", "q")} + {bits.format("q", "p", "q")}) / 2))), 6) AS char_distance
               FROM (SELECT cl.r, cl.n / f.total AS p, cq.q FROM cl JOIN f USING (r) JOIN cq ON cq.lang = cl.lang AND cq.name = cl.name WHERE f.word_chars >= 200) GROUP BY r),
        nw AS (SELECT r, lang, k, count(*) AS c FROM (SELECT r, lang, regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{ends}|{ends}$', '', 'g') AS k
               FROM (SELECT r, lang, unnest(ws) AS x FROM w)) GROUP BY ALL),
        wref AS (SELECT nw.lang, k, sum(1000000 * c // n_words) AS parts FROM nw JOIN f USING (r) WHERE NOT base_failed AND k <> '' AND length(k) <= {LONGEST} GROUP BY ALL),
        wq AS (SELECT lang, k, parts / (1e6 * docs) AS q FROM (SELECT * FROM wref QUALIFY row_number() OVER (PARTITION BY lang ORDER BY parts DESC, k) <= 100) JOIN known USING (lang)),
        qs AS (SELECT lang, sum(q) AS s FROM wq GROUP BY lang),
        met AS (SELECT nw.r, sum(c) AS c, sum(q) AS q, sum({bits.format("(c / n_words)", "c / n_words", "q")} + {bits.format("q", "c / n_words", "q")}) AS bits
                FROM nw JOIN f USING (r) JOIN wq ON wq.lang = nw.lang AND wq.k = nw.k GROUP BY nw.r),
        rest AS (SELECT f.r, (n_words - coalesce(c, 0)) / n_words AS p, greatest(0, 1 - s) AS q, coalesce(bits, 0) + s - coalesce(met.q, 0) AS bits
                 FROM f JOIN qs USING (lang) LEFT JOIN met USING (r) WHERE n_words >= 50),
        wd AS (SELECT r, round(sqrt(greatest(0, least(1, (bits + {bits.format("p", "p", "q")} + {bits.format("q", "p", "q")}) / 2))), 6) AS word_distance FROM rest)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(char_distance > 0.25, FALSE) AND NOT coalesce(word_distance > 0.5, FALSE) AS kept, char_distance, word_distance
        FROM f LEFT JOIN cd USING (r) LEFT JOIN wd USING (r)
    """
