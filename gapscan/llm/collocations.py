"""Phrase collocations by counting quotient filters.

1. Words of every whole text are counted for each language.  A word's id is a hash of
   language and word, of as many bits as the vocabulary needs; that no frequent word
   shares its id with any other is checked, with more bits or another seed if one does.
2. Level by level, phrases of 2 to ``longest`` words are counted: only those whose two
   parts of one word less are frequent, by a bit table of bounded size whose false hits
   only cost work.  A task packs the ids of its phrases into counting quotient filters and
   sends each block of slots as one compact piece; the sorted pieces of a block are
   merged, and what reaches ``least`` is written.  The permutation spreads keys evenly over
   blocks, so a frequent language or phrase makes no large block.
3. Each candidate meets the counts of its parts for every cut; the lowest score stands.
   A candidate that some longer one contains as often goes.  It is enough to look one
   word further: a count between two equal counts equals them.

Lower-casing takes A-Z; pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs.
Scores are whole numbers in decimals of 38 digits, so right for ``1000 a n < 10**38``; beyond
that Spark raises.

Defined cases: a null or empty text has no words; a null language is ``und``; ids are not
read, so null and repeated ones count like any other; equal scores and counts are ranked by the
phrase's bytes; very long texts are read whole, in segments; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quotient import QuotientFilter
from .shingles import mix

_U = np.uint64
_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_INNER = ~(_ENDS | np.isin(np.arange(256), list(b" \t")))
_SEGMENT = 1 << 20
_P = _U(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch of texts in order: ``hash``, ``piece`` (no phrase leaves one),
    ``text`` (its place in the batch), and where their bytes lie."""

    def __init__(self, texts: list[bytes | None], seed: int = 0):
        self.texts, self.seed = texts, seed
        self.raw = b"\n".join([(t or b"").lower() for t in texts])
        codes = np.frombuffer(self.raw, np.uint8)
        base = _P ^ _U(2 * int.from_bytes(hashlib.blake2b(b"%d" % seed, digest_size=7).digest(), "big")) if seed else _P
        up = np.cumprod(np.append(_U(1), np.full(2 * _SEGMENT, base)))
        down = np.cumprod(np.append(_U(1), np.full(2 * _SEGMENT, _U(pow(int(base), -1, 1 << 64)))))
        hashes, pieces, starts, ends, at, ended = [], [], [], [], 0, 0
        while at < len(codes):
            end = min(len(codes), at + _SEGMENT)
            while end < len(codes) and _INNER[codes[end]] and end < at + 2 * _SEGMENT:
                end += 1
            b = codes[at:end]
            step = np.diff(_INNER[b].astype(np.int8), prepend=0, append=0)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + _U(1)) * up[: len(b)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
            breaks = np.cumsum(_ENDS[b])
            pieces.append(ended + (breaks[s] if len(s) else s))
            starts.append(at + s)
            ends.append(at + e)
            ended += int(breaks[-1])
            at = end
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.piece, self.start, self.end = join(hashes, np.uint64), join(pieces, np.int64), join(starts, np.int64), join(ends, np.int64)
        self._join_cut_words(codes)
        for i in np.flatnonzero(self.end - self.start > 64):  # sums of powers are safe for short words only
            word = self.raw[self.start[i] : self.end[i]]
            self.hash[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=b"%d" % seed).digest(), "big")
        bounds = np.cumsum([len(t or b"") + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, side="right")

    def _join_cut_words(self, codes: np.ndarray) -> None:
        """A word longer than a segment was met in parts: they are one word."""
        cut = np.flatnonzero(self.start[1:] == self.end[:-1]) + 1
        if len(cut):
            first = np.setdiff1d(np.arange(len(self.start)), cut)
            last = np.append(first[1:], len(self.start)) - 1
            self.end = self.end[last]
            self.hash, self.piece, self.start = self.hash[first], self.piece[first], self.start[first]

    def unlike(self, first: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which words are not the word that stands first in their group: by a hash of
        another seed, so that what one hash takes for the same the other tells apart."""
        other = Words(self.texts, self.seed + 1_000_003).hash
        return np.flatnonzero((other != other[first][group]) | (self.end - self.start != (self.end - self.start)[first][group]))

    def ids(self, langs: list[str], seed: int, bits: int = 64) -> np.ndarray:
        of = {x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8, salt=b"l%d" % seed).digest(), "big") for x in set(langs)}
        lang = np.fromiter((of[x] for x in langs), np.uint64, len(langs))
        return mix(self.hash ^ lang[self.text]) >> _U(64 - bits)


def _read(batch: pa.RecordBatch) -> tuple[list[bytes | None], list[str]]:
    return batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count_words(batches, seed: int, most: int = 300_000):
    """``(lang, word, id, n)``, summed over as many batches as ``most`` distinct words allow."""
    held: dict[int, list] = {}

    def out():
        rows = held.values()
        return pa.RecordBatch.from_pydict({
            "lang": [r[0] for r in rows], "word": [r[1].decode("utf-8", "replace") for r in rows],
            "id": pa.array(_signed(np.fromiter(held, np.uint64, len(held)))), "n": pa.array([r[2] for r in rows], pa.int64()),
        })

    def row(w: Words, langs: list[str], i: int, key: np.uint64, n: int):
        """Two words of one hash: both go on, so that the check finds them."""
        word = w.raw[w.start[i] : w.end[i]].decode("utf-8", "replace")
        return pa.RecordBatch.from_pydict({"lang": [langs[w.text[i]]], "word": [word], "id": pa.array(_signed(np.array([key], np.uint64))), "n": [n]})

    for batch in batches:
        texts, langs = _read(batch)
        w = Words(texts, seed)
        ids, first, group, counts = np.unique(w.ids(langs, seed), return_index=True, return_inverse=True, return_counts=True)
        odd = w.unlike(first, group)
        counts -= np.bincount(group[odd], minlength=len(counts))
        for i in odd.tolist():
            yield row(w, langs, i, ids[group[i]], 1)
        for key, i, n in zip(ids.tolist(), first.tolist(), counts.tolist(), strict=True):
            row = held.get(key)
            word = w.raw[w.start[i] : w.end[i]]
            if row is None:
                held[key] = [langs[w.text[i]], word, n]
            elif row[1] == word:
                row[2] += n
            else:
                yield row(w, langs, i, np.uint64(key), n)
        if len(held) > most:
            yield out()
            held.clear()
    if held:
        yield out()


def _gram_hash(ids: np.ndarray) -> np.ndarray:
    h = np.full(len(ids), ids.shape[1], np.uint64)
    for j in range(ids.shape[1]):
        h = mix(h * _P + ids[:, j])
    return h


def _grams(ids: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) >= width else np.zeros((0, width), np.uint64)


def _count_phrases(batches, width: int, table: np.ndarray, seed: int, bits: int, block_bits: int, most: int = 1 << 20):
    """``(block, filter)``: filters of phrases of ``width`` words, their parts frequent."""
    held: list[QuotientFilter] = []

    def out():
        whole = held[0].merge(*held[1:])
        held.clear()
        found = list(whole.blocks(block_bits))
        for i in range(0, len(found), 64):
            yield pa.RecordBatch.from_pydict({"block": [b for b, _ in found[i : i + 64]], "filter": pa.array([f.dump() for _, f in found[i : i + 64]], pa.binary())})

    for batch in batches:
        texts, langs = _read(batch)
        w = Words(texts, seed)
        ids = w.ids(langs, seed, bits)
        parts = _grams(ids, width - 1)
        ok = common.may_hold(table, parts[:, 0] if width == 2 else _gram_hash(parts))
        n = max(0, len(ids) - width + 1)
        ok = ok[:n] & ok[1 : n + 1] & (w.piece[:n] == w.piece[len(ids) - n :])
        for step in range(0, n, most):
            at = step + np.flatnonzero(ok[step : step + most])
            if len(at):
                held.append(QuotientFilter.of(_grams(ids, width)[at], bits))
        if sum(len(f.counts) for f in held) > most:
            yield from out()
    if held:
        yield from out()


def _merge_block(pdf, least: int):
    """The filters of one block become one, a few at a time; frequent phrases leave it."""
    whole, waiting = None, []
    for i, raw in enumerate(pdf["filter"]):
        waiting.append(QuotientFilter.load(raw))
        if i + 1 == len(pdf) or sum(len(f.counts) for f in waiting) > 1 << 19:
            whole, waiting = (whole or waiting[0]).merge(*waiting[0 if whole else 1 :]), []
    best = whole.at_least(least)
    keys = best.keys()
    raw, size = keys.astype(">u8").tobytes(), 8 * keys.shape[1]
    import pandas as pd

    return pd.DataFrame({"key": [raw[i * size : (i + 1) * size] for i in range(len(keys))], "a": best.counts, "hash": _signed(_gram_hash(keys))})


def count_words(docs: DataFrame, least: int, seeds: int = 8) -> tuple[DataFrame, int, int]:
    """``(lang, word, n, id)`` of all words, staged, with the seed and the number of high bits of
    ids by which no word of ``least`` occurrences is like another."""
    for seed in range(seeds):
        counted = docs.mapInArrow(lambda it, seed=seed: _count_words(it, seed), "lang string, word string, id long, n long")
        words = common.staged(counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("id").alias("id")), "words")
        total, frequent = words.agg(F.count("*"), F.count_if(F.col("n") >= least)).first()
        bits = min(64, math.ceil(math.log2(max(total, 2)) + math.log2(max(frequent, 2))) + 8)
        while bits <= 64:
            short = F.shiftrightunsigned("id", 64 - bits)
            shared = words.groupBy(short.alias("short")).agg(F.count("*").alias("words"), F.max("n").alias("n")).filter((F.col("words") > 1) & (F.col("n") >= least))
            if not shared.head(1):
                return words, seed, bits
            bits = bits + 8 if bits == 64 else min(64, bits + 8)
        common.discard(words)
    raise ValueError(f"words share their ids under {seeds} seeds")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, block_words: int = 1 << 20, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    spark = docs.sparkSession
    common.ship(spark)
    read = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words, seed, bits = count_words(read, least)
    totals = common.staged(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    few = totals.agg(F.count("*"), F.sum("total")).first()
    block_bits = max(0, math.ceil(math.log2(max((few[1] or 0) / block_words, 2 * common.shuffle_width(spark)))))
    to_totals = totals.hint("broadcast" if few[0] <= 100_000 else "merge")
    frequent = words.filter(F.col("n") >= least).withColumn("id", F.shiftrightunsigned("id", 64 - bits))
    levels, table = [], common.bit_table(frequent, "id")
    for width in range(2, longest + 1):
        pieces = read.mapInArrow(
            lambda it, width=width, table=table: _count_phrases(it, width, table, seed, bits, min(block_bits, bits)), "block long, filter binary"
        )
        found = common.staged(pieces.groupBy("block").applyInPandas(lambda pdf: _merge_block(pdf, least), "key binary, a long, hash long"), f"phrases{width}")
        levels.append(found)
        if not found.head(1):
            break
        table = common.bit_table(found, "hash")
    singles = frequent.join(to_totals, "lang").select(
        F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.col("n").alias("a"), "lang", F.col("total").alias("n"), "word"
    )
    singles = common.staged(singles, "singles")
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    phrases = phrases.drop("hash").withColumn("m", F.expr("cast(octet_length(key) div 8 as int)"))
    ranked = common.staged(_ranked(phrases, singles, longest, top), "ranked")
    out = common.staged(_spelled(ranked, singles, top), "collocations")
    common.discard(words, totals, singles, ranked, *levels)
    return out


def _ranked(phrases: DataFrame, singles: DataFrame, longest: int, top: int) -> DataFrame:
    """Phrases at their lowest cut, no longer one as frequent, those of the first ``top`` ranks."""
    parts = singles.select("key", "a", "lang", "n").unionByName(phrases.filter(F.col("m") < longest).select("key", "a"), allowMissingColumns=True)
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, m - 1)")))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 8 * k)"), "right": F.expr("substring(key, 8 * k + 1, 8 * (m - k))")})
    lefts = parts.select(F.col("key").alias("left"), F.col("a").alias("l"), "lang", "n").hint("merge")
    rights = parts.select(F.col("key").alias("right"), F.col("a").alias("r")).hint("merge")
    met = cuts.join(lefts, "left").join(rights, "right")
    per = met.groupBy("key", "m", "a").agg(F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    big = "decimal(38,0)"
    scored = F.expr(
        f"array_min(transform(cuts, c -> struct(cast((cast(1000 as {big}) * a * n) div (cast(c.l as {big}) * c.r) as bigint) as score, c.k as k, c.l as l, c.r as r)))"
    )
    ends = F.explode(F.array(F.expr("substring(key, 1, 8 * (m - 1))"), F.expr("substring(key, 9, 8 * (m - 1))")))
    longer = phrases.filter("m > 2").select(ends.alias("key"), F.col("a").alias("up")).groupBy("key").agg(F.max("up").alias("up"))
    own = per.withColumn("best", scored).join(longer.hint("merge"), "key", "left").filter("up IS NULL OR 100 * up < 100 * a")
    own = own.select("key", "lang", "a", "n", "best.score", "best.l", "best.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    return own.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= top)


def _spelled(ranked: DataFrame, singles: DataFrame, top: int) -> DataFrame:
    """Ids become words; ranks are settled by the phrase."""
    spread = ranked.withColumn("at", F.explode(F.expr("sequence(0, cast(octet_length(key) div 8 as int) - 1)")))
    spread = spread.withColumn("id", F.expr("substring(key, 8 * at + 1, 8)"))
    named = spread.join(singles.select(F.col("key").alias("id"), "word").hint("merge"), "id")
    whole = named.groupBy("key", "lang", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    whole = whole.withColumn("phrase", F.expr("array_join(transform(words, w -> w.word), ' ')"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    final = whole.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return final.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), starts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
        ), grams AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
            FROM starts, (SELECT unnest(range(1, {longest} + 1)) AS m) WHERE i + m - 1 <= len(w)
        ), f AS (
            SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}
        ), totals AS (
            SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
        ), cuts AS (
            SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
            FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
        ), scored AS (
            SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
                CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase
            FROM f WHERE m > 2
        ), own AS (
            SELECT s.* FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM longer q WHERE q.lang = s.lang AND q.phrase = s.phrase AND 100 * q.a >= 100 * s.a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM own QUALIFY rank <= {top}
    """
