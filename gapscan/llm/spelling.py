"""Spelling variants: words one edit apart, found over sorted lists.

1. Runs of letters of every whole text are counted; some lose a letter by a rule on
   document and run (``forget``), as a typist would.
2. Words meet in groups.  One edit leaves the part before it and the part behind it alone,
   so of two near words, the shorter of length L, either the first half (L // 2) or the
   second is shared: every word goes into the groups of both halves, as of length L and as
   of length L - 1.  Groups beyond ``most_words`` words or ``most_cells`` letters are cut
   again, the free half in two halves more, until they fit or one position is free; a bit
   table of bounded size tells which, and a group it names by mistake is only cut finer.
3. In a group the words stand sorted.  The longest common prefixes of neighbours mark
   ranges that share a prefix; for every word a band of three cells of the edit matrix
   (one edit) goes down these ranges, a row for each shared prefix and not for each word,
   and a range is left as soon as its prefix is beyond one edit.  Ranges of one depth are
   worked out together for all words of a batch of groups.
4. A pair met in several groups counts in the first of them only.  Forms are followed by
   doubling: counts grow tenfold a step, so twenty steps are the most there can be.

Defined cases: a null text has no runs, an empty one neither; a null id is written as
nothing before the colon; rows repeated count again; forms of equal count go to the smaller
in code-point order; words of any length are compared whole; a word without near words is
its own root; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forget(prefix: int, run: str, every: int = 31) -> str:
    """``run``, without one letter where ``every`` divides its crc32 behind ``prefix``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_runs(batches, shortest: int, most: int = 200_000):
    """``(word, n)``, summed over as many texts as ``most`` distinct words allow."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            prefix = zlib.crc32(b"%s:" % (b"" if id_ is None else str(id_).encode()))
            for run, n in Counter(runs.findall((text or b"").lower().decode("utf-8", "replace"))).items():
                word = forget(prefix, run)
                if len(word) >= shortest:
                    held[word] += n
            if len(held) > most:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words of at least ``shortest`` letters and ``least`` occurrences."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = read.mapInArrow(lambda it: _count_runs(it, shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """The group of each row ``(L, a, b, word, n)``: what lies outside [a, b) of L letters."""
    return rows.withColumn("key", F.expr("xxhash64(L, a, b, substring(word, 1, a), right(word, L - b))"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each group's rows into those of its two halves; a single position stays."""
    middle = "cast((a + b) div 2 as int)"
    parts = F.expr(f"CASE WHEN b - a > 1 THEN array(struct(a AS a, {middle} AS b), struct({middle} AS a, b AS b)) ELSE array(struct(a AS a, b AS b)) END")
    return _keyed(rows.withColumn("part", F.explode(parts)).select("L", "part.a", "part.b", "word", "n"))


def grouped(words: DataFrame, most_words: int = 4096, most_cells: int = 1 << 22) -> DataFrame:
    """``(L, a, b, word, n, key)``, every group within its bounds."""
    least = words.agg(F.min(F.char_length("word"))).first()[0] or 1
    whole = words.withColumn("L", F.explode(F.expr("array(char_length(word), char_length(word) - 1)"))).filter(F.col("L") >= least)
    whole = whole.selectExpr("L", "0 AS a", "L AS b", "word", "n")
    open_, done = _halves(whole), None
    while True:
        large = open_.groupBy("key", "L").agg(F.count("*").alias("size"), F.max(F.col("b") - F.col("a")).alias("free"))
        large = large.filter(((F.col("size") > most_words) | (F.col("size") * F.col("L") > most_cells)) & (F.col("free") > 1)).select("key")
        large = common.staged(large, "large")
        if not large.head(1):
            return open_ if done is None else done.unionByName(open_)
        among = common.bit_filter(large, "key")
        found = among(F.col("key")) & (F.col("b") - F.col("a") > 1)
        closed = open_.filter(~found)
        done = closed if done is None else done.unionByName(closed)
        open_ = _halves(open_.filter(found).select("L", "a", "b", "word", "n"))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word in a row, then zeros; and the lengths."""
    flat = np.array(words, dtype=np.str_)
    width = max(1, flat.dtype.itemsize // 4)
    return np.pad(flat.view(np.uint32).reshape(len(words), width), ((0, 0), (0, 3))), np.char.str_len(flat).astype(np.int64)


def near_pairs(group: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)``, both ways, of words of one group at one edit; ``words`` sorted in each group.

    A range of the list is all words of a group that share their first ``d`` letters; it is
    named by its first word.  State: a word, a range, and three cells, the edits from the
    range's prefix to the word's first d - 1, d, d + 1 letters, 2 standing for more."""
    letters, size = _letters(words)
    n = len(words)
    differ = letters[1:] != letters[:-1]
    lcp = np.zeros(n + 1, np.int64)  # with the word before; none at the start of a group
    lcp[1:n] = np.where(group[1:] == group[:-1], np.where(differ.any(1), differ.argmax(1), letters.shape[1]), -1)
    lcp[0] = lcp[n] = -1
    heads = np.flatnonzero(lcp[:n] < 0)
    word = np.arange(n)
    at = np.repeat(heads, np.diff(np.append(heads, n)))  # the range of depth 0: the whole group
    cells = np.tile(np.array([2, 0, 1], np.int8), (n, 1))
    found_i, found_j, depth = [], [], 0
    while len(word):
        ends = size[at] == depth  # the first word of a range may be its prefix itself
        column = size[word] - depth + 1
        hit = ends & (column >= 0) & (column <= 2)
        hit[hit] = cells[hit, column[hit]] == 1
        found_i.append(word[hit])
        found_j.append(at[hit])
        starts = np.flatnonzero(lcp[:n] <= depth)  # ranges of depth + 1
        live = size[starts] > depth
        starts_live = starts[live]
        stop = np.append(np.flatnonzero(lcp[: n + 1] < depth), n)
        until = stop[np.searchsorted(stop, at, side="right")]
        low, high = np.searchsorted(starts_live, at), np.searchsorted(starts_live, until)
        times = high - low
        back = np.repeat(np.arange(len(word)), times)
        inner = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times)
        at = starts_live[low[back] + inner]
        word, old = word[back], cells[back]
        letter = letters[at, depth]
        new = np.full((len(at), 3), 2, np.int8)
        for k in range(3):
            j = depth + k - 1  # the letter of ``word`` that would stand against ``letter``
            valid = (j >= 0) & (j < size[word])
            same = old[:, k] + (letters[word, max(j, 0)] != letter)
            best = np.where(valid, same, 2)
            if k < 2:
                best = np.minimum(best, np.where(depth + k <= size[word], old[:, k + 1] + 1, 2))
            if k:
                best = np.minimum(best, np.where(valid, new[:, k - 1] + 1, 2))
            new[:, k] = np.minimum(best, 2)
        alive = new.min(1) < 2
        word, at, cells = word[alive], at[alive], new[alive]
        depth += 1
    return np.concatenate(found_i), np.concatenate(found_j)


def _scan(batches, most_cells: int):
    """Sorted rows ``(L, key, a, word, n)`` in, ``(word, n_near, other, other_n)`` out: near
    words in this group that no earlier group shows, and the commonest of them."""

    def work(table: pa.Table):
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        L, key, a = (table.column(c).to_numpy() for c in ("L", "key", "a"))
        fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (L[1:] != L[:-1])))
        group = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(words))))
        i, j = near_pairs(group, words)
        keep = [  # the pair is of this length, and no group that frees letters further left shows it
            min(len(words[x]), len(words[y])) == L[x] and (a[x] == 0 or words[x][a[x] - L[x] :] != words[y][a[x] - L[x] :])
            for x, y in zip(i.tolist(), j.tolist(), strict=True)
        ]
        i, j = i[keep], j[keep]
        if not len(i):
            return
        order = np.lexsort((j, -n[j], i))  # of equal counts the smaller word, as sorted
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        yield pa.RecordBatch.from_pydict({
            "word": [words[x] for x in i[first]], "n_near": pa.array(np.diff(np.append(first, len(i)))),
            "other": [words[x] for x in j[first]], "other_n": pa.array(n[j[first]]),
        })

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = sum(len(b) for b in held)
        if rows * (max(x.column("L")[-1].as_py() for x in held) + 1) < most_cells:
            continue
        table = pa.Table.from_batches(held)
        key, L = table.column("key").to_numpy(), table.column("L").to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]) | (L[1:] != L[:-1]))
        if len(cut):  # the last group may go on
            yield from work(table.slice(0, cut[-1] + 1))
            held = table.slice(cut[-1] + 1).to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def near_words(words: DataFrame, most_words: int = 4096, most_cells: int = 1 << 22) -> DataFrame:
    """``(word, n, n_near, other, other_n)``: how many of ``words (word, n)`` are one edit away,
    and the commonest of them."""
    rows = grouped(words, most_words, most_cells).select("L", "key", "a", "word", "n")
    rows = rows.repartition(common.shuffle_width(words.sparkSession), "key").sortWithinPartitions("L", "key", "word")
    cells = min(most_cells, 1 << 18)
    met = rows.mapInArrow(lambda it: _scan(it, cells), "word string, n_near long, other string, other_n long")
    both = words.select("word", "n").unionByName(met, allowMissingColumns=True)
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("minus"), "other"))).alias("best")
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best)
    return out.select("word", "n", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))


def spelling_variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text", most_words: int = 4096,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a word's form is its commonest near word, if
    that is ``times`` as common; its root is where forms lead."""
    words = common.staged(vocabulary(docs, shortest, least, id_col, text_col), "vocabulary")
    near = near_words(words, most_words)
    formed = F.col("other_n") >= times * F.col("n")
    form = near.select("word", F.when(formed, F.col("other")).alias("form"), "n", "n_near", F.when(formed, F.col("other_n")).alias("form_n"))
    form = common.staged(form, "forms")
    common.discard(words)
    links = form.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        moved = F.col("further").isNotNull().alias("moved")
        stepped = common.staged(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), moved), "roots")
        links = stepped.drop("moved")
        if not stepped.filter("moved").head(1):
            break
    return form.join(links.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
