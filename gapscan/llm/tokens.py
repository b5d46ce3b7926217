"""Exact, cached tokenisation for a tokenizer whose pre-tokeniser never crosses
white space and splits letters from punctuation: each chunk is encoded once and
remembered as the little-endian bytes of its ids, so that a text costs about one
dictionary look-up a word."""

from __future__ import annotations

import re

import numpy as np

#: str.split() also splits at these four, which the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: ASCII punctuation that may be cut off the end of a chunk (the apostrophe may not).
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this are lower-cased to one letter here and in the tokenizer, but for
#: the capital I with a dot, which becomes a letter and a mark.
_LATIN, _DOTTED = "\u0250", "\u0130"


def _plain(word: str) -> bool:
    """Latin letters only: the tokenizer takes the word as one run of letters."""
    return word.isalpha() and (word.isascii() or (max(word) < _LATIN and _DOTTED not in word))


class ChunkTokenizer:
    """``id_bytes(text)`` holds the ids of ``Tokenizer.encode`` without special
    tokens added.  Memory is bounded: chunks live in a young and an old cache of
    at most ``max_chunks`` each; a full young one replaces the old one."""

    def __init__(self, path: str, max_chunks: int = 600_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.model.get_added_tokens_decoder().values() if t.special)
        self.mark = self.special[0] if self.special else None
        self.mark_id = self.model.token_to_id(self.mark) if self.mark else None
        size = self.model.get_vocab_size()
        self.is_end = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.max_chunks = max_chunks

    def direct(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes] | None:
        """Words of letters only, in one call: each ends with an end-of-word id."""
        ids = np.asarray(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            return None
        raw, at, out = ids.tobytes(), 0, []
        for end in (ends * 4).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def _encode_any(self, chunks: list[str]) -> list[bytes]:
        if self.mark is None:
            return [self.direct(c) for c in chunks]
        ids = np.asarray(self.model.encode_batch_fast([self.mark.join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        raw, at, out = ids.tobytes(), 0, []
        for end in [*(np.flatnonzero(ids == self.mark_id) * 4).tolist(), len(raw)]:
            out.append(raw[at:end])
            at = end + 4
        return out

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        words = [c for c in chunks if _plain(c)]
        rest = [c for c in chunks if not _plain(c)]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            found.update(zip(part, self._encode_words(part) or self._encode_any(part), strict=True))
        for i in range(0, len(rest), 2000):
            part = rest[i : i + 2000]
            found.update(zip(part, self._encode_any(part), strict=True))
        return found

    def _known(self, chunk: str) -> bytes | None:
        found = self.young.get(chunk)
        if found is None and (found := self.old.get(chunk)) is not None:
            self.young[chunk] = found
        return found

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the young cache lacks."""
        out: dict[str, bytes] = {}
        split: dict[str, tuple[str, str]] = {}
        need: set[str] = set()
        for chunk in missing:
            if (known := self._known(chunk)) is not None:
                out[chunk] = known
                continue
            core = chunk.rstrip(_TAIL)
            if core and core != chunk and _plain(core[-1]):
                split[chunk] = parts = (core, chunk[len(core) :])
                need.update(x for x in parts if self._known(x) is None)
            else:
                need.add(chunk)
        if need:
            self.young.update(self._encode(list(need)))
        for chunk in missing:
            if chunk not in out:
                got = self.young[split[chunk][0]] + self.young[split[chunk][1]] if chunk in split else self.young[chunk]
                out[chunk] = self.young[chunk] = got
        if len(self.young) > self.max_chunks:
            self.old, self.young = self.young, {}
        return out

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self.direct(text)
        try:
            text.encode("latin-1")  # there str.lower() and the tokenizer's agree letter by letter
            text = text.lower()
        except UnicodeEncodeError:
            pass
        words = text.split()
        parts = list(map(self.young.get, words))
        if None in parts:
            learnt = self._learn({w for w, p in zip(words, parts, strict=True) if p is None})
            parts = [learnt[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]
