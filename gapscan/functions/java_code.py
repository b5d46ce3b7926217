"""What stands in Java text, told from its tokens: calls with their owner and first argument,
annotated or modified fields, types, line comments, and test methods."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .java_calls import _SCAN, LITERAL, _is_name, _is_type

MODIFIERS = frozenset("public protected private static final volatile transient abstract synchronized native default".split())
#: The fields of what ``read_code`` tells
CALL = "name string, owner string, chained boolean, made boolean, arg string, arg_end string, then string"
FACTS = (
    f"calls array<struct<{CALL.replace(' string', ':string').replace(' boolean', ':boolean')}>>", "fields array<struct<type:string,modifiers:array<string>,annotations:array<string>>>",
    "types array<string>", "owners array<string>", "annotations array<string>", "notes array<struct<word:string,text:string>>",
)
_TEXT = pa.list_(pa.string())
_ARROW = [
    pa.list_(pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.bool_()) for f in CALL.split(", ")])),
    pa.list_(pa.struct([("type", pa.string()), ("modifiers", _TEXT), ("annotations", _TEXT)])), _TEXT, _TEXT, _TEXT, pa.list_(pa.struct([("word", pa.string()), ("text", pa.string())])),
]


#: The scan of ``java_calls`` with what is no token in one group, literals in the next and the
#: rest in the last; the space before each is no match of its own
_PARTS = re.compile(r"\s*(?:" + re.sub(r"\(\?P<(name|number|sign)>", "(?:", _SCAN.pattern).replace(r"(?P<skip>\s+|", "(").replace("(?P<text>", "(").replace(r"(?:[^\W\d]", r"((?:[^\W\d]", 1) + r")|\Z)", re.S)
_WORD = re.compile(r"\w*")
_BRACKETS = frozenset("(){}")


class Code:
    """Tokens of one text, with which bracket closes which, and its line comments; ``placed``: and
    where all of them stand."""

    def __init__(self, text: str, placed: bool = False):
        self.text, self.t, self.at, self.notes, self.note_at = text, [], [], [], []
        if placed:
            for m in _PARTS.finditer(text):
                kind = m.lastindex
                if kind == 1 and m[1].startswith("//"):
                    self.notes.append(self._note(m[1]))
                    self.note_at.append(m.start(1))
                elif kind in (2, 3):
                    self.t.append(LITERAL if kind == 2 else m[3])
                    self.at.append(m.span(kind))
        else:
            for skipped, literal, found in _PARTS.findall(text):
                if found or literal:
                    self.t.append(found or LITERAL)
                elif skipped.startswith("//"):
                    self.notes.append(self._note(skipped))
        self._match()

    @staticmethod
    def _note(comment: str) -> dict:
        said = comment[2:].strip().lower()
        return {"word": _WORD.match(said).group(), "text": "".join(said.split())}

    def _match(self) -> None:
        self.t += [""] * 6
        self.close, opened, t = {}, [], self.t
        for i in [k for k, x in enumerate(t) if x in _BRACKETS]:
            x = t[i]
            if x in "({":
                opened.append(i)
            else:
                while opened and t[opened[-1]] != ("(" if x == ")" else "{"):
                    opened.pop()
                if opened:
                    self.close[opened.pop()] = i

    def part(self, start: int, end: int) -> Code:
        """The code of the tokens from ``start`` to before ``end``, and of the comments among and around
        them, as a scan of that text would give it: no token or comment crosses the signs outside."""
        out = object.__new__(Code)
        first, last = self.at[start - 1][1], self.at[end][0] if end < len(self.at) else len(self.text)
        out.text, out.t, out.at, out.note_at = self.text[first:last], self.t[start:end], [], []
        out.notes = self.notes[bisect.bisect_left(self.note_at, first) : bisect.bisect_left(self.note_at, last)]
        out._match()
        return out

    def _dotted(self, i: int) -> tuple[str, int]:
        """The dotted name, or the literal or sign, at ``i``, and what stands behind it."""
        out = self.t[i]
        while _is_name(self.t[i]) and self.t[i + 1] == "." and _is_name(self.t[i + 2]):
            i += 2
            out += "." + self.t[i]
        return out, i + 1

    def calls(self) -> Iterator[dict]:
        t = self.t
        for i in [k - 1 for k, x in enumerate(t) if x == "(" and k]:
            name = t[i]
            if not _is_name(name):
                continue
            j, owner = i, []
            while j >= 2 and t[j - 1] == "." and _is_name(t[j - 2]):
                j -= 2
                owner.insert(0, t[j])
            arg, end = self._dotted(i + 2)
            after = self.close.get(i + 1, len(t) - 5) + 1
            yield {
                "name": name, "owner": ".".join(owner), "chained": j > 0 and t[j - 1] == ".", "made": j > 0 and t[j - 1] == "new", "arg": arg, "arg_end": t[end],
                "then": t[after + 1] if t[after] == "." and t[after + 2] == "(" else "",
            }

    def _annotation(self, i: int) -> tuple[str, int]:
        """The annotation at the sign at ``i``, and what stands behind it."""
        name, end = self._dotted(i + 1)
        return name.rsplit(".", 1)[-1], self.close.get(end, end) + 1 if self.t[end] == "(" else end

    def fields(self) -> Iterator[dict]:
        """Declared variables that have an annotation or a modifier."""
        t, i = self.t, 0
        while i < len(t) - 6:
            annotations, modifiers, start = [], [], i
            while t[i] == "@" or t[i] in MODIFIERS:
                if t[i] == "@":
                    name, i = self._annotation(i)
                    annotations.append(name)
                else:
                    modifiers.append(t[i])
                    i += 1
            if i == start:
                i += 1
                continue
            kind, end = self._dotted(i)
            if _is_name(t[i]):
                depth = 0
                while end < len(t) - 6 and (t[end] == "<" or depth or (t[end] == "[" and t[end + 1] == "]") or (t[end] == "]" and t[end - 1] == "[")):
                    depth += (t[end] == "<") - (t[end] == ">")
                    end += 1
                if _is_name(t[end]) and t[end + 1] in ("=", ";"):
                    yield {"type": kind.rsplit(".", 1)[-1], "modifiers": modifiers, "annotations": annotations}

    def types(self, before_dot: bool = False) -> list[str]:
        """Capitalised names that no dot precedes, or those that one follows."""
        return sorted({x for i, x in enumerate(self.t) if _is_type(x) and (not i or self.t[i - 1] != ".") and (not before_dot or (self.t[i + 1] == "." and _is_name(self.t[i + 2])))})

    def annotations(self) -> list[str]:
        return sorted({self._annotation(i)[0] for i, x in enumerate(self.t) if x == "@" and _is_name(self.t[i + 1])})

    def tests(self) -> Iterator[tuple[str, Code]]:
        """Names and bodies of methods with ``@Test``, of code that is ``placed``."""
        t = self.t
        for i in range(len(t) - 6):
            if t[i] != "@" or self._annotation(i)[0] != "Test":
                continue
            j = i
            while t[j] == "@":
                j = self._annotation(j)[1]
            while t[j] and t[j] not in (";", "{", "}") and not (_is_name(t[j]) and t[j + 1] == "("):
                j = self._annotation(j)[1] if t[j] == "@" else j + 1
            if t[j + 1] != "(":
                continue
            name, j = t[j], self.close.get(j + 1, len(t) - 6)
            while t[j] and t[j] not in (";", "{"):
                j += 1
            if t[j] == "{":
                yield name, self.part(j + 1, self.close.get(j, len(t) - 6))


def without_imports(text: str | None) -> str:
    """What an import names is no use of it."""
    return "\n".join(x for x in (text or "").split("\n") if not x.lstrip().startswith("import "))


#: Rows, and bytes of text, whose facts a worker holds at once
SLICE, SLICE_BYTES = 512, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches in short pieces, also by the bytes of column ``text``: what a text tells is many
    times the text."""
    for batch in batches:
        sizes = [0] * batch.num_rows if text is None else pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == SLICE or held + size > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


_TELL = {
    "calls": lambda c: list(c.calls()), "fields": lambda c: list(c.fields()), "types": lambda c: c.types(), "owners": lambda c: c.types(True), "annotations": lambda c: c.annotations(), "notes": lambda c: c.notes,
}
_KINDS = dict(zip(_TELL, zip(FACTS, _ARROW, strict=True), strict=True))


def _dealt(files: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks: a table that packs well is few splits, whatever the work on its texts."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _told(codes: Iterable[Code], facts: tuple[str, ...]) -> list[pa.Array]:
    """The facts of each code, a column each; the tokens of one are held at a time."""
    told = [[] for _ in facts]
    for code in codes:
        for column, fact in zip(told, facts, strict=True):
            column.append(_TELL[fact](code))
    return [pa.array(column, _KINDS[f][1]) for column, f in zip(told, facts, strict=True)]


def read_code(files: DataFrame, kept: list[str], text: str = "body", facts: tuple[str, ...] = tuple(_TELL)) -> DataFrame:
    """``kept`` columns with the ``facts`` of each text (of ``FACTS``; only those are worked
    out); a null text has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept)):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *_told((Code(without_imports(x.as_py())) for x in batch.column(len(kept))), facts)], [*kept, *facts])

    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(_KINDS[f][0] for f in facts)])
    return _dealt(files.select(*kept, F.col(text).cast("string")), *kept).mapInArrow(read, schema)


def read_tests(files: DataFrame, path: str = "file", text: str = "body", facts: tuple[str, ...] = ()) -> DataFrame:
    """One row for each @Test method: file, pos, name, body, and the ``facts`` of the body as
    ``read_code`` tells them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            owner, rows = [], []

            def bodies() -> Iterator[Code]:
                for k, x in enumerate(batch.column(1)):
                    for pos, (name, body) in enumerate(Code(x.as_py() or "", placed=True).tests()):
                        owner.append(k)
                        rows.append((pos, name, body.text))
                        yield Code(without_imports(body.text)) if "import " in body.text else body

            told = _told(bodies(), facts)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*columns, *told], ["file", "pos", "name", "body", *facts])

    slim = files.select(F.col(path).cast("string").alias("file"), F.col(text).cast("string").alias("body"))
    return _dealt(slim, "file").mapInArrow(read, ", ".join(["file string, pos int, name string, body string", *(_KINDS[f][0] for f in facts)]))
