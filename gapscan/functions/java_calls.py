"""Tokens of Java text, and the calls in it with the types their receivers were declared with.

One scan from left to right gives tokens; comments are dropped, literals are one token.
A walk over the tokens keeps a stack of scopes: a brace opens one, what a parenthesis
declares (parameters, loop and pattern variables) belongs to the block that follows.
Fields are known in their whole class, locals from their declaration to the end of their block."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCAN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"""(?:\\.|(?!""").)*(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|\.\.\.|.)",
    re.S,
)
PRIMITIVE = frozenset("boolean byte char short int long float double".split())
TYPE_WORDS = frozenset("class interface enum record".split())
#: Words before a name that cannot be its type
NO_TYPE = frozenset("return throw new else case instanceof assert package import extends implements throws goto yield".split())
LITERAL = "\0"
#: The same with two groups, literals and the rest
_PLAIN = re.compile(re.sub(r"\(\?P<(name|number|sign|skip)>", "(?:", _SCAN.pattern).replace("(?:[^\\W\\d]", "((?:[^\\W\\d]", 1) + ")", re.S)


def tokens(code: str) -> list[str]:
    """Names, signs and numbers; each literal as ``LITERAL``."""
    return [found or LITERAL for text, found in _PLAIN.findall(code) if found or text]


@lru_cache(1 << 16)
def _is_type(word: str) -> bool:
    return word[:1].isupper()


@lru_cache(1 << 16)
def _is_name(word: str) -> bool:
    return word[:1].isalpha() or word[:1] in ("_", "$")


class Walk:
    """Scopes and uses of one file."""

    def __init__(self, code: str):
        self.t = tokens(code) + [""] * 4
        self.package, self.imports = "", []
        self.fields: dict[int, dict[str, str | None]] = {}
        list(self._walk(first=True))
        self.uses = list(self._walk(first=False))

    def _dotted(self, i: int) -> tuple[list[str], int]:
        """The dotted name that starts at ``i`` and where it ends."""
        parts = [self.t[i]]
        while self.t[i + 1] == "." and _is_name(self.t[i + 2]):
            parts.append(self.t[i + 2])
            i += 2
        return parts, i + 1

    def _generics(self, i: int) -> int:
        """Behind the type arguments that start at ``i``, or ``i`` if there are none."""
        if self.t[i] != "<":
            return i
        depth, j = 0, i
        while j < len(self.t) - 4:
            if self.t[j] in "<>" and self.t[j]:
                depth += 1 if self.t[j] == "<" else -1
                if not depth:
                    return j + 1
            elif not (_is_name(self.t[j]) or self.t[j] in ".,?&[]@"):
                return i
            j += 1
        return i

    def _declared(self, i: int) -> tuple[str, str | None] | None:
        """``(variable, type)`` if a declaration starts at ``i``; arrays and primitives have no type."""
        before, word = self.t[i - 1] if i else "", self.t[i]
        if before in (".", "@", "::") or (before in NO_TYPE and before != "instanceof") or not _is_name(word):
            return None
        if word == "var":
            parts, j = ["var"], i + 1
        else:
            parts, j = self._dotted(i)
            if not (_is_type(parts[-1]) or (len(parts) == 1 and word in PRIMITIVE)):
                return None
            j = self._generics(j)
        array = False
        while self.t[j] == "[" and self.t[j + 1] == "]" or self.t[j] == "...":
            array, j = True, j + (1 if self.t[j] == "..." else 2)
        if not _is_name(self.t[j]) or self.t[j + 1] not in ("=", ";", ",", ")", ":", "&", "|", "["):
            return None
        if parts == ["var"]:
            if self.t[j + 1 : j + 3] != ["=", "new"]:
                return self.t[j], None
            made, end = self._dotted(j + 3)
            return self.t[j], ".".join(made) if self.t[self._generics(end)] == "(" else None
        return self.t[j], None if array or self.t[j + 1] == "[" or parts[-1] in PRIMITIVE else ".".join(parts)

    def _walk(self, first: bool) -> Iterator[tuple[int, str, str, str | None, str | None]]:
        """``(pos, kind, type, method, receiver)``; the first walk only gathers fields."""
        t, scopes, carried, opened, number = self.t, [{}], {}, [], 0
        is_body, bodies, i = False, [True], 0
        while i < len(t) - 4:
            word = t[i]
            if word in ("package", "import") and len(scopes) == 1 and not opened:
                j = i + 1 + (t[i + 1] == "static")
                parts, end = self._dotted(j)
                if first and word == "package":
                    self.package = ".".join(parts)
                elif first and t[i + 1] != "static" and t[end] != ".":
                    self.imports.append(".".join(parts))
                i = end
                continue
            if word in TYPE_WORDS and _is_type(t[i + 1]) and (not i or t[i - 1] != "."):
                is_body = True
            elif word == "{":
                number += 1
                opened.append("{")
                bodies.append(is_body)
                scopes.append(dict(self.fields.get(number, {}) if is_body and not first else {}, **carried))
                if first and is_body:
                    self.fields[number] = scopes[-1]
                carried, is_body = {}, False
            elif word == "(":
                opened.append("(")
            elif word in ("}", ")"):
                while opened and opened[-1] != ("{" if word == "}" else "("):
                    opened.pop()  # unbalanced text
                if opened:
                    opened.pop()
                    if word == "}" and len(scopes) > 1:
                        scopes.pop()
                        bodies.pop()
                if word == "}":
                    carried = {}
            elif word == ";" and (not opened or opened[-1] == "{"):
                carried = {}
            elif first and not is_body and not bodies[-1]:
                pass  # no field stands in a method
            elif _is_name(word):
                found = self._declared(i)
                if found:
                    (carried if opened and opened[-1] == "(" else scopes[-1])[found[0]] = found[1]
                    i = self._generics(self._dotted(i)[1])
                    while t[i] != found[0]:
                        i += 1
                    i += 1
                    continue
                if word == "new":
                    parts, end = self._dotted(i + 1)
                    if _is_type(parts[-1]) and t[self._generics(end)] == "(" and not first:
                        yield i, *self._made(parts)
                    i = end
                    continue
                parts, end = self._dotted(i)
                head = not i or t[i - 1] not in (".", "::")
                if head and t[end] == "(" and len(parts) > 1 and not first:
                    use = self._called(parts, [carried, *reversed(scopes)])
                    if use:
                        yield i, *use
                i = end
                continue
            i += 1

    @staticmethod
    def _made(parts: list[str]) -> tuple[str, str, None, None]:
        if parts[-1].endswith("_Builder"):
            return "generated", ".".join(parts), None, None
        if parts[-1] == "Builder" and len(parts) > 1:
            return "builder", ".".join(parts[:-1]), None, None
        return "new", ".".join(parts), None, None

    @staticmethod
    def _called(parts: list[str], scopes: list[dict]) -> tuple[str, str, str, str | None] | None:
        parts = parts[1:] if parts[0] == "this" else parts
        if len(parts) < 2:
            return None
        held = next((s for s in scopes if parts[0] in s), None)
        if held is not None:
            kind = held[parts[0]]
            return ("call", kind.removesuffix(".Builder"), parts[1], parts[0]) if kind and len(parts) == 2 else None
        owner = parts[:-1]
        at = next((k for k, p in enumerate(owner) if _is_type(p)), None)
        if at is None or any(not _is_type(p) or (p.isupper() and len(p) > 1) for p in owner[at + 1 :]):
            return None  # a package, a constant, a field
        return "static", ".".join(owner), parts[-1], None


_USE = "array<struct<pos:int,kind:string,type:string,method:string,receiver:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("method", pa.string()), ("receiver", pa.string())])
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):  # few texts at once
        walks = [Walk(x.as_py() or "") for x in batch.column(1)]
        uses = [[dict(zip(("pos", "kind", "type", "method", "receiver"), u, strict=True)) for u in w.uses] for w in walks]
        columns = [batch.column(0), pa.array([w.package for w in walks]), pa.array([w.imports for w in walks], pa.list_(pa.string())), pa.array(uses, pa.list_(fields))]
        yield pa.RecordBatch.from_arrays(columns, ["file", "package", "imports", "uses"])


def read_calls(files: DataFrame, path: str | Column = "path", content: str | Column = "content") -> DataFrame:
    """``file, package, imports, uses``: one row a file, with its instantiations and calls in
    order.  ``kind`` of a use: new, builder (``new T.Builder``), generated (``new T_Builder``),
    call (on a variable of the type), static.  A null text has none.  Files are dealt to all
    tasks first: a table that packs well is one split, whatever the work on its texts."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    slim = files.select(column(path).cast("string").alias("file"), column(content).cast("string").alias("content"))
    slim = slim.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return slim.mapInArrow(_read, f"file string, package string, imports array<string>, uses {_USE}")
