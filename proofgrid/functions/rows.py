"""Text functions on Python strings, as tasks call them row by row: the patterns of the column expressions with Java's meaning, the fold.

Spark evaluates nested array expressions node by node, which costs about a millisecond for a page of text. The operators that
cut profiles and analyse mentions run the same patterns here, inside Arrow batches. A pattern means what it means to Spark:
classes are ASCII, a word border looks at letters and digits of any script, ``$`` also stands before a last line end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa

from proofgrid.functions import text as tx

LINE_ENDS = "\\n\\r\\x85\\u2028\\u2029"
_IN_CLASS = {"s": " \\t\\n\\x0b\\f\\r", "d": "0-9", "w": "a-zA-Z0-9_"}


# Characters beyond ASCII on which the engines agree whether they are part of a word; others are looked at one by one.
AGREED = re.compile("[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff\u0370-\u0482\u048a-\u0590\u2010-\u206f\u20a0-\u20cf\u2190-\u245f\u2500-\u2775\u3000]*+")


def _ranges(chars: Iterable[str]) -> str:
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def unlike() -> tuple[str, str]:
    """Marks, which only Java takes for parts of words, and figures that aren't decimal digits, which only Python does; as classes."""
    kinds = {c: unicodedata.category(c) for c in map(chr, range(0x80, 0x110000))}
    return _ranges(c for c, k in kinds.items() if k == "Mn"), _ranges(c for c, k in kinds.items() if c.isalnum() and k[0] != "L" and k != "Nd")


@lru_cache(maxsize=1)
def exact_border() -> str:
    marks, figures = unlike()
    inside = f"[^\\W{figures}]|[{marks}]"
    return f"(?:(?<={inside})(?!{inside})|(?<!{inside})(?={inside}))"


def translated(pattern: str, border: str = "\\b") -> str:
    """A pattern of Java's engine as one of Python's."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e in _IN_CLASS:
                out.append(_IN_CLASS[e] if inside else f"[{_IN_CLASS[e]}]")
            elif e == "S" and not inside:
                out.append(f"[^{_IN_CLASS['s']}]")
            elif e == "b" and not inside:
                out.append(border)
            else:
                out.append("\\" + e if e.isascii() else re.escape(e))
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[")
                c, i = "^", i + 1
        elif c == "$":
            c = f"(?=(?:\r\n|[{LINE_ENDS}])?\\Z)"
        elif c == ".":
            c = f"[^{LINE_ENDS}]"
        out.append(c)
        i += 1
    return "".join(out)


class Pattern:
    """A compiled pattern; texts with characters that the engines take differently meet the slower form with exact borders."""

    def __init__(self, pattern: str, flags: int = 0):
        self.plain = re.compile(translated(pattern), flags)
        self.source, self.flags, self._exact = pattern, flags, None
        self.borders = "\\b" in pattern

    def on(self, text: str) -> re.Pattern:
        if not self.borders or text.isascii() or AGREED.fullmatch(text):
            return self.plain
        if self._exact is None:
            self._exact = re.compile(translated(self.source, exact_border()), self.flags)
        return self._exact

    def search(self, text: str) -> re.Match | None:
        return self.on(text).search(text)

    def spans(self, text: str) -> list[re.Match]:
        return list(self.on(text).finditer(text))

    def first(self, text: str, group: int = 1) -> str:
        """A group of the first occurrence; empty without one."""
        m = self.on(text).search(text)
        return (m[group] or "") if m else ""


@lru_cache(maxsize=100_000)
def compiled(pattern: str) -> Pattern:
    """Patterns held in a column, such as those of lexicon terms."""
    return Pattern(pattern)


_FOLD = dict(zip(tx.FOLD_FROM, tx.FOLD_TO, strict=True))
_FOLD_TABLE = str.maketrans(_FOLD)
_UNPLAIN = re.compile("[^\n -~]")


def fold(text: str) -> str:
    """Lower case without accents, same length."""
    own = set(_UNPLAIN.findall(text))
    if len(own) > 16:
        return text.translate(_FOLD_TABLE).lower()
    for c in own:
        if c in _FOLD:
            text = text.replace(c, _FOLD[c])
    return text.lower()


def strings(column: pa.Array) -> list[str | None]:
    """The values of a string column; bytes that are no UTF-8 become replacement characters, as Spark's own decoding makes them."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """Parts between the matches, in order, with their places."""
    out, at = [], 0
    for m in pattern.finditer(text):
        out.append((at, m.start(), text[at : m.start()]))
        at = m.end()
    out.append((at, len(text), text[at:]))
    return out
