"""Occurrences of lexicon aliases in texts, in Arrow batches: the n-grams of a text meet the alias keys in a dictionary."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa

from proofgrid.functions.rows import compiled, fold, strings

TOKEN = re.compile("[a-z0-9+#]+")
AFTER_CHARS = 20
ROWS = 20_000              # of one output batch


@dataclass(slots=True)
class Alias:
    """A row of ``mentions.alias_table``."""

    skill_key: str | None
    alias: str
    sensitive: bool
    rx: str
    after_rx: str
    guarded: bool
    needed_rx: str
    forbidden_rx: str
    key: str


class Finder:
    """Aliases by their keys; patterns are compiled once a task."""

    def __init__(self, rows: Sequence[Alias], longest: int, window: int):
        self.by_key: dict[str, list[Alias]] = defaultdict(list)
        for r in rows:
            self.by_key[r.key].append(r)
        self.longest, self.window = longest, window

    def keys_in(self, f: str) -> list[str]:
        """The alias keys among the n-grams of a folded text, written without separators."""
        tokens = TOKEN.findall(f)
        grams = set(tokens)
        for n in range(2, self.longest + 1):
            grams.update("".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
        return [g for g in grams if g in self.by_key]

    def occurrences(self, text: str) -> Iterator[tuple[Alias, int, int]]:
        """Every guarded occurrence; it belongs to the key that equals its own tokens."""
        f = fold(text)
        spans: dict[tuple[str, bool], list[tuple[int, int, str]]] = {}
        for key in self.keys_in(f):
            for a in self.by_key[key]:
                if (found := spans.get((a.rx, a.sensitive))) is None:
                    where = text if a.sensitive else f
                    found = spans[a.rx, a.sensitive] = [(m.start(), m.end(), "".join(TOKEN.findall(fold(m[0])))) for m in compiled(a.rx).spans(where)]
                for start, end, own in found:
                    if own == key and self.kept(a, f, start, end):
                        yield a, start, end

    def kept(self, a: Alias, f: str, start: int, end: int) -> bool:
        if compiled(a.after_rx).search(f[end : end + AFTER_CHARS]):
            return False
        if not a.guarded:
            return True
        around = f[max(start - self.window, 0) : end + self.window]
        return compiled(a.needed_rx).search(around) is not None and compiled(a.forbidden_rx).search(around) is None


OUT = pa.schema([("skill_key", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("alias", pa.string())])
SQL_TYPE = "skill_key string, start int, end int, alias string"


def occurrence_batches(batches: Iterator[pa.RecordBatch], finder: Finder) -> Iterator[pa.RecordBatch]:
    """(keys, skill_key, start, end, alias) of batches of (text, keys)."""

    def done() -> pa.RecordBatch:
        keys = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
        columns = zip(*hits, strict=True) if hits else [[] for _ in OUT]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(list(c), t) for c, t in zip(columns, OUT.types, strict=True)]], [*batch.schema.names[1:], *OUT.names])

    for batch in batches:
        at: list[int] = []
        hits: list[tuple] = []
        for i, text in enumerate(strings(batch.column(0))):
            if text is None:
                continue
            for a, start, end in finder.occurrences(text):
                at.append(i)
                hits.append((a.skill_key, start, end, a.alias))
            if len(hits) >= ROWS:
                yield done()
                at, hits = [], []
        if hits:
            yield done()
