"""The analysis of one mention inside its item, in Python: the rules and patterns of ``scope`` and ``signals`` on strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa

from proofgrid.functions import scope as sp
from proofgrid.functions import signals as sg
from proofgrid.functions import text as tx
from proofgrid.functions.rows import Pattern, compiled, fold, pieces, strings, translated

Span = tuple[int, int, str]

# Clue words that are spellings of one another.
CANONICAL = {"producteur": "producer", "consommateur": "consumer", "brokers": "broker", "debit": "throughput", "volumetrie": "throughput"}

ITEM_BREAK = re.compile(translated(tx.ITEM_SENTENCE_BREAK))
CLAUSE_BREAK, NEGATION, POST_NEGATION, DENIED_PROBLEM = Pattern(sp.CLAUSE_BREAK), Pattern(sp.NEGATION), Pattern(sp.POST_NEGATION), Pattern(sp.DENIED_PROBLEM)
NEGATION_END, NEITHER_COMMA = Pattern(sp.NEGATION_END), Pattern(sp.NEITHER_COMMA)
CAPS = [(name, Pattern(rx)) for name, (_, rx) in sp.CAPS.items()]
TRAINER, LATER_YEAR = Pattern(sp.TRAINER), Pattern(sp.LATER_YEAR)
LABEL_WORDS, LIST_CUT, VERBISH = Pattern(sp.LABEL_WORDS), Pattern(",|/|\\bet\\b|\\band\\b"), Pattern(sp.VERBISH)
ACTION, GENERIC, WEAK, CARRIED = Pattern(sg.STRONG_ACTION), Pattern(sg.GENERIC_ACTION), Pattern(sg.WEAK_ACTION), Pattern(sg.CARRIED)
PARTICIPANT, OWNER = Pattern(sg.PARTICIPANT), Pattern(sg.OWNER)
QUANTITY, RESULT, DELIVERABLE = Pattern(sg.QUANTITY), Pattern(sg.RESULT), Pattern(sg.DELIVERABLE)
WORDS, STEM_CUT, PLURAL = re.compile("[^ \t\n\x0b\f\r]+"), re.compile("[ \t\n\x0b\f\r\\-_]+"), Pattern("[sx]$").plain


def sentences(flat: str) -> list[tuple[int, int]]:
    """Sentences of a flattened item; the whole of it when there is none."""
    out = []
    for start, _, part in pieces(flat, ITEM_BREAK):
        t = part.lstrip(tx.EDGE_CHARS)
        start += len(part) - len(t)
        if t := t.rstrip(" "):
            out.append((start, start + len(t)))
    return out or [(0, len(flat))]


def clauses(f: str) -> list[Span]:
    return [c for c in pieces(f, CLAUSE_BREAK.on(f)) if c[1] > c[0]] or [(0, len(f), f)]


def clause_at(spans: Sequence[Span], pos: int) -> Span:
    return next((c for c in spans if c[0] <= pos < c[1]), spans[-1])


def negated_regions(f: str, spans: Sequence[Span]) -> list[tuple[int, int]]:
    out = []
    linked = None
    for m in NEGATION.spans(f):
        if DENIED_PROBLEM.search(f[m.end() : m.end() + 45]):
            continue
        if linked is None:
            linked = NEITHER_COMMA.on(f).sub(" ", f)
        stop = NEGATION_END.search(linked[m.end() :])
        out.append((m.start(), m.end() + stop.start() if stop else len(f)))
    return out + [clause_at(spans, m.start())[:2] for m in POST_NEGATION.spans(f)]


def cap_codes(clause: str, year: int) -> list[str]:
    out = []
    for name, rx in CAPS:
        if rx.search(clause):
            out.append("trainer" if name == "training" and TRAINER.search(clause) else name)
    if any(int(m[1]) > year for m in LATER_YEAR.spans(clause)):
        out.append("future")
    return out


def stack_list(clause: str) -> bool:
    head, colon, tail = clause.partition(":")
    if not colon or len(WORDS.findall(head)) > 5 or LABEL_WORDS.search(head):
        return False
    names = [t for t in (x.strip(" ") for x in LIST_CUT.on(tail).split(tail)) if t]
    return len(names) >= 3 and all(len(WORDS.findall(t)) <= 5 for t in names) and VERBISH.search(tail) is None


@lru_cache(maxsize=100_000)
def stem(term: str) -> str:
    def one(w: str) -> str:
        a = CANONICAL.get(w, w)
        b = a[:-1] if len(a) > 3 and PLURAL.search(a) else a
        return CANONICAL.get(b, b)

    return " ".join(map(one, STEM_CUT.split(fold(term).strip(" "))))


def distinct_clues(folded: str, clues: Sequence[dict]) -> list[str]:
    return sorted({stem(c["term"]) for c in clues if c["rx"] is not None and compiled(c["rx"]).search(folded)})


def distinct_matches(text: str, rx: Pattern) -> list[str]:
    return sorted({m[0].strip(" ") for m in rx.spans(text)})


def masked(f: str, regions: Sequence[tuple[int, int]]) -> str:
    for a, b in regions:
        f = f[:a] + " " * (b - a) + f[b:]
    return f


def level_of(kind: str | None, action: str, part: bool, depth: int | None, points: int, negated: bool, cap: int | None, listed: bool) -> int:
    """``signals.classify`` for one mention."""
    top = 3 if part else 4
    if kind == "activity":
        core = 2 if action == "none" or depth is None else top if depth >= 3 or (depth >= 2 and points >= 3) else 3 if depth == 2 or (depth == 1 and points >= 3) else 2
    elif kind == "domain":
        core = (3 if part or points < 3 else 4) if action == "strong" and depth else 2
    elif action == "strong":
        core = top if points >= 3 else 3
    else:
        core = 3 if action == "weak" and points >= 2 else 2
    if negated:
        return 1
    if cap is not None and cap <= core:
        return cap
    return min(core, 2) if listed else core


def analysed(item: str | None, at: int | None, clues: Sequence[dict] | None, kind: str | None, year: int) -> tuple:
    """The fields of ``FIELDS`` for one mention; a null item has no signals."""
    if item is None:
        return None, None, [], None if clues is None else [], None, None, None, None, "none", "neutral", None, 2, None, 0
    flat = item.replace("\n", " ")
    sents = sentences(flat)
    own = 0 if at is None else next((i for i, (a, b) in enumerate(sents) if a <= at < b + 1), 0)
    w0, w1 = sents[max(own - 1, 0)][0], sents[min(own + 1, len(sents) - 1)][1]
    window = flat[w0:w1]
    f = fold(window)
    pos = max(0, len(f) - 1 if at is None else min(at - w0, len(f) - 1))
    spans = clauses(f)
    start, end, clause = clause_at(spans, pos)
    neg = negated_regions(f, spans)
    listed = stack_list(clause)
    head = fold(flat).lstrip(" -•*·▪►→")[: sp.ITEM_PREFIX]
    caps = list(dict.fromkeys([*cap_codes(clause, year), *[c for c in cap_codes(head, year) if c in sp.ITEM_CAPS]]))
    fm = masked(f, [*neg, *[(a, b) for a, b, t in spans if a != start and cap_codes(t, year)]])
    verbs, quantities, results, deliverables = (distinct_matches(fm, rx) for rx in (ACTION, QUANTITY, RESULT, DELIVERABLE))
    own_m = fm[start:end]
    depth = None if clues is None else distinct_clues(fm, clues)
    verb = ACTION.search(own_m) if verbs or own_m != fm else None
    generic = kind == "skill" and len(verbs) == 1 and verb is not None and GENERIC.search(verb[0].strip(" ")) is not None
    if verb is not None and not generic:
        action = "strong"
    elif (CARRIED.search(own_m) and ACTION.search(fm[:start])) or WEAK.search(own_m):
        action = "weak"
    else:
        nominal = kind == "skill" and not listed and not caps and clues is not None and QUANTITY.search(own_m) and len(distinct_clues(own_m, clues)) >= 2
        action = "weak" if nominal else "none"
    role = "participant" if PARTICIPANT.search(own_m) else "owner" if OWNER.search(fm) else "neutral"
    points = (3 if depth is None else min(3, len(depth))) + sum(map(bool, (quantities, results, deliverables, role == "owner", len(verbs) >= 2)))
    negated = any(a <= pos < b for a, b in neg)
    cap = min((sp.CAP_LEVELS[c] for c in caps), default=None)
    level = level_of(kind, action, role == "participant", None if depth is None else len(depth), points, negated, cap, listed)
    return negated, listed, caps, depth, verbs, quantities, results, deliverables, action, role, points, level, window, w0 + start


TEXTS = pa.list_(pa.string())
FIELDS = {
    "negated": (pa.bool_(), "boolean"), "listed": (pa.bool_(), "boolean"), "caps": (TEXTS, "array<string>"), "depth": (TEXTS, "array<string>"), "verbs": (TEXTS, "array<string>"),
    "quantities": (TEXTS, "array<string>"), "results": (TEXTS, "array<string>"), "deliverables": (TEXTS, "array<string>"), "action": (pa.string(), "string"), "role": (pa.string(), "string"),
    "points": (pa.int32(), "int"), "level_ord": (pa.int32(), "int"), "window": (pa.string(), "string"), "clause_start": (pa.int32(), "int"),
}
SQL_TYPE = "struct<" + ",".join(f"{name}:{kind}" for name, (_, kind) in FIELDS.items()) + ">"


def analysis(today: str) -> Callable[[pa.Array, pa.Array, pa.Array, pa.Array], pa.Array]:
    """The function of a batch: items, positions, clues and kinds to a struct of ``FIELDS``."""
    year = int(today[:4])

    def run(items: pa.Array, at: pa.Array, clues: pa.Array, kinds: pa.Array) -> pa.Array:
        found = [analysed(*row, year) for row in zip(strings(items), at.to_pylist(), clues.to_pylist(), kinds.to_pylist(), strict=True)]
        columns = zip(*found, strict=True) if found else [[] for _ in FIELDS]
        return pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (kind, _) in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    return run
