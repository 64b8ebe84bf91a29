"""A profile text cut in Python: lines, dated lines, experiences and items, and their Arrow columns.

One pass over the lines of a text. The rules are those of ``structure`` and its fixed values; a text needs no other row, so
tasks work on Arrow batches and nothing is shuffled. ``Columns`` collects nested values field by field.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, pairwise
from operator import attrgetter, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from proofgrid.functions import date_rows as dr
from proofgrid.functions import dates as dt
from proofgrid.functions.rows import Pattern, fold, strings

# Headings of the sections (on folded lines), environment lines, bullets, lengths.
HEADINGS = {
    "skills": "competences?(?: techniques| cles| principales)?|skills|technologies|expertises?|connaissances techniques|stack(?: technique)?|outils|savoir[- ]faire|environnements? techniques? global|domaines? de competences?",
    "experience": "experiences?(?: professionnelles?)?|parcours(?: professionnel)?|work experience|professional experience|historique professionnel|missions? realisees|projets? realises",
    "education": "formations?|education|diplomes?|etudes|cursus",
    "languages": "langues?|languages?",
    "certifications": "certifications?|habilitations?|certificats?",
    "summary": "profil|resume|summary|a propos|objectif|presentation",
    "interests": "centres? d'interets?|loisirs|hobbies|interests|divers",
}
SKIPPED = ["skills", "education", "languages", "certifications", "interests"]
ENV_LINE = "(?i)^\\s*(?:environnements?(?:\\s+techniques?)?|stack(?:\\s+technique)?|technologies|outils|tech|environment)\\s*[:：]"
BULLET_LINE = "^\\s*[-•*·▪►→]"
HEADER_CHARS, LOOK_BACK_CHARS, GAP_CHARS = 160, 100, 120

HEADING = re.compile("|".join(f"(?P<{name}>{rx})" for name, rx in HEADINGS.items()))
HEADING_STARTS = frozenset(x[:3] for rx in HEADINGS.values() for x in re.sub(r"\(\?:.*?\)\??", "", rx).split("|"))
HEADING_EDGE = " :：-–—#*_\t."
ENV, BULLET = Pattern(ENV_LINE, re.ASCII).plain, Pattern(BULLET_LINE).plain
CLOSED, ENDED = Pattern("[.;]$").plain, Pattern("[.;:!?]$").plain
GOES_ON = re.compile("[a-zà-ÿ0-9(&,]")
EMPTY_BRACKETS, BRACKETS = Pattern("\\(\\s*\\)").plain, re.compile("[()\\[\\]]")
HEADER_CUT, SPACE = Pattern("\\s+[-–—|·@]\\s+|\\s+chez\\s+|\\s*\\|\\s*").plain, Pattern("\\s+").plain

Zone = tuple[int, int, int, int]          # start, end, first line, line after the last


@dataclass(slots=True)
class Lines:
    """The lines of a text in parallel lists, the headings among them, and its sections: first line, line after the last, name, whether in the zone, zone."""

    raw: list[str]
    f: list[str]
    start: list[int]
    headings: dict[int, str]
    sections: list[tuple[int, int, str, bool, Zone]]

    def end(self, n: int) -> int:
        return self.start[n] + len(self.raw[n])


@dataclass(slots=True)
class Dated:
    n: int
    zone: Zone
    first: int
    header: str
    begin: dr.Month | None
    end: dr.Month | None
    current: bool
    bullet: bool
    project: bool = False


@dataclass(slots=True)
class Block:
    s: int
    e: int
    body_s: int
    header: str
    company: str
    title: str
    start: str | None
    end: str | None
    current: bool
    months: int | None
    start_ord: int | None
    end_ord: int | None
    precision: str
    body: int
    until: int
    zone: Zone = (0, 0, 0, 0)
    first: int = 0

    def order(self) -> tuple:
        values = (getattr(self, c) for c in EXPERIENCE)
        return tuple((v is not None, v if v is not None else 0) for v in values)


EXPERIENCE = ("s", "e", "body_s", "header", "company", "title", "start", "end", "current", "months", "start_ord", "end_ord", "precision", "body", "until")


@dataclass(slots=True)
class Profile:
    lines: Lines
    dated: list[Dated] = field(default_factory=list)
    experiences: list[Block] = field(default_factory=list)
    items: list[tuple[int, int, int, int, str]] = field(default_factory=list)       # idx, item_no, start, end, item


def heading(folded: str) -> str | None:
    """Section named by a folded heading line, or None."""
    f = folded.strip(HEADING_EDGE)
    if f[:3] not in HEADING_STARTS or len(f) > 60:
        return None
    m = HEADING.fullmatch(f)
    return m.lastgroup if m else None


def cut_lines(text: str) -> Lines:
    """The lines, and the sections: each has the name of the last heading at or before it, and the zone that holds experiences."""
    raw, f = text.split("\n"), fold(text).split("\n")
    start = list(accumulate((len(x) + 1 for x in raw), initial=0))
    headings = {n: h for n, x in enumerate(f) if len(x) <= 80 and (h := heading(x)) is not None}
    has = "experience" in headings.values()
    whole = (0, len(text), 0, len(raw))
    firsts = [0, *headings]
    sections = []
    for j, first in enumerate(firsts):
        until = firsts[j + 1] if j + 1 < len(firsts) else len(raw)
        name = headings[first] if j else "summary"
        inside = name == "experience" if has else name not in SKIPPED
        stop = start[until] if until < len(raw) else len(text)
        sections.append((first, until, name, inside, (start[first], stop, first, until) if has else whole))
    return Lines(raw, f, start, headings, sections)


def header_like(x: Lines, n: int) -> bool:
    """A short line that may carry the company or the title above a dated line."""
    raw = x.raw[n]
    t = raw.strip(" ")
    if not t or len(raw) > LOOK_BACK_CHARS or n in x.headings or CLOSED.search(t) or BULLET.search(raw) or ENV.search(raw):
        return False
    return not (dr.YEAR.search(x.f[n]) and dr.RANGE.search(x.f[n]))


def dated_lines(x: Lines, today: str) -> list[Dated]:
    """Lines of the zone that open a dated block, with the header lines above them and their period."""
    out = []
    low, high = -1, -1              # of the block above that can hold projects
    for first, until, _, inside, zone in x.sections:
        for n in range(first, until) if inside else ():
            if dr.YEAR.search(x.f[n]) is None or len(x.raw[n]) > HEADER_CHARS or (found := dr.first_range(x.f[n], today)) is None:
                continue
            back = 0
            while back < 2 and n > back and header_like(x, n - back - 1):
                back += 1
            current = dr.is_open(found[1])
            begin, end = dr.year_month(found[0]), None if current else dr.year_month(found[1])
            header = " — ".join([raw.strip(" ") for raw in x.raw[n - back : n + 1]])
            d = Dated(n, zone, n - back, header, begin, end, current, BULLET.search(x.raw[n]) is not None)
            starts, ends = dr.ordinal(begin, 1), dt.today_ordinal(today) if current else dr.ordinal(end, 12)
            if ends is not None and ends >= 0 and not d.bullet:
                low, high = -1 if starts is None else starts, ends
            elif d.bullet and low >= 0 and starts is not None and ends is not None:
                d.project = starts >= low and 0 <= ends <= high
            out.append(d)
    return out


def split_header(header: str) -> tuple[str, str]:
    """Company and title of a header line: dates removed, cut at a spaced dash, bar or "chez"."""
    h = header
    for m in dr.RANGE.finditer(fold(header)):
        h = h[: m.start()] + " " * (m.end() - m.start()) + h[m.end() :]
    h = BRACKETS.sub(" ", EMPTY_BRACKETS.sub(" ", h))
    parts = [p for p in [x.strip(" ,;:-–—|·") for x in HEADER_CUT.split(h)] if p]
    return parts[0] if parts else "", parts[1] if len(parts) > 1 else ""


def dated_blocks(x: Lines, dated: list[Dated], today: str) -> list[Block]:
    """Each ends where the header lines of the next one start, never before the line after its own, the last one with its zone."""
    kept, out = [d for d in dated if not d.project], []
    for i, d in enumerate(kept):
        following, stop = kept[i + 1] if i + 1 < len(kept) else None, x.end(d.n)
        e = max(x.start[following.first], stop + 1) if following else d.zone[1]
        until = max(following.first, d.n + 1) if following else d.zone[3]
        months = dr.duration(d.begin, d.end, d.current, today)
        precision = "unknown" if months is None else "month" if dr.dated_to_month(d.begin, d.end, d.current) else "year"
        end_ord = dt.today_ordinal(today) if d.current else dr.ordinal(d.end)
        out.append(Block(
            x.start[d.first], e, stop, d.header, *split_header(d.header), dr.iso(d.begin), dr.iso(d.end), d.current, months, dr.ordinal(d.begin), end_ord, precision, d.n + 1, until, d.zone, d.first
        ))
    return out


def undated_blocks(text: str, x: Lines, blocks: list[Block]) -> list[Block]:
    """Gaps of more than 120 characters between the dated blocks of a zone."""
    out = []
    for zone in dict.fromkeys(z for first, until, _, inside, z in x.sections if inside and until > first):
        own = [b for b in blocks if b.zone == zone]
        starts = [(zone[0], zone[2]), *[(b.e, b.until) for b in own]]
        ends = [*[(b.s, b.first) for b in own], (zone[1], zone[3])]
        for (at, n), (stop, last) in zip(starts, ends, strict=True):
            if stop - at <= GAP_CHARS:
                continue
            part = text[at:stop]
            if len(SPACE.sub("", part)) <= 100:
                continue
            header = next((t for t in (y.strip(" ") for y in part.split("\n")) if t and heading(fold(t)) is None), None)
            if header is not None:
                out.append(Block(at, stop, at, header, *split_header(header), None, None, False, None, None, None, "unknown", n, last))
    return out


def cut_items(x: Lines, exps: list[Block]) -> list[tuple[int, int, int, int, str]]:
    """Bullets and paragraphs of the experience bodies; wrapped lines are glued."""
    out = []
    for idx, b in enumerate(exps):
        runs: list[list[int]] = []              # first line, line after the last
        before = ""
        for n in range(b.body, min(b.until, len(x.raw))):
            raw = x.raw[n]
            if not (x.start[n] < b.e and x.start[n] + len(raw) > b.body_s):
                continue
            line = raw.strip(" ")
            if before and GOES_ON.match(line) and not ENDED.search(before) and not BULLET.search(raw):
                runs[-1][1] = n + 1
            elif line:
                runs.append([n, n + 1])
            before = line
        for i, (n, until) in enumerate(runs):
            item = "\n".join(x.raw[n:until])
            out.append((idx, i, x.start[n], x.start[n] + len(item), item))
    return out


def cut(text: str, today: str, steps: int) -> Profile:
    """The parts of a text, up to the given step: lines, dated lines, experiences, items."""
    p = Profile(cut_lines(text))
    if steps >= 1:
        p.dated = dated_lines(p.lines, today)
    if steps >= 2:
        blocks = dated_blocks(p.lines, p.dated, today)
        p.experiences = blocks + undated_blocks(text, p.lines, blocks)
        p.experiences.sort(key=lambda b: b.s)
        if any(a.s == b.s for a, b in pairwise(p.experiences)):
            p.experiences.sort(key=Block.order)
    if steps >= 3:
        p.items = cut_items(p.lines, p.experiences)
    return p


def line_rows(p: Profile) -> list[tuple]:
    x = p.lines
    return [
        (n, x.start[n], x.end(n), x.raw[n], x.f[n], x.headings.get(n), name, inside) for first, until, name, inside, _ in x.sections for n in range(first, until)
    ]


def line_spans(p: Profile) -> list[tuple]:
    """(start, end, section, env): neighbouring lines of a section in one, environment lines apart."""
    x, out = p.lines, []
    for first, until, name, _, _ in x.sections:
        at = first
        for n in range(first, until):
            if (":" in x.raw[n] or "：" in x.raw[n]) and ENV.search(x.raw[n]):
                if n > at:
                    out.append((x.start[at], x.start[n], name, False))
                out.append((x.start[n], x.start[n + 1], name, True))
                at = n + 1
        if until > at:
            out.append((x.start[at], x.start[until], name, False))
    return out


INT, TEXT, FLAG = pa.int32(), pa.string(), pa.bool_()
MONTH = pa.struct([("y", INT), ("m", INT)])


def months(values: Sequence[dr.Month | None]) -> pa.Array:
    years = pa.array([None if v is None else v[0] for v in values], INT)
    return pa.StructArray.from_arrays([years, pa.array([None if v is None else v[1] for v in values], INT)], ["y", "m"], mask=pa.array([v is None for v in values], FLAG))


def nested(rows: list[list], fields: dict[str, tuple[pa.DataType | None, object]]) -> pa.Array:
    """array<struct> of some lists: for each field its type (None: a month) and how an element gives it."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = [x for r in rows for x in r]
    columns = [months([*map(get, flat)]) if kind is None else pa.array([*map(get, flat)], kind) for kind, get in fields.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, list(fields)))


LINE_FIELDS = dict(zip(("n", "start", "end", "raw", "f", "heading", "section", "in_zone"), zip((INT, INT, INT, TEXT, TEXT, TEXT, TEXT, FLAG), map(itemgetter, range(8)), strict=True), strict=True))
DATED_FIELDS = {
    "n": (INT, attrgetter("n")), "header": (TEXT, attrgetter("header")), "from": (None, attrgetter("begin")), "to": (None, attrgetter("end")), "is_current": (FLAG, attrgetter("current")),
    "bullet": (FLAG, attrgetter("bullet")), "project_period": (FLAG, attrgetter("project")),
}
EXPERIENCE_FIELDS = {
    name if name != "current" else "is_current": (TEXT if name in ("header", "company", "title", "start", "end", "precision") else FLAG if name == "current" else INT, attrgetter(name)) for name in EXPERIENCE
}
ITEM_FIELDS = {"idx": (INT, itemgetter(0)), "item_no": (INT, itemgetter(1)), "start": (INT, itemgetter(2)), "end": (INT, itemgetter(3)), "item": (TEXT, itemgetter(4))}
# column -> the step it needs, its elements, their fields; "spans": offsets in order of position, as ``structure.located`` looks them up
PARTS = {
    "lines": (0, line_rows, LINE_FIELDS), "dated": (1, attrgetter("dated"), DATED_FIELDS), "experiences": (2, attrgetter("experiences"), EXPERIENCE_FIELDS),
    "items": (3, attrgetter("items"), ITEM_FIELDS),
}
SPANS = {
    "_lines": (0, line_spans, dict(zip(("start", "end", "section", "env"), zip((INT, INT, TEXT, FLAG), map(itemgetter, range(4)), strict=True), strict=True))),
    "_exps": (2, lambda p: [(b.s, b.e, b.body_s, b.months, i) for i, b in enumerate(p.experiences)], dict(zip(("start", "end", "body_s", "months", "idx"), zip((INT,) * 5, map(itemgetter, range(5)), strict=True), strict=True))),
    "_items": (3, attrgetter("items"), {c: ITEM_FIELDS[c] for c in ("start", "end", "idx")}),
}
SQL_TYPES = {INT: "int", TEXT: "string", FLAG: "boolean", None: "struct<y:int,m:int>"}
Part = tuple[int, Callable[[Profile], list], dict]


def columns(keep: Sequence[str], item_text: bool = False) -> dict[str, Part]:
    """The columns of the parts named by ``keep``; "spans" are the offsets, with the texts of the items if asked for."""
    out: dict[str, Part] = {}
    for name in keep:
        out |= SPANS if name == "spans" else {name: PARTS[name]}
    if item_text and "spans" in keep:
        step, rows, fields = SPANS["_items"]
        out["_items"] = (step, rows, fields | {"item": ITEM_FIELDS["item"]})
    return out


def sql_type(fields: dict) -> str:
    return "array<struct<" + ",".join(f"{name}:{SQL_TYPES[kind]}" for name, (kind, _) in fields.items()) + ">>"


ROWS, CHARS = 2_000, 4_000_000         # of one output batch


def cut_batches(batches: Iterator[pa.RecordBatch], out: dict[str, Part], today: str) -> Iterator[pa.RecordBatch]:
    """(id, parts) of batches of (id, text)."""
    steps = max(step for step, _, _ in out.values())

    def done(ids: pa.Array, found: list[Profile]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[nested([rows(p) for p in found], fields) for _, rows, fields in out.values()]], [batch.schema.names[0], *out])

    for batch in batches:
        at, chars, found = 0, 0, []
        for i, t in enumerate(strings(batch.column(1))):
            found.append(cut(t or "", today, steps))
            chars += len(t or "")
            if len(found) >= ROWS or chars >= CHARS:
                yield done(batch.column(0).slice(at, len(found)), found)
                at, chars, found = i + 1, 0, []
        if found:
            yield done(batch.column(0).slice(at), found)


def last_at(spans: pa.Array, at: np.ndarray, known: np.ndarray) -> pa.Array:
    """For every row the last of its ordered spans that starts at or before the position, if it ends after it, else null."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    offsets = spans.offsets.to_numpy().astype(np.int64)
    held, first = spans.values, int(offsets[0]) if len(offsets) else 0
    flat = held.slice(first, int(offsets[-1]) - first) if len(offsets) else held
    start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    wide = 1 << 32                  # above any position
    # items of overlapping experiences may step back: the least start from here on is in order and ends at the same span
    ahead = np.minimum.accumulate((row * wide + start)[::-1])[::-1]
    i = np.searchsorted(ahead, np.arange(len(sizes)) * wide + np.clip(at, -1, wide - 1), side="right") - 1
    ok = known & (i >= offsets[:-1] - first)
    ok[ok] = end[i[ok]] > at[ok]
    return flat.take(pa.array(np.where(ok, i, 0), mask=~ok))


def places(at: pa.Array, lines: pa.Array, exps: pa.Array, items: pa.Array) -> pa.Array:
    """For every position: section and kind of its line, the experience with its months and whether its body lies ahead, the item."""
    known = at.is_valid().to_numpy(zero_copy_only=False)
    pos = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    line, exp, item = (last_at(x, pos, known) for x in (lines, exps, items))
    fields = lambda x, *names: [pc.struct_field(x, c) for c in names]
    body = fields(exp, "body_s")[0]
    return pa.StructArray.from_arrays(
        [*fields(line, "section", "env"), *fields(exp, "idx", "months"), pc.less(at, body.cast(pa.int64())), item], ["section", "env", "exp_idx", "exp_months", "before_body", "it"]
    )
