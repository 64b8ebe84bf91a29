"""Partial dates: month and year wordings, ranges, durations in months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions import text as tx
from proofgrid.functions.levels import lookup

# Month words, words for an open end, range separators, units that make a number a quantity, first plausible year.
MONTHS = {
    "jan": 1, "janv": 1, "janvier": 1, "january": 1, "feb": 2, "fev": 2, "fevr": 2, "fevrier": 2, "february": 2, "mar": 3, "mars": 3, "march": 3,
    "avr": 4, "apr": 4, "avril": 4, "april": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "june": 6, "juil": 7, "jul": 7, "juillet": 7, "july": 7,
    "aout": 8, "aug": 8, "august": 8, "sep": 9, "sept": 9, "septembre": 9, "september": 9, "oct": 10, "octobre": 10, "october": 10,
    "nov": 11, "novembre": 11, "november": 11, "dec": 12, "decembre": 12, "december": 12,
}
MONTH_NAMES = ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"]
MONTH_WORD = "|".join(sorted(MONTHS, key=len, reverse=True))
OPEN_END = "present|aujourd'?hui|actuel(?:lement)?|ce jour|en cours|current|now|date|maintenant|today|ongoing"
DATE = f"(?:\\d{{1,2}}\\s*[/.]\\s*\\d{{4}}|\\d{{4}}\\s*/\\s*\\d{{1,2}}(?!\\d)|(?:(?:{MONTH_WORD})\\.?\\s+)?\\d{{4}})"
RANGE = f"({DATE})\\s*(?:-|–|—|a|au|to|jusqu'?a|->|→)\\s*({DATE}|{OPEN_END})"
SINCE = f"(?:depuis|since|from)\\s+({DATE})"
QUANTITY_AFTER = (
    "^\\s*(?:k\\b|m\\b|%|€|\\$|euros?|eur\\b|messages?|msgs?|transactions?|requetes?|requests?|utilisateurs?|users?|jours?|mois|ans?\\b|tps|ko\\b|mo\\b|go\\b|to\\b|lignes?|brokers?|topics?|serveurs?)"
)
FIRST_YEAR = 1960
DEFAULT_MONTH = 7


def year_month(token: Column) -> Column:
    """struct<y,m> of a folded date token; the month is null when it is not stated or not a month."""
    t = F.trim(token)
    a = F.regexp_extract(t, "^(\\d{1,2})\\s*[/.]\\s*(\\d{4})$", 2)
    b = F.regexp_extract(t, "^(\\d{4})\\s*/\\s*(\\d{1,2})$", 1)
    c = F.regexp_extract(t, f"^(?:({MONTH_WORD})\\.?\\s+)?(\\d{{4}})$", 2)
    number = F.when(a != "", F.regexp_extract(t, "^(\\d{1,2})", 1)).when(b != "", F.regexp_extract(t, "(\\d{1,2})$", 1))
    n = number.try_cast("int")
    month = F.when(n.between(1, 12), n).when((a == "") & (b == "") & (c != ""), lookup(MONTHS, F.regexp_extract(t, f"^({MONTH_WORD})\\b", 1)).cast("int"))
    year = F.when(a != "", a).when(b != "", b).when(c != "", c).try_cast("int")
    return F.when(year.isNotNull(), F.struct(year.alias("y"), month.alias("m")))


def is_open(token: Column) -> Column:
    return F.trim(token).rlike(f"^(?:{OPEN_END})$")


def ordinal(ym: Column, default_month: int = DEFAULT_MONTH) -> Column:
    """Months since year 0; a missing month takes the default."""
    return ym["y"] * 12 + F.coalesce(ym["m"], F.lit(default_month)) - 1


def iso(ym: Column) -> Column:
    year = F.format_string("%04d", ym["y"])
    return F.when(ym["m"].isNotNull(), F.format_string("%04d-%02d", ym["y"], ym["m"])).when(ym["y"].isNotNull(), year)


def today_ordinal(today: str) -> int:
    return int(today[:4]) * 12 + int(today[5:7]) - 1


def plausible_range(start: Column, end: Column, after: Column, today: str) -> Column:
    """Years inside [1960, next year] and no unit right after: otherwise it is a quantity, not a period."""
    last = int(today[:4]) + 1
    inside = lambda token: F.regexp_extract(token, "(\\d{4})", 1).try_cast("int").between(FIRST_YEAR, last)
    return F.coalesce(inside(start), F.lit(False)) & (is_open(end) | F.coalesce(inside(end), F.lit(True))) & ~after.rlike(QUANTITY_AFTER)


def ranges(folded: Column) -> Column:
    """Date ranges of a folded line: array<struct<s,e,after>>."""
    return F.transform(
        tx.matches(folded, RANGE),
        lambda m: F.struct(
            F.regexp_extract(m["text"], RANGE, 1).alias("s"), F.regexp_extract(m["text"], RANGE, 2).alias("e"),
            F.substring(folded, m["end"] + 1, F.lit(24)).alias("after"),
        ),
    )


def first_range(folded: Column, today: str) -> Column:
    """First plausible range of a line, or an open range after "since"."""
    good = F.get(F.filter(ranges(folded), lambda r: plausible_range(r["s"], r["e"], r["after"], today)), F.lit(0))
    since = F.regexp_extract(folded, SINCE, 1)
    opened = F.when((since != "") & plausible_range(since, F.lit("present"), F.lit(""), today), F.struct(since.alias("s"), F.lit("present").alias("e"), F.lit("").alias("after")))
    return F.when(folded.rlike("\\d{4}"), F.coalesce(good, opened))


def duration(start: Column, end: Column, current: Column, today: str) -> Column:
    """Months of a period: one more when the start month is known and the end month is known or open; null when it ends before it starts."""
    s, e = ordinal(start), F.when(current, F.lit(today_ordinal(today))).otherwise(ordinal(end))
    extra = F.when(start["m"].isNotNull() & (current | end["m"].isNotNull()), 1).otherwise(0)
    return F.when(e >= s, F.greatest(F.lit(1), e - s + extra))


def precision(start: Column, end: Column, current: Column) -> Column:
    return F.when(start["m"].isNotNull() & (current | end["m"].isNotNull()), "month").otherwise("year")


def period_label(start: Column, end: Column, current: Column, known: Column) -> Column:
    """French label of a period given as YYYY or YYYY-MM."""

    def fmt(value: Column) -> Column:
        m = F.try_element_at(F.split(value, "-"), F.lit(2)).try_cast("int")
        name = F.get(F.array(*[F.lit(x) for x in MONTH_NAMES]), m - 1)
        return F.when(m.between(1, 12), F.concat_ws(" ", name, F.substring(value, 1, 4))).otherwise(F.substring(value, 1, 4))

    closing = F.when(current, "en cours").when(end.isNotNull(), fmt(end)).otherwise("date de fin non précisée")
    return F.when(~known | start.isNull(), "dates non précisées").otherwise(F.concat(fmt(start), F.lit(" – "), closing))
