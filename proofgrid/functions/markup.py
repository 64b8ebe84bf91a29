"""HTML fragments to readable text."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that end a line, list items and any tag.
LINE_TAG = "(?i)<\\s*(?:br\\s*/?|/p|/div|/h[1-6])\\s*>"
ITEM_TAG = "(?i)<\\s*li[^>]*>"
ANY_TAG = "<[^>]{0,500}>"

_BARE = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
ENTITY = "&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + "|".join(_BARE) + "))"


def _code_point(number: Column) -> Column:
    return F.when(
        number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF),
        F.call_function("decode", F.unhex(F.lpad(F.hex(number), 8, "0")), F.lit("UTF-32")),
    ).otherwise(F.lit("�"))


def _entity(e: Column) -> Column:
    body = F.regexp_replace(e, "^&|;$", "")
    named = F.from_json(F.lit(json.dumps({k.rstrip(";"): v for k, v in html.entities.html5.items()})), "map<string,string>")
    return (
        F.when(body == "amp", "&").when(body == "lt", "<").when(body == "gt", ">").when(body == "quot", '"').when(body == "nbsp", "\xa0")
        .when(body.rlike("^#[xX]"), _code_point(F.conv(F.substring(body, 3, 6), 16, 10).cast("bigint")))
        .when(body.startswith("#"), _code_point(F.substring(body, 2, 7).cast("bigint")))
        .otherwise(F.coalesce(F.try_element_at(named, body), e))
    )


def unescape(text: Column) -> Column:
    """Named and numeric entities decoded in one pass."""
    cut = F.arrays_zip(F.split(text, ENTITY, -1).alias("p"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("e"))
    glued = F.transform(cut, lambda z: F.concat(z["p"], F.coalesce(_entity(z["e"]), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(glued, "")).otherwise(text)


def html_to_text(raw: Column) -> Column:
    """Line breaks and bullets kept, tags dropped, entities decoded, blank runs squeezed; the whole text."""
    t = F.regexp_replace(raw, "\r\n?", "\n")
    t = F.regexp_replace(t, LINE_TAG, "\n")
    t = F.regexp_replace(t, ITEM_TAG, "\n- ")
    t = F.regexp_replace(t, ANY_TAG, "")
    t = F.translate(unescape(t), "\x00", "")
    t = F.regexp_replace(t, "[ \t\xa0]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "^\\s+|\\s+\\z", "")
    return F.coalesce(t, F.lit(""))
