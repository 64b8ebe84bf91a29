"""Direct contact details and planted instructions in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.text import fold

# Open-ended repeats of groups are possessive or bounded: a greedy one recurses in the Java
# engine, and one hostile text would overflow the stack of its executor.
# Patterns of contact details, tokens that replace them, and the order of replacement.
W = "\\p{L}\\p{N}_"
URL = f"(?i)(?:https?://|www\\.)\\S+|(?<![{W}])(?:linkedin|github|gitlab|bitbucket|twitter|facebook|instagram|medium|behance|dribbble|stackoverflow)\\.[{W}]+/\\S*"
EMAIL = f"(?<![{W}.+-])[{W}.+-]+@[{W}-]+(?:\\.[{W}-]+)++"
EMAIL_SPELLED = f"(?i)(?<![{W}])[{W}.+-]+\\s*[\\[(]\\s*(?:at|arobase)\\s*[\\])]\\s*[{W}-]+(?:\\s*[\\[(]\\s*(?:dot|point)\\s*[\\])]\\s*[{W}-]+)++"
PHONE = f"(?<![{W}/])(?:(?:\\+|00)\\s?\\d{{1,3}}\\s?(?:\\(\\d\\))?|\\(\\+?\\d{{1,3}}\\)|0)(?:[\\s.\\-]?\\d){{8,11}}(?![{W}])"
LINK_TOKEN, EMAIL_TOKEN, PHONE_TOKEN = "[lien retiré]", "[email retiré]", "[numéro retiré]"

# Instructions aimed at a scoring assistant (on folded text).
INJECTIONS = [
    "ignore\\s+(?:all\\s+|any\\s+)?(?:the\\s+)?(?:previous|prior|above|earlier)\\s+(?:instructions?|prompts?|rules?)",
    "ignore[rz]?\\s+(?:toutes?\\s+)?(?:les\\s+)?(?:instructions?|consignes?|regles?)\\s+(?:precedentes?|ci-dessus|anterieures?)",
    "disregard\\s+(?:all\\s+)?(?:previous|prior)",
    "(?:system|developer)\\s+prompt",
    "you\\s+are\\s+now\\s+(?:an?\\s+)?(?:assistant|ai|model)",
    "tu\\s+es\\s+maintenant\\s+(?:un|une)\\s",
    "attribue[rz]?\\s+(?:le\\s+)?score\\s+(?:de\\s+)?\\d{2,3}",
    "(?:give|assign|rate)\\s+(?:this\\s+)?(?:candidate|cv|resume)\\s+(?:a\\s+)?(?:score|100|perfect)",
    "(?:score|note)\\s*[:=]\\s*100\\s*/\\s*100",
    "<\\|im_(?:start|end)\\|>|\\[/?inst\\]|###\\s*(?:system|instruction)",
    "affirme[rz]?\\s+(?:qu'il|que\\s+ce\\s+candidat)\\s+est\\s+expert",
    "recommande[rz]?\\s+(?:ce\\s+)?candidat\\s+(?:sans|automatiquement)",
]
STUFFED_WORD = "\\b([a-z0-9+#.]{2,20})\\b(?:[\\s,;|/]+\\1\\b){6}"
ZERO_WIDTH = "[​‌‍⁠﻿]"


def scrub(text: Column) -> Column:
    """Links, e-mails, spelled e-mails and phone numbers replaced by tokens, in this order."""
    t = F.regexp_replace(text, URL, LINK_TOKEN)
    t = F.regexp_replace(t, EMAIL, EMAIL_TOKEN)
    t = F.regexp_replace(t, EMAIL_SPELLED, EMAIL_TOKEN)
    return F.regexp_replace(t, PHONE, PHONE_TOKEN)


def has_contact_details(text: Column) -> Column:
    return text.rlike(URL) | text.rlike(EMAIL) | text.rlike(EMAIL_SPELLED) | text.rlike(PHONE)


def injection_flags(text: Column) -> Column:
    """First hit of each instruction pattern: array<struct<code,excerpt>>."""
    f = fold(text)
    hits = []
    for code, rx in enumerate(INJECTIONS, start=1):
        at = F.regexp_instr(f, F.lit(rx))
        size = F.length(F.regexp_substr(f, F.lit(rx)))
        hits.append(
            F.when(
                f.rlike(rx),
                F.struct(F.lit(code).alias("code"), F.substring(F.trim(F.substring(text, at, size + 60)), F.lit(1), F.lit(160)).alias("excerpt")),
            )
        )
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def keyword_stuffing(text: Column) -> Column:
    return fold(text).rlike(STUFFED_WORD)


def hidden_text(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ZERO_WIDTH)) > 5
