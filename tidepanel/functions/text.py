"""Text and calendar expressions for news rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Severity words and their weights, the score cap.
HIGH_SEVERITY = [
    "fraud", "bankruptcy", "sec investigation", "default", "sanction", "crash", "plunge",
    "indictment", "scandal", "collapse", "crisis", "halt", "suspend",
]
MEDIUM_SEVERITY = [
    "downgrade", "miss", "hike", "warning", "lawsuit", "resigns", "cut", "decline", "fall",
    "drop", "concern", "investigation", "probe", "delay", "recall",
]
HIGH_WEIGHT, MEDIUM_WEIGHT, SHOCK_CAP = 3.0, 1.0, 5.0

# Disclosure footers, each removed to the end of the text.
FOOTERS = [
    r"The Motley Fool has a disclosure policy.*$",
    r"The Motley Fool has positions? in.*$",
    r"The Motley Fool recommends.*$",
    r"The Motley Fool owns shares of.*$",
    r"\*Stock Advisor returns as of.*$",
    r"Suzanne Frey, an executive at Alphabet.*$",
    r"John Mackey, CEO of Whole Foods Market.*$",
]
TAG = r"<[^>]+>"
LINK = r"http\S+|www\.\S+"
SPACE = r"\s+"
MIN_LENGTH = 10


def clean(text) -> Column:
    """Drop footers, tags and links; collapse white space."""
    out = col(text)
    for pattern in FOOTERS:
        out = F.regexp_replace(out, "(?is)" + pattern, "")
    out = F.trim(F.regexp_replace(out, SPACE, " "))
    out = F.regexp_replace(out, TAG, "")
    out = F.regexp_replace(out, LINK, "")
    return F.coalesce(F.trim(F.regexp_replace(out, SPACE, " ")), F.lit(""))


def shock(text, high=HIGH_SEVERITY, medium=MEDIUM_SEVERITY) -> Column:
    """Weighted count of the severity words found as substrings, capped."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    total = F.lit(0.0)
    for words, weight in ((high, HIGH_WEIGHT), (medium, MEDIUM_WEIGHT)):
        for word in words:
            total = total + F.contains(low, F.lit(word)).cast("double") * F.lit(weight)
    return F.least(total, F.lit(SHOCK_CAP))


def sentiment(labels: Column) -> Column:
    """Mean of +1 / -1 / 0 over a label array; empty or missing gives 0."""
    kept = F.filter(labels, lambda v: v.isNotNull() & (v != ""))
    score = F.transform(kept, lambda v: F.when(v == "positive", 1.0)
                        .when(v == "negative", -1.0).otherwise(0.0))
    total = F.aggregate(score, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(F.try_divide(total, F.size(kept).cast("double")), F.lit(0.0))


def eastern(ts) -> Column:
    return F.from_utc_timestamp(col(ts).cast("timestamp"), "America/New_York")


def effective_date(ts, cutoff: int | Column = 16) -> Column:
    """Day on which a text counts: from the cutoff hour (Eastern) on it moves to
    the next day, and only such moved days skip the weekend."""
    local = eastern(ts)
    day = F.to_date(local)
    nxt = F.date_add(day, 1)
    dow = F.weekday(nxt)
    moved = F.when(dow == 5, F.date_add(nxt, 2)).when(dow == 6, F.date_add(nxt, 1)).otherwise(nxt)
    return F.when(F.hour(local) >= cutoff, moved).otherwise(day)
