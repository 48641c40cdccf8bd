"""Text features, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "n_code_points": F.length(t).cast("long"),
        "n_tokens": F.regexp_count(t, F.lit(r"[\p{L}\p{N}_]+")).cast("long"),
        "has_code": t.rlike("```|~~~|\n    \\S").cast("int"),
        "has_link": t.rlike("(?i)https?://").cast("int"),
        "has_image": t.rlike(r"(?i)!\[[^\]]*\]\(|<img\b").cast("int"),
        "has_template": t.rlike("(?m)^#{1,4} |<!--").cast("int"),
    }


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the keywords occur, as substrings in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((t.contains(w).cast("int") for w in words[1:]), t.contains(words[0]).cast("int"))
