"""Markup as chains of built-in replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWED = "p|br|b|i|em|strong|a|ul|ol|li|span|blockquote"


def sanitize(c: Column, allowed: str = ALLOWED) -> Column:
    """HTML without comments, dangerous blocks, unknown tags, or attributes."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|iframe|object)\b.*?</(script|style|iframe|object)\s*>", "")
    c = F.regexp_replace(c, rf"(?i)<(?!/?(?:{allowed})\b)/?[a-z][^>]*>", "")
    return F.regexp_replace(c, rf"(?i)<({allowed})\b[^>]*>", "<$1>")


def plain(c: Column) -> Column:
    """Text of a fragment: tags gone, entities undone, white space closed up."""
    c = F.regexp_replace(c, r"<[^<>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""https?://[^\s<>"')\]]+"""), F.lit(0))


def highlight(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, rf"(?i)(^|[^A-Za-z])({prefix}[A-Za-z]*)", "$1<mark>$2</mark>")
