"""Text and URL column functions. All of them are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it: Unicode white space and the four ASCII separators.
WS = r"(?U)[\s\x1c-\x1f]+"


def squeeze(c: Column) -> Column:
    """Trim and collapse white space."""
    return F.trim(F.regexp_replace(c, WS, " "))


def norm_text(c: Column) -> Column:
    """Lower-case, trim, collapse white space. Punctuation stays."""
    return squeeze(F.lower(c))


def tokens(c: Column, longer_than: int = 0) -> Column:
    """Distinct white-space tokens of normalised text with more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(norm_text(c), " "), lambda t: F.length(t) > longer_than))


def authority(url: Column) -> Column:
    """What stands between ``://`` and the path: host, port and user-info as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def link_key(url: Column) -> Column:
    """A link without case, scheme, leading ``www.``, query, fragment and trailing slashes."""
    u = F.trim(F.lower(url))
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), r"/+$", "")
