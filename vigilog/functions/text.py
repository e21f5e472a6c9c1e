"""Line cleaning, path parts and the source filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space, which a line is stripped of.
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(line: str | Column) -> Column:
    return F.trim(_col(line), F.lit(WHITESPACE))


def has_content(line: str | Column) -> Column:
    """The line holds at least one ASCII letter or digit."""
    return _col(line).rlike("[A-Za-z0-9]")


def has_letter(message: str | Column) -> Column:
    """The message holds an ASCII letter; missing messages do not."""
    return F.coalesce(_col(message).rlike("[a-zA-Z]"), F.lit(False))


def source_of_path(path: str | Column) -> Column:
    """First path segment below ``gather``, or the first segment of all where that is absent."""
    below = F.regexp_replace(_col(path), r"^.*?gather[/\\]", "")
    return F.regexp_extract(below, r"^([^/\\]*)", 1)


def is_log_path(path: str | Column) -> Column:
    """Log files of the observed hosts: below a ``logs`` folder and not the attacker's own."""
    return ~F.contains(_col(path), F.lit("attacker")) & F.contains(_col(path), F.lit("logs"))


def source_tokens(source: str | Column) -> Column:
    """Distinct lower-case tokens of an indexed source; ``_`` does not separate."""
    parts = F.split(F.lower(_col(source)), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def relaxation_chain(source: str | Column) -> Column:
    """Source terms to try in turn; the closing null stands for no filter."""
    first = _col(source)
    second = _shorter(first)
    third = _shorter(second)
    return F.array_append(F.array_compact(F.array(first, second, third)), F.lit(None).cast("string"))


def _shorter(term: Column) -> Column:
    return F.when(F.contains(term, F.lit("-")), F.get(F.split(term, "-"), F.lit(1))).when(
        F.contains(term, F.lit("_")), F.get(F.split(term, "_"), F.lit(1))
    )


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
