"""Event time of a log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three notations, tried in this order, and the year the first one lacks.
SYSLOG = r"([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
ACCESS_LOG = r"\[(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})\]"
EPOCH_FIELD = r'"timestamp"":\s*(\d+\.\d+)'
SYSLOG_YEAR = "2022"


def event_time(line: str | Column) -> Column:
    """First notation that is present and valid, as a timestamp; null when there is none."""
    text = F.col(line) if isinstance(line, str) else line

    def found(pattern: str) -> Column:
        return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), r"\s+", " ")

    syslog = F.try_to_timestamp(F.concat(F.lit(SYSLOG_YEAR + " "), found(SYSLOG)), F.lit("yyyy MMM d HH:mm:ss"))
    access = F.try_to_timestamp(found(ACCESS_LOG), F.lit("d/MMM/yyyy:HH:mm:ss Z"))
    micros = F.round(found(EPOCH_FIELD).try_cast("double") * 1e6).try_cast("bigint")
    return F.coalesce(syslog, access, F.timestamp_micros(micros))
