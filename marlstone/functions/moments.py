"""Moments written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date-time layouts tried in this order, all read as UTC where no offset is given.
LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][ XXX]", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd MMM yyyy HH:mm:ss"]


def epoch_second(text: Column) -> Column:
    """Seconds since 1970 (floored), null where unreadable.

    Plain numbers are seconds, milliseconds, microseconds or nanoseconds by their size; other texts are tried as date-times.
    """
    t = F.trim(F.regexp_replace(text.cast("string"), r"[ ​﻿]", " "))
    number = F.when(t.rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"), t.try_cast("decimal(38,9)"))
    size = F.abs(number)
    seconds = (
        F.when(size < F.lit(10**11), number)
        .when(size < F.lit(10**14), number / 10**3)
        .when(size < F.lit(10**17), number / 10**6)
        .otherwise(number / 10**9)
    )
    plain = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*(UTC|GMT)$", "")  # day name and zone of a header date
    stamps = [F.try_to_timestamp(plain, F.lit(p)) for p in LAYOUTS]
    dated = F.when(t.rlike(r"\d[:/.\-]\d"), F.coalesce(*[F.unix_timestamp(s) for s in stamps]))
    return F.coalesce(F.floor(seconds).cast("bigint"), F.when(number.isNull(), dated))
