"""Message ids derived from the source position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUPS = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))


def message_id(*position: Column, origin: str = "msg") -> Column:
    """UUID-shaped text from where the message came from.

    A random id would change when a lost task is run again and would turn one message
    into two; the source position does not. ``origin`` tells apart sources whose arrival
    numbers overlap.
    """
    key = F.concat_ws("-", F.lit(origin), *[p.cast("string") for p in position])
    digest = F.md5(key)
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in _GROUPS])
