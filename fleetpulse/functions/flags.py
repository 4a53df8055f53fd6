"""What an event's flag bits say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and bit of each flag.
FLAGS = {
    "reused": 0, "failed": 1, "tls": 2, "main_thread": 3, "foreground": 4, "metered": 5, "low_memory": 6, "validated": 7, "vpn": 8, "rooted": 9,
    "slow": 15, "ui_problem": 16, "http_classified": 17, "ui_classified": 18,
}


def flag(name: str, flags: str = "flags") -> Column:
    """Whether the bit is set; no flags have no bits."""
    return F.coalesce(F.col(flags), F.lit(0)).bitwiseAND(F.lit(1 << FLAGS[name])) != 0


def with_flags(events: DataFrame, *names: str, flags: str = "flags") -> DataFrame:
    """The named flags (all without names) as columns."""
    return events.withColumns({n: flag(n, flags) for n in names or FLAGS})


def http_failed(df: DataFrame) -> Column:
    """The flag, or a status of the server's errors (``server_error``, or a ``status`` from 500 on)."""
    own = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in df.columns else F.lit(False)
    if "server_error" in df.columns:
        own = own | F.coalesce(F.col("server_error"), F.lit(False))
    return own | F.coalesce(F.col("status") >= 500, F.lit(False)) if "status" in df.columns else own
