"""From when on a source is read: policies, clamps, and the windows of a walk back in time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far an automatic run may go back, and where the first one starts.
MOST_DAYS, FIRST_DAYS = 7, 30


@dataclass(frozen=True)
class Since:
    """``stored`` goes on from the last run, ``all`` has no lower bound, ``explicit`` starts at ``at``."""

    policy: str
    at: datetime | None = None

    @classmethod
    def parse(cls, text: str | None) -> Since:
        if text is None:
            return cls("stored")
        if not text:
            raise ValueError("a lower bound must be 'all' or an ISO 8601 time, not empty")
        if text.lower() == "all":
            return cls("all")
        try:
            at = datetime.fromisoformat(text)
        except ValueError as e:
            raise ValueError(f"{text!r} is neither 'all' nor an ISO 8601 time") from e
        return cls("explicit", at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc))

    def cutoff(self, stored: datetime | None) -> datetime | None:
        return {"all": None, "stored": stored, "explicit": self.at}[self.policy]


def since_filter(df: DataFrame, time_col: str, cutoff: datetime | None) -> DataFrame:
    """Rows from the cutoff on, as a literal that reaches the scan; all rows without one."""
    return df if cutoff is None else df.where(F.col(time_col) >= F.lit(cutoff))


def backfill_start(now: datetime, days: int | None = None, checkpoint: datetime | None = None, last_run: datetime | None = None) -> tuple[datetime, bool]:
    """``start, clamped``: a checkpoint, else the days asked for, else the last run, else thirty days back.

    Days that are asked for are kept, and a later checkpoint goes before them; an automatic start
    is no more than seven days back.
    """
    if days is not None:
        start = now - timedelta(days=days)
        return (max(start, checkpoint) if checkpoint else start), False
    start = checkpoint or last_run or now - timedelta(days=FIRST_DAYS)
    floor = now - timedelta(days=MOST_DAYS)
    return max(start, floor), start < floor


def back_scan(now: datetime, first: float, most: float, depth: float, fullness: float = 0.0, growth: float = 1.5) -> list[tuple[datetime, datetime]]:
    """The windows of a walk back in time, newest first: each longer than the last, faster as the mesh fills, to a depth in seconds."""
    out, end, step = [], now, first
    while (now - end).total_seconds() + step <= depth:
        start = end - timedelta(seconds=step)
        out.append((start, end))
        end, step = start, min(most, step * growth * (1 + fullness))
    return out


def window_of(time: Column, windows: list[tuple[datetime, datetime]]) -> Column:
    """The number of the window that a time falls in (start inclusive), null outside; so a whole scan is one pass."""
    out = F.lit(None).cast("int")
    for k, (start, end) in reversed(list(enumerate(windows))):
        out = F.when((time >= F.lit(start)) & (time < F.lit(end)), k).otherwise(out)
    return out


def backfilled(readers: list, cutoff: datetime | None, time_col: str = "timestamp") -> DataFrame:
    """The signals of several readers of one producer from a cutoff on, each id once."""
    frames = [since_filter(r(), time_col, cutoff) for r in readers]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["id"])
