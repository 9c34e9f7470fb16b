"""The instant of a run: read once, then carried through all stages, so that no two of them disagree about "today"."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunClock:
    """An instant, with the zone whose calendar a run goes by.

    Nothing else in the library asks for the current time. A run that is repeated with the same instant gives the same result,
    on any day and in whatever zone the cluster is.
    """

    instant: dt.datetime
    zone: str

    def __post_init__(self):
        if self.instant.tzinfo is None:
            raise ValueError("the instant of a run needs a zone of its own")
        zoneinfo.ZoneInfo(self.zone)  # an unknown zone fails here, not in some stage

    @classmethod
    def now(cls, zone: str) -> RunClock:
        return cls(dt.datetime.now(dt.timezone.utc), zone)

    @property
    def local(self) -> dt.datetime:
        """Wall-clock time in the zone, without zone."""
        return self.instant.astimezone(zoneinfo.ZoneInfo(self.zone)).replace(tzinfo=None)

    @property
    def today(self) -> dt.date:
        """Calendar date in the zone: the ``as_of`` of the operators."""
        return self.local.date()

    @property
    def week_start(self) -> dt.date:
        """Monday of the week of ``today``."""
        return self.today - dt.timedelta(days=self.today.weekday())

    def weeks_back(self, weeks: int) -> dt.date:
        return self.today - dt.timedelta(weeks=weeks)

    def arguments(self) -> dict[str, dt.date | Column]:
        """What a plan takes of it: the date its operators go by, and the time that its result is stamped with."""
        return {"as_of": self.today, "run_at": self.stamp()}

    def stamp(self) -> Column:
        """Wall-clock time in the zone as a constant column, the same in every row and under every session zone."""
        return F.lit(self.local.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")
