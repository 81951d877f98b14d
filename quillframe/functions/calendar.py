"""Calendar periods by code: fiscal years and quarters, weeks ending on any day, business days, clock units and their multiples.

A period is a whole number of base units since a fixed origin, so grouping by one is grouping by a long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, functions as F

# Period codes and what they may end with.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
UNITS = {
    "Y": "Y", "y": "Y", "A": "Y", "a": "Y", "Q": "Q", "q": "Q", "M": "M", "m": "M", "W": "W", "w": "W", "B": "B", "b": "B", "D": "D", "d": "D",
    "h": "h", "H": "h", "min": "min", "T": "min", "t": "min", "s": "s", "S": "s", "ms": "ms", "L": "ms", "l": "ms", "us": "us", "U": "us", "u": "us",
    "ns": "ns", "N": "ns", "n": "ns",
}
ANCHORS = {"Y": MONTHS, "Q": MONTHS, "W": WEEKDAYS}
#: Units of the clock, longest first, in microseconds.
CLOCK = {
    "D": Fraction(86_400_000_000), "h": Fraction(3_600_000_000), "min": Fraction(60_000_000), "s": Fraction(1_000_000), "ms": Fraction(1000),
    "us": Fraction(1), "ns": Fraction(1, 1000),
}

_PART = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+)?\s*([A-Za-z]+)(?:-([A-Za-z]+))?")
_DAY = 86_400_000_000


def _div(n: Column, by: int) -> Column:
    """Whole quotient, rounded down, of longs of any size: what is divided is a multiple already."""
    return F.round((n - F.pmod(n, F.lit(by))) / by).cast("long")


@dataclass(frozen=True)
class Period:
    """``multiple`` base units; ``anchor`` is the place of the last month or weekday in its list."""

    unit: str
    multiple: int = 1
    anchor: int | None = None

    @classmethod
    def of(cls, code: str) -> Period:
        """Read a code: a multiple, a unit and an anchor, as in M, 2W, W-WED, Q-MAR, 15min; clock units may follow each other (1D12h)."""
        parts, at = [], 0
        while at < len(code):
            found = _PART.match(code, at)
            if not found or found[2] not in UNITS:
                raise ValueError(f"Unsupported frequency: {code}")
            parts.append((Fraction(found[1] or "1"), UNITS[found[2]], found[3]))
            at = found.end()
        if not parts or any(n <= 0 for n, _, _ in parts):
            raise ValueError(f"Unsupported frequency: {code}")
        n, unit, anchor = parts[0]
        if len(parts) == 1 and n.denominator == 1:
            names = ANCHORS.get(unit, ())
            if anchor is not None and anchor.upper() not in names:
                raise ValueError(f"Unsupported frequency: {code}")
            return cls(unit, int(n), (names.index(anchor.upper()) if anchor else len(names) - 1) if names else None)
        if any(u not in CLOCK or a for _, u, a in parts):
            raise ValueError(f"Unsupported frequency: {code}")
        total = sum(n * CLOCK[u] for n, u, _ in parts)
        for name, length in CLOCK.items():
            if (total / length).denominator == 1:
                return cls(name, int(total / length))
        raise ValueError(f"Unsupported frequency: {code}")

    def number(self, moment: Column, spans: bool = False) -> Column:
        """How many base units (with ``spans``: whole multiples) lie between the origin and a timestamp without time zone.

        Years and quarters are fiscal ones named by the year they end in; months count from year 0, weeks, days and clock units from
        1970-01-01, weeks by the one that holds it.
        """
        base = self._base(moment)
        return _div(base, self.multiple) if spans and self.multiple > 1 else base

    def _base(self, moment: Column) -> Column:
        year, month = F.year(moment).cast("long"), F.month(moment)
        days = F.unix_date(moment.cast("date")).cast("long")
        if self.unit in ("Y", "Q"):
            fiscal = year + F.when(month > self.anchor + 1, 1).otherwise(0)
            if self.unit == "Y":
                return fiscal
            return fiscal * 4 + _div(F.pmod(month - self.anchor - 2, F.lit(12)), 3)
        if self.unit == "M":
            return year * 12 + month - 1
        if self.unit == "W":
            return _div(days + 9 - self.anchor, 7)
        if self.unit == "B":  # Saturdays and Sundays belong to the next Monday
            return _div(days + 3, 7) * 5 + F.least(F.pmod(days + 3, F.lit(7)), F.lit(5))
        if self.unit == "D":
            return days
        clock = F.hour(moment).cast("long") * 3_600_000_000 + F.minute(moment).cast("long") * 60_000_000
        clock = clock + (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")
        # Whole units of the day, so that nothing needs more than 64 bits.
        length = CLOCK[self.unit]
        if length < 1:
            return (days * _DAY + clock) * int(1 / length)
        return days * (_DAY // int(length)) + _div(clock, int(length))

    def label(self, number: Column, spans: bool = False) -> Column:
        """The text of a numbered period; a multiple is named by its first base unit."""
        if spans and self.multiple > 1:
            number = number * self.multiple
        text = lambda n, width=2: F.lpad(n.cast("string"), width, "0")
        day = lambda n: F.date_format(F.date_from_unix_date(n.cast("int")), "yyyy-MM-dd")
        if self.unit == "Y":
            return number.cast("string")
        if self.unit == "Q":
            return F.concat(_div(number, 4).cast("string"), F.lit("Q"), (F.pmod(number, F.lit(4)) + 1).cast("string"))
        if self.unit == "M":
            return F.concat(text(_div(number, 12), 4), F.lit("-"), text(F.pmod(number, F.lit(12)) + 1))
        if self.unit == "W":
            first = number * 7 - 3 - 6 + self.anchor
            return F.concat(day(first), F.lit("/"), day(first + 6))
        if self.unit == "B":
            return day(_div(number, 5) * 7 - 3 + F.pmod(number, F.lit(5)))
        if self.unit == "D":
            return day(number)
        a_day = int(_DAY / CLOCK[self.unit])
        inside = F.pmod(number, F.lit(a_day))
        seconds = _div(inside, a_day // 86_400) if a_day > 86_400 else inside * (86_400 // a_day)
        parts = [day(_div(number, a_day)), F.lit(" "), text(_div(seconds, 3600)), F.lit(":"), text(F.pmod(_div(seconds, 60), F.lit(60)))]
        if a_day >= 86_400:
            parts += [F.lit(":"), text(F.pmod(seconds, F.lit(60)))]
        if a_day > 86_400:
            parts += [F.lit("."), text(F.pmod(inside, F.lit(a_day // 86_400)), len(str(a_day // 86_400)) - 1)]
        return F.concat(*parts)
