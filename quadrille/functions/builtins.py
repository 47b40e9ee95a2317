"""Built-in predicates and functions of rules: comparison, arithmetic, strings, dates, durations and lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.strings import normal_space
from quadrille.functions.terms import resolved, strafter


def _before(text: Column, mark: Column) -> Column:
    at = F.instr(text, mark)
    return F.when((at > 0) & (F.length(mark) > 0), F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))


def _day_time(days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    return F.make_dt_interval(days, hours, minutes, seconds)


def _in_a_day(time: Column) -> Column:
    """A time of the day, kept as what has passed since midnight, after whole days are taken away."""
    part = lambda name: F.extract(F.lit(name), time)
    seconds = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(seconds.cast("decimal(18, 6)"), F.lit(86400).cast("decimal(18, 6)")))


#: Built-ins by name. A zero divisor and a text that isn't a date give NULL: the atom then fails.
BUILTINS: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b, "notEqual": lambda a, b: a != b, "lessThan": lambda a, b: a < b, "lessThanOrEqual": lambda a, b: a <= b,
    "greaterThan": lambda a, b: a > b, "greaterThanOrEqual": lambda a, b: a >= b,
    "add": lambda *x: sum(x[1:], x[0]), "subtract": lambda a, b: a - b,
    "multiply": lambda *x: reduce(lambda a, b: a * b, x), "divide": F.try_divide,
    "integerDivide": lambda a, b: F.try_divide(a - F.try_mod(a, b), b).cast("long"), "mod": F.try_mod, "pow": F.pow,
    "unaryPlus": lambda a: a, "unaryMinus": lambda a: -a, "abs": F.abs, "ceiling": F.ceil, "floor": F.floor, "round": lambda a: F.floor(a + F.lit(0.5)),
    "roundHalfToEven": F.bround, "sin": F.sin, "cos": F.cos, "tan": F.tan, "booleanNot": lambda a: ~a,
    "stringEqualIgnoreCase": lambda a, b: F.lower(a) == F.lower(b), "stringConcat": F.concat,
    "substring": lambda t, at, n=None: F.substring(t, at, n if n is not None else F.length(t)), "stringLength": F.length,
    "normalizeSpace": normal_space, "upperCase": F.upper, "lowerCase": F.lower, "translate": F.translate,
    "contains": lambda a, b: a.contains(b), "containsIgnoreCase": lambda a, b: F.lower(a).contains(F.lower(b)),
    "startsWith": lambda a, b: a.startswith(b), "endsWith": lambda a, b: a.endswith(b), "substringBefore": _before, "substringAfter": strafter,
    "matches": lambda t, pattern: t.rlike(pattern), "replace": F.regexp_replace, "tokenize": F.split,
    "yearMonthDuration": F.make_ym_interval, "dayTimeDuration": _day_time,
    "dateTime": F.make_timestamp, "date": F.make_date,
    "addYearMonthDurations": lambda a, b: a + b, "subtractYearMonthDurations": lambda a, b: a - b, "multiplyYearMonthDurations": lambda a, n: a * n,
    "divideYearMonthDurations": lambda a, n: a / n, "addDayTimeDurations": lambda a, b: a + b, "subtractDayTimeDurations": lambda a, b: a - b,
    "multiplyDayTimeDurations": lambda a, n: a * n, "divideDayTimeDuration": lambda a, n: a / n,
    "subtractDates": lambda a, b: F.datediff(a, b), "addYearMonthDurationToDate": lambda d, m: F.add_months(d, m),
    "addDayTimeDurationToDate": lambda d, n: F.date_add(d, n), "addYearMonthDurationToDateTime": lambda t, i: t + i,
    "addDayTimeDurationToDateTime": lambda t, i: t + i, "subtractYearMonthDurationFromDateTime": lambda t, i: t - i,
    "subtractDayTimeDurationFromDateTime": lambda t, i: t - i, "subtractYearMonthDurationFromDate": lambda d, m: F.add_months(d, -m),
    "subtractDayTimeDurationFromDate": lambda d, n: F.date_sub(d, n), "subtractDateTimesYieldingDayTimeDuration": lambda a, b: a - b,
    "subtractDateTimesYieldingYearMonthDuration": lambda a, b: F.months_between(a, b).cast("int"),
    "time": lambda h, m, s: _day_time(F.lit(0), h, m, s), "subtractTimes": lambda a, b: a - b, "addDayTimeDurationToTime": lambda t, i: _in_a_day(t + i),
    "subtractDayTimeDurationFromTime": lambda t, i: _in_a_day(t - i), "multiplyYearMonthDuration": lambda a, n: a * n,
    "resolveURI": resolved, "anyURI": F.concat, "listConcat": F.concat, "listIntersection": F.array_intersect, "listSubtraction": F.array_except,
    "member": lambda x, xs: F.array_contains(xs, x), "length": F.size, "first": lambda xs: F.get(xs, F.lit(0)),
    "rest": lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1))), "sublist": lambda xs, ys: F.size(F.array_except(ys, xs)) == 0, "empty": lambda xs: F.size(xs) == 0,
}


def test(name: str, *args: str | float, numeric: bool = True):
    """A condition of a rule: a built-in over variables (?x) and constants; numbers are compared by value. A built-in that can't be
    calculated fails the rule's atom."""

    def condition(bound) -> Column:
        column = lambda x: (bound[x[1:]] if isinstance(x, str) and x.startswith("?") else F.lit(x))
        return F.coalesce(builtin(name, *[column(a).try_cast("double") if numeric else column(a) for a in args]), F.lit(False))

    return condition


def builtin(name: str, *args) -> Column:
    """The built-in of that name, applied to columns."""
    if name not in BUILTINS:
        raise ValueError(f"{name} is no built-in")
    return BUILTINS[name](*args)
