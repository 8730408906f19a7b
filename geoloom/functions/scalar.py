"""Scalar functions of the feature service, as column expressions.

Function names follow their published names in snake case; `registry` maps the published ones.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _no_nulls(values, result: Column) -> Column:
    """Null as soon as one argument is (greatest and least skip nulls)."""
    for value in values:
        result = F.when(value.isNotNull(), result)
    return result


# --- math ---

def maximum(*values) -> Column:
    cols = [_c(v) for v in values]
    return _no_nulls(cols, F.greatest(*cols))


def minimum(*values) -> Column:
    cols = [_c(v) for v in values]
    return _no_nulls(cols, F.least(*cols))


def round_half_up(x) -> Column:
    """Halves go toward positive infinity."""
    return F.floor(_c(x) + 0.5)


def ieee_remainder(x, y) -> Column:
    return _c(x) - _c(y) * F.rint(_c(x) / _c(y))


def modulo(x, y) -> Column:
    """Sign of the dividend."""
    return _c(x) % _c(y)


def pi() -> Column:
    return F.lit(math.pi)


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


# --- comparison, logic, membership ---

def between(x, low, high) -> Column:
    return _c(x).between(_c(low), _c(high))


def member_of(x, *values) -> Column:
    return _c(x).isin(*[_c(v) for v in values])


def is_like(text, pattern: str) -> Column:
    """Whole-string regular expression match."""
    return _c(text).rlike(f"^(?:{pattern})$")


def if_then_else(condition, yes, no) -> Column:
    return F.when(_c(condition), _c(yes)).otherwise(_c(no))


def property_exists(df: DataFrame, name: str) -> Column:
    return F.lit(name in df.columns)


def is_instance_of(x, kind: str) -> Column:
    return F.typeof(_c(x)) == kind


# --- conversion, formatting, dates ---

def convert(x, kind: str) -> Column:
    return _c(x).try_cast(kind)


def parse_boolean(text) -> Column:
    """Empty, f, false, 0 and 0.0 are false, everything else true."""
    return ~F.lower(F.trim(_c(text))).isin("", "f", "false", "0", "0.0")


def parse_double(text) -> Column:
    return F.trim(_c(text)).try_cast("double")


def parse_long(text) -> Column:
    """A decimal part is cut off."""
    whole = F.trim(_c(text)).try_cast("bigint")
    return F.coalesce(whole, parse_double(text).try_cast("bigint"))


def parse_int(text) -> Column:
    return parse_long(text).try_cast("int")


def number_to_bool(x) -> Column:
    return _c(x) != 0


def number_format(pattern: str, number) -> Column:
    return F.call_function("format_number", _c(number), F.lit(pattern))


def number_format2(pattern: str, number, minus: str, decimal: str, grouping: str) -> Column:
    """With the given minus sign and separators."""
    return F.translate(number_format(pattern, number), "-.,", minus + decimal + grouping)


def date_format(pattern: str, stamp) -> Column:
    return F.date_format(_c(stamp), pattern)


def date_parse(pattern: str, text) -> Column:
    return F.try_to_timestamp(_c(text), F.lit(pattern))


# --- strings ---

def concatenate(*texts) -> Column:
    return F.concat(*[_c(t) for t in texts])


def equals_ignore_case(a, b) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


def index_of(text, part) -> Column:
    """0-based, -1 when absent."""
    return F.call_function("instr", _c(text), _c(part)) - 1


def last_index_of(text, part) -> Column:
    text, part = _c(text), _c(part)
    back = F.call_function("instr", F.reverse(text), F.reverse(part))
    return F.when(back == 0, -1).otherwise(F.length(text) - back - F.length(part) + 1)


def position(part, text, direction: str = "frontToBack") -> Column:
    """1-based position of `part`, 0 when absent."""
    return (last_index_of if direction == "backToFront" else index_of)(text, part) + 1


def replace(text, pattern: str, replacement: str, everywhere: bool = True) -> Column:
    if everywhere:
        return F.regexp_replace(_c(text), pattern, replacement)
    # The first match only: what precedes it is matched without greed and put back.
    groups = re.compile(pattern).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2 if m[1] != '0' else 2}", replacement)
    return F.regexp_replace(_c(text), f"(?s)^(.*?)({pattern})(.*)$", f"$1{shifted}${groups + 3}")


def substring(text, begin, end) -> Column:
    """0-based begin, exclusive end."""
    return F.substring(_c(text), _c(begin) + 1, _c(end) - _c(begin))


def substring_start(text, begin) -> Column:
    return F.substring(_c(text), _c(begin) + 1, F.length(_c(text)))


def trim2(text, side: str = "both", char: str = " ") -> Column:
    c = re.escape(char)
    pattern = {"leading": f"^{c}+", "trailing": f"{c}+$", "both": f"^{c}+|{c}+$"}[side]
    return F.regexp_replace(_c(text), pattern, "")


def string_template(text, pattern: str, template: str, default=None) -> Column:
    """Fill `${n}` in the template from the groups of a match; `default` where nothing matches."""
    pieces = [F.regexp_extract(_c(text), pattern, int(p)) if i % 2 else F.lit(p)
              for i, p in enumerate(re.split(r"\$\{(\d+)\}", template))]
    return F.when(_c(text).rlike(pattern), F.concat(*pieces)).otherwise(_c(default).cast("string"))


# --- value tables ---

def categorize(x, first, *rest, boundary: str = "succeeding") -> Column:
    """`first`, then threshold, value pairs. A value on a threshold goes to the upper class,
    or to the lower one with `preceding`."""
    x, out = _c(x), _c(first)
    for threshold, value in zip(rest[::2], rest[1::2]):
        above = x >= _c(threshold) if boundary == "succeeding" else x > _c(threshold)
        out = F.when(above, _c(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def recode(x, *pairs) -> Column:
    """Value for a key; null where no key fits."""
    out = None
    for key, value in zip(pairs[::2], pairs[1::2]):
        hit = _c(x) == _c(key)
        out = F.when(hit, _c(value)) if out is None else out.when(hit, _c(value))
    return out


def interpolate(x, *pairs, method: str = "linear") -> Column:
    """Between (position, value) pairs; outside them the end values hold."""
    x = _c(x)
    at, values = list(pairs[::2]), list(pairs[1::2])
    out = F.lit(float(values[-1]))
    for i in range(len(at) - 1, 0, -1):
        share = (x - at[i - 1]) / (at[i] - at[i - 1])
        if method == "cosine":
            share = (F.lit(1.0) - F.cos(share * math.pi)) * 0.5
        out = F.when(x < at[i], F.lit(float(values[i - 1])) + share * (values[i] - values[i - 1])).otherwise(out)
    return F.when(x.isNotNull(), F.when(x < at[0], F.lit(float(values[0]))).otherwise(out))
