"""Exact rendering of values, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal
from functools import reduce
from math import isfinite

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

JVM_DIGITS = 15  # digits or places up to which the JVM's number format is used
WIDE = Context(prec=2_000, Emin=MIN_EMIN, Emax=MAX_EMAX)

# Grammars of numbers in text, of cells, of tokens that look like numbers, units written without a space,
# names of boolean styles.
INTEGER = r"^-?(?:0|[1-9][0-9]*)\z"
DECIMAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
CELL_INTEGER = r"^[+-]?(?:0|[1-9][0-9]*)\z"
CELL_FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|[0-9]+e[+-]?[0-9]+|inf(?:inity)?|nan)\z"
NUMBER_START = r"^[\s~≈<>≤≥(\[{]*[-+]?(?:[0-9]|\.[0-9])"
NOT_NUMBERS = {
    "assignment": r"[A-Za-z_][A-Za-z0-9_.-]*\s*=",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "hash": r"^[0-9a-fA-F]{12,}$",
    "option": r"^--",
    "pH": r"(?i)^[0-9]+\s*PH(?:\b|$)",
    "UUID": r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
ATTACHED_UNITS = ("%", "°", "°C", "°F", "x")
BOOLEAN_STYLES = {"pass_fail": ("Pass", "Fail"), "true_false": ("true", "false"), "yes_no": ("yes", "no")}
FORM_VALUES = {"interval": (3, 3), "plus_minus": (2, 2), "range": (2, 2), "scalar": (1, 1), "text": (1, 1), "tuple": (2, 8)}


def is_number(text: Column, kind: str) -> Column:
    """Whether text is an integer or decimal by the closed grammar: no plus, no leading zeros, digits around the point."""
    return text.rlike(INTEGER if kind == "integer" else DECIMAL)


def parse(text: Column, kind: str) -> Column:
    """Text as decimal(38,18), null where it isn't an integer or decimal by the closed grammar."""
    return F.when(is_number(text, kind), text.try_cast("decimal(38,18)"))


def exactly(x: Column, write: Callable[[Decimal], str], plain: Column | None = None, safe: Column | None = None) -> Column:
    """write(value) of a number column, from a double's exact binary value; null for null, NaN and infinities.

    plain is what the JVM gives for doubles, safe says where that rounds by the exact value as well: Python then sees the
    others alone. The type is known when Spark plans, so only one of the two functions runs."""

    @F.pandas_udf("string")
    def doubles(s: pd.Series) -> pd.Series:
        if not s.notna().any():
            return pd.Series([None] * len(s), dtype=object)
        return s.map(lambda v: write(Decimal.from_float(float(v))) if isfinite(v) else None)

    @F.pandas_udf("string")
    def texts(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else write(Decimal(v)))

    double = x.cast("double")
    wide = doubles(double) if plain is None else F.when(safe, plain).otherwise(doubles(F.when(~safe, double)))
    return F.when(F.typeof(x).isin("double", "float"), wide).otherwise(texts(x.cast("string")))


def formatted(x: Column, pattern: str | Column) -> Column:
    """A double by a pattern of the JVM's number format: half to even on the exact value, as long as it asks for JVM_DIGITS
    figures at most, since it knows no more of the value than its shortest spelling; no sign before zero."""
    text = F.call_function("format_number", x.cast("double"), F.lit(pattern) if isinstance(pattern, str) else pattern)
    return F.when(text.rlike("^-[0.]+(?:E0)?$"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def few_figures(x: Column, places: int) -> Column:
    """Whether a double with that many places has JVM_DIGITS figures at most."""
    return F.abs(x.cast("double")) < 10.0 ** (JVM_DIGITS - places)


def full_figures(x: Column) -> Column:
    """Whether a double is zero, or large enough to have the precision of JVM_DIGITS figures."""
    size = F.abs(x.cast("double"))
    return (size == 0) | ((size > 1e-290) & (size < float("inf")))


def full_and_no_tie(x: Column, digits: int) -> Column:
    """full_figures, and the spelling isn't halfway between two numbers of that many figures: of whole doubles such as
    198500 the JVM thinks that the spelling isn't exact, and rounds up."""
    spelled = F.call_function("format_number", x.cast("double"), F.lit("0." + "#" * JVM_DIGITS + "E0"))
    return full_figures(x) & ~spelled.rlike(rf"^-?[0-9]\.[0-9]{{{digits - 1}}}5E")


def places_pattern(places: int) -> str:
    return "0." + "0" * places if places > 0 else "0"


def scaled(x: Column, factor: str) -> Column:
    return x * F.lit(Decimal(factor))


def half_even(x: Column, places: int) -> Column:
    """x rounded half to even at a decimal place (tens: -1), as decimal(38, places); doubles by their exact value, null
    where that has no room."""
    kind = f"decimal(38,{max(places, 0)})"
    plain = formatted(x, places_pattern(places)) if 0 <= places <= JVM_DIGITS else None
    text = exactly(x, lambda v: format(Decimal(round(v.scaleb(places, WIDE))).scaleb(-places, WIDE), "f"), plain, few_figures(x, places))
    return F.when(F.typeof(x).isin("double", "float"), text.try_cast(kind)).otherwise(F.bround(x, places).cast(kind))


def fixed(x: Column, places: int) -> Column:
    """Decimal text with that many places, rounded half to even, doubles by their exact value; no sign before a zero."""
    def write(v: Decimal) -> str:
        text = format(v, f".{places}f")
        return text if text.strip("-0.") else text.lstrip("-")

    inner = F.bround(x, places).cast(f"decimal(38,{places})").cast("string")
    plain = formatted(x, places_pattern(places)) if places <= JVM_DIGITS else None
    return F.when(F.typeof(x).isin("double", "float"), exactly(x, write, plain, few_figures(x, places))).otherwise(inner)


def significant(x: Column, digits: int) -> Column:
    """Text with that many significant figures, rounded half to even on the exact value, zeros kept, of any size.

    Where rounding carries into a further figure (9.996 to 10.0), places follow the rounded value."""

    def write(v: Decimal) -> str:
        if not v:
            return format(Decimal(0), f".{digits - 1}f")
        rounded = Decimal(format(v, f".{digits - 1}e"))
        return format(rounded, f".{max(digits - 1 - rounded.adjusted(), 0)}f")

    plain = None
    if digits <= JVM_DIGITS:
        text = formatted(x, places_pattern(digits - 1) + "E0")
        part = lambda i: F.regexp_extract(text, "^(-?)([0-9.]+)E(-?[0-9]+)$", i)
        run, e = F.replace(part(2), F.lit("."), F.lit("")), part(3).cast("int")
        shifted = F.when(e >= digits - 1, F.concat(run, F.repeat(F.lit("0"), e - digits + 1))).when(e >= 0, F.concat(F.left(run, e + 1), F.lit("."), F.substring(run, e + 2, F.lit(digits)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), run))
        plain = F.concat(part(1), shifted)
    return exactly(x, write, plain, full_and_no_tie(x, digits))


def scientific(x: Column, digits: int) -> Column:
    """c e x with that many digits, rounded half to even on the exact value, carried where rounding reaches ten."""

    def write(v: Decimal) -> str:
        c, e = format(v if v else Decimal(0), f".{digits - 1}e").split("e")
        return f"{c}e{int(e) if v else 0}"

    plain = F.lower(formatted(x, places_pattern(digits - 1) + "E0")) if digits <= JVM_DIGITS else None
    return exactly(x, write, plain, full_and_no_tie(x, digits))


def grouped(x: Column) -> Column:
    """Integers with commas between groups of three; null where x isn't whole."""
    return F.when(x == F.floor(x), F.format_number(x, 0))


def signed(x: Column, text: Column) -> Column:
    return F.when(x < 0, text).otherwise(F.concat(F.lit("+"), text))


def percentage(x: Column, places: int = 1) -> Column:
    return F.concat(fixed(x.cast("decimal(20,10)") * 100, places), F.lit("%"))


def boolean(x: Column, style: str) -> Column:
    yes, no = BOOLEAN_STYLES[style]
    return F.when(x, yes).when(~x, no)


def suffix(unit: str | None) -> str:
    return "" if not unit else unit if unit in ATTACHED_UNITS else f" {unit}"


def with_unit(text: Column, unit: str) -> Column:
    return F.concat(text, F.lit(suffix(unit)))


def forms(values: list[Column], form: str, unit: str | None = None) -> Column:
    """Accepted spellings of a composite value; ValueError for a form that doesn't take so many values."""
    least, most = FORM_VALUES.get(form, (1, 0))
    if not least <= len(values) <= most:
        raise ValueError(f"{form} of {len(values)} values")
    one = values[0]
    spelled = {
        "range": lambda: [F.concat(one, F.lit("–"), values[1])],
        "plus_minus": lambda: [F.concat(one, F.lit(sign), values[1]) for sign in (" ± ", " +/- ")],
        "interval": lambda: [F.concat(one, F.lit(" ["), F.concat_ws(", ", *values[1:]), F.lit("]"))],
        "tuple": lambda: [F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")"))],
    }.get(form, lambda: [one])()
    return F.array(*(F.concat(text, F.lit(suffix(unit))) for text in spelled))


def cell_type(text: Column) -> Column:
    """Type of a delimited cell: empty (and null) ones are null, leading zeros make text, inf and nan are floats."""
    return (
        F.when(text.isNull() | (text == ""), "null")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(CELL_INTEGER), "integer")
        .when(text.rlike(CELL_FLOAT), "float")
        .otherwise("text")
    )


def numeric_expression(token: Column) -> Column:
    """Whether a token presents a number: its first letter or digit, after brackets, signs of comparison and a sign, begins
    one, and the token as a whole is none of the NOT_NUMBERS."""
    text = F.regexp_replace(token, r"^\s+|\s+$", "")
    start = F.regexp_extract(text, NUMBER_START, 0) != ""
    return start & ~reduce(Column.__or__, (text.rlike(p) for p in NOT_NUMBERS.values()))


def preview(text: Column, n: int = 1024) -> Column:
    return F.struct(F.left(text, F.lit(n)).alias("head"), F.length(text).alias("length"), (F.length(text) > n).alias("cut"))


def canonical_json(pairs: dict[str, Column]) -> Column:
    """A JSON object with keys in order."""
    return F.to_json(F.struct(*(pairs[k].alias(k) for k in sorted(pairs))))


def exact_float(x: Column) -> Column:
    """The exact decimal expansion of a double, as text; null for null, NaN and infinities."""
    return exactly(x, lambda v: format(v, "f"))
