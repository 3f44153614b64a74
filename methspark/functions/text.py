"""Text forms used by the sinks and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(value: Column) -> Column:
    """A number with six significant digits, half to even, without closing zeros, as C's %g prints it: with an exponent under 1e-4 and from 1e6 on."""
    size = F.abs(value.cast("double"))
    first = F.floor(F.log10(F.when(size > 0, size))).cast("int")
    # the exponent is that of the rounded number, which may be a power of ten more
    mantissa = F.bround(size / F.pow(F.lit(10.0), first), 5)
    exponent = F.when(mantissa >= 10, first + 1).otherwise(first)
    plain = F.lit("0")
    for decimals in range(0, 10):
        form = f"0.{'#' * decimals}" if decimals else "0"
        plain = F.when(exponent == 5 - decimals, F.call_function("format_number", F.bround(size, decimals), F.lit(form))).otherwise(plain)
    digits = F.call_function("format_number", F.when(mantissa >= 10, mantissa / 10).otherwise(mantissa), F.lit("0.#####"))
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    shown = F.when((exponent < -4) | (exponent > 5), F.concat(digits, F.lit("e"), power)).otherwise(plain)
    return F.when(value < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def data_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB, TB with two decimals."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(F.format_number(n / 1024.0**4, 2), F.lit(units[4]))
    for k in range(3, -1, -1):
        out = F.when(n < 1024.0 ** (k + 1), F.concat(F.format_number(n / 1024.0**k, 2), F.lit(units[k]))).otherwise(out)
    return out


def with_commas(n: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(n.cast("long"), 0)


def zero_padded(n: Column, width: int) -> Column:
    """A whole number, not negative, with zeros in front up to ``width`` digits; a longer one stays whole."""
    digits = n.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def parse_data_size(text: Column) -> Column:
    """The reverse: a number with an optional unit B, K, M, G or T (any case, a B may follow), as bytes."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).cast("double")
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]?)", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return (number * F.pow(F.lit(1024.0), power)).cast("long")


def split_filled(line: Column, separator: str = "\t") -> Column:
    """Fields of a line; empty ones are skipped."""
    return F.filter(F.split(line, separator), lambda x: x != "")
