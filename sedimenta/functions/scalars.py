"""Scalar expressions: times, elapsed texts, identifiers; built-ins only."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def nanoseconds(at: Column) -> Column:
    """UTC text with up to nine digits of a second as nanoseconds since 1970; never through a TIMESTAMP's microseconds."""
    date = F.datediff(F.to_date(F.substring(at, 1, 10)), F.lit("1970-01-01").cast("date")).cast("bigint")
    part = lambda i: F.substring(at, i, 2).cast("bigint")
    fraction = F.rpad(F.regexp_extract(at, r"\.(\d{1,9})Z$", 1), 9, "0").cast("bigint")
    return (date * 86400 + part(12) * 3600 + part(15) * 60 + part(18)) * 1_000_000_000 + F.coalesce(fraction, F.lit(0))


def instant(at: Column) -> Column:
    """The instant of a UTC text; NULL where it is none."""
    return F.try_to_timestamp(F.when(at.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z$"), at))


def elapsed(ns: Column) -> Column:
    """h m s of a length of time, the leading zero units left out."""
    s = F.floor(ns / 1_000_000_000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def boot_seconds(boot_id: Column) -> Column:
    return F.regexp_extract(boot_id, r"sec\s*=\s*(\d+)", 1).try_cast("bigint")


def same_boot(a: Column, b: Column, tolerance: int = 5) -> Column:
    """Boot times within the tolerance, or equal texts where they name none."""
    x, y = boot_seconds(a), boot_seconds(b)
    return F.coalesce(F.abs(x - y) <= tolerance, a.eqNullSafe(b))


def migrated_event_id(ordinal: Column, line: Column) -> Column:
    """v1:<ordinal, 16 digits>:sha256:<digest of the record's canonical line>."""
    return F.concat(F.lit("v1:"), F.lpad(ordinal.cast("string"), 16, "0"), F.lit(":sha256:"), F.sha2(line.cast("binary"), 256))


def phase_order(phase: Column) -> Column:
    """Sort key: dotted numbers before names, numbers by value."""
    numeric = phase.rlike(r"^\d+(?:\.\d+)*$")
    return F.struct((~numeric).cast("int").alias("named"), F.when(numeric, F.transform(F.split(phase, "[.]"), lambda x: x.try_cast("bigint"))).alias("numbers"), phase.alias("text"))


def rational_order(numerator: Column, denominator: Column) -> Column:
    """A sort key for ratios of bigints with denominators above 0: the whole part, then 36 digits of the fraction.

    Exact while denominators have up to 18 digits: two such ratios that differ do so by 10**-36 at least. The fraction is
    divided out in two steps of 18 digits, as one step would not fit a decimal.
    """
    n, d = numerator.cast("decimal(19,0)"), denominator.cast("decimal(19,0)")
    rest = F.pmod(n, d)
    shifted = rest.cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)")
    first = F.call_function("div", shifted, d)
    second = F.call_function("div", F.pmod(shifted, d.cast("decimal(38,0)")).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)"), d)
    return F.struct(F.call_function("div", n - rest, d).alias("whole"), first.alias("first"), second.alias("second"))
