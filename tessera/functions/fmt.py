"""Human-readable renderings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_mode(mode: Column, entry_type: Column) -> Column:
    """Ten characters as in a long listing, with set-id and sticky bits."""
    kind = F.lit("?")
    for name, c in (("file", "-"), ("dir", "d"), ("symlink", "l"), ("char", "c"), ("block", "b"), ("fifo", "p"), ("socket", "s")):
        kind = F.when(entry_type == name, c).otherwise(kind)

    def bit(mask: int) -> Column:
        return mode.bitwiseAND(F.lit(mask)) != 0

    def flag(mask: int, c: str) -> Column:
        return F.when(bit(mask), c).otherwise("-")

    def execute(mask: int, special: int, both: str, only: str) -> Column:
        return F.when(bit(special), F.when(bit(mask), both).otherwise(only)).otherwise(flag(mask, "x"))

    return F.concat(kind, flag(0o400, "r"), flag(0o200, "w"), execute(0o100, 0o4000, "s", "S"), flag(0o40, "r"), flag(0o20, "w"), execute(0o10, 0o2000, "s", "S"), flag(4, "r"), flag(2, "w"), execute(1, 0o1000, "t", "T"))


def _ladder(n: Column, units: tuple[str, ...], strict: bool, pattern: str) -> Column:
    value = n.cast("double")
    digits = int(pattern[2])
    # Sizes are exact multiples of powers of two, so rounding half to even agrees with C's printf.
    at = lambda i: F.bround(value / float(1024**i), digits)
    out = F.format_string(pattern, at(len(units) - 1), F.lit(units[-1]))
    for i in range(len(units) - 2, -1, -1):
        below = value / float(1024**i) <= 1024 if strict else value / float(1024**i) < 1024
        out = F.when(below, F.format_string(pattern, at(i), F.lit(units[i]))).otherwise(out)
    return out


def format_bytes(n: Column) -> Column:
    """Two decimals; the unit changes at 1024, up to TB."""
    return _ladder(n, ("B", "KB", "MB", "GB", "TB"), False, "%.2f %s")


def format_memory(n: Column) -> Column:
    """One decimal; the unit changes above 1024, up to GB."""
    return _ladder(n, ("B", "KB", "MB", "GB"), True, "%.1f %s")


def format_count(n: Column) -> Column:
    """Whole thousands and millions."""
    return F.when(n >= 1_000_000, F.concat((F.floor(n / 1_000_000)).cast("string"), F.lit("M"))).when(n >= 1000, F.concat((F.floor(n / 1000)).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def format_duration(seconds: float) -> str:
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f} us"
    if seconds < 1:
        return f"{seconds * 1e3:.2f} ms"
    if seconds < 60:
        return f"{seconds:.2f} s"
    return f"{int(seconds // 60)} m {seconds % 60:.1f} s"


def json_bytes(content: Column) -> Column:
    """Binary content as the inside of a JSON string: one escape per byte outside printable ASCII."""
    s = F.decode(content, "ISO-8859-1")
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, esc in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(esc))
    pieces = F.transform(F.split(s, ""), lambda c: F.when((F.ascii(c) >= 127) | ((F.ascii(c) < 32) & (F.length(c) > 0)), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c))
    return F.when(s.rlike(r"[^\x20-\x7E]"), F.array_join(pieces, "")).otherwise(s)
