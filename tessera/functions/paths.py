"""Path and mode expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_MODE, DIR_MODE, LINK_MODE = 0o100644, 0o040755, 0o120777


def clean_name(path: Column) -> Column:
    """A leading ``./`` and trailing slashes are dropped."""
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"/+$", "")


def strip_components(path: Column, n: int) -> Column:
    """The path behind its n-th slash; null if there are fewer or nothing is left."""
    if n <= 0:
        return path
    parts = F.split(path, "/")
    rest = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when((F.size(parts) > n) & (rest != ""), rest)


def join_path(a: Column, b: Column) -> Column:
    """Plain joining; nothing is normalised."""
    return F.when(a == "", b).otherwise(F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), b))


def segments(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_safe(path: Column) -> Column:
    """False for absolute paths and for those with ``..`` segments, which would leave the output folder."""
    return ~(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))


def plain_name(name: Column, entry_type: Column) -> Column:
    """Directories end with a slash in plain listings."""
    return F.when((entry_type == "dir") & ~name.endswith("/"), F.concat(name, F.lit("/"))).otherwise(name)


def type_of_mode(mode: Column) -> Column:
    kind = F.shiftright(mode, 12).bitwiseAND(15)
    out = F.lit("unknown")
    for code, name in ((0o10, "file"), (0o4, "dir"), (0o12, "symlink"), (0o2, "char"), (0o6, "block"), (0o1, "fifo"), (0o14, "socket")):
        out = F.when(kind == code, name).otherwise(out)
    return out


def default_mode(entry_type: Column) -> Column:
    return F.when(entry_type == "dir", DIR_MODE).when(entry_type == "symlink", LINK_MODE).otherwise(FILE_MODE).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes shared at the start of two strings, as a number of whole bytes."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    n = F.least(F.length(x), F.length(y)) / 2
    places = F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    differing = F.filter(places, lambda i: F.substring(x, i * 2 + 1, 2) != F.substring(y, i * 2 + 1, 2))
    return F.coalesce(F.when(F.size(differing) > 0, F.element_at(differing, 1)), n.cast("int"))
