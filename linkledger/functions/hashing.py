"""Checksums and element fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHOD = ("sha256 of id, class, material label, bbox min and bbox max, joined by a vertical bar; "
          "world coordinates in metres, the exact binary value rounded to 3 decimals, without negative zero")
#: Splits a double into two halves whose products with small numbers are exact.
SPLITTER = float((1 << 27) + 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rounds_down(value: Column) -> Column:
    """For a double whose shortest text is a tie at 3 decimals: does its exact value round to the smaller size?

    The tie is k / 2000 for an odd k. The exact product with 2000 is taken in two parts, so the sign of what lies
    beyond k is exact; a true tie goes to the even digit.
    """
    x = F.abs(value)
    high = x * SPLITTER - (x * SPLITTER - x)
    product = x * 2000.0
    error = (high * 2000.0 - product) + (x - high) * 2000.0
    k = F.rint(product)
    beyond = (product - k) + error
    return (beyond < 0) | ((beyond == 0) & (F.pmod((k - 1) / 2, F.lit(2.0)) == 0))


def fixed3(value: Column | str, rounding: str = "binary") -> Column:
    """Number with 3 decimals and no negative zero; null for null, NaN and numbers of 17 digits or more.

    ``binary`` rounds the exact binary value, as formatting a double does; ``text`` rounds its shortest decimal text half
    up. They differ only where that text is a tie, so one is the other with ties corrected. Both stay in the JVM.
    """
    c = _col(value).cast("double")
    rounded = c.try_cast("decimal(20,3)")
    if rounding == "text":
        return rounded.cast("string")
    exact, four = c.try_cast("decimal(38,20)"), c.try_cast("decimal(24,4)")
    tie = (exact == four) & (F.pmod(F.abs(four) * 10000, F.lit(10)) == 5)
    step = F.lit("0.001").cast("decimal(20,3)")
    toward_zero = F.when(c < 0, rounded + step).otherwise(rounded - step).cast("decimal(20,3)")
    return F.when(F.coalesce(tie, F.lit(False)) & _rounds_down(c), toward_zero).otherwise(rounded).cast("string")


def fingerprint(gid, cls, material, lo: list, hi: list, rounding: str = "binary") -> Column:
    """SHA-256 over identity, class, material and bounding box; a missing material counts as ``None``.

    Null, which means unchecked, if the identity, the class or a coordinate is missing or no number.
    """
    corners = [c for side in (lo, hi) for c in (F.lit("|"), *[x for i, v in enumerate(side) for x in ((F.lit(","),) if i else ()) + (fixed3(v, rounding),)])]
    return F.sha2(F.concat(_col(gid), F.lit("|"), _col(cls), F.lit("|"), F.coalesce(_col(material), F.lit("None")), *corners), 256)


def material_label(set_name: Column | str, layers: Column | str, fallback: Column | str | None = None) -> Column:
    """``set[name@thickness/...]`` from an ordered array of (name, thickness) structs, else the material name."""
    items = F.transform(_col(layers), lambda x: F.concat_ws("@", x["name"], x["thickness"].cast("string")))
    label = F.concat(_col(set_name), F.lit("["), F.array_join(items, "/"), F.lit("]"))
    plain = _col(fallback) if fallback is not None else F.lit(None).cast("string")
    return F.when(F.size(_col(layers)) > 0, label).otherwise(plain)
