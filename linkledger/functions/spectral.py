"""Per-file spectrum functions on array columns: one row is one file, so none of these shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-30


def level(power: Column) -> Column:
    """dB of a squared magnitude, with the amplitude floor applied."""
    return 20.0 * F.log10(F.greatest(F.sqrt(power), F.lit(FLOOR)))


def bin_powers(re: list[Column], im: list[Column]) -> dict[str, Column]:
    """Squared magnitude per channel and in total."""
    p = {c: r * r + i * i for c, r, i in zip("XYZ", re, im)}
    p["NORM"] = p["X"] + p["Y"] + p["Z"]
    return p


def axis_of(freq: Column | str) -> Column:
    """Struct (f_min, f_max, step, bins) of a frequency array; the step is the median difference at 9 decimals.

    The step of a one-bin file is null.
    """
    f = F.col(freq) if isinstance(freq, str) else freq
    n = F.size(f)
    diffs = F.sort_array(differences(f))
    # The two middle elements; they coincide for an odd count.
    low = F.try_element_at(diffs, F.floor(n / 2).cast("int"))
    high = F.try_element_at(diffs, F.floor((n - 1) / 2 + 1).cast("int"))
    step = F.when(n > 1, F.round((low + high) / 2.0, 9))
    return F.struct(F.element_at(f, 1).alias("f_min"), F.element_at(f, -1).alias("f_max"),
                    step.alias("step"), n.alias("bins"))


def differences(freq: Column) -> Column:
    """Differences of neighbouring values."""
    n = F.size(freq)
    return F.when(n > 1, F.zip_with(F.slice(freq, F.lit(2), n - 1), F.slice(freq, F.lit(1), n - 1), lambda b, a: b - a)) \
        .otherwise(F.array().cast("array<double>"))


def evenly_spaced(freq: Column, step: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Do all differences equal the step within ``atol + rtol * step``."""
    return F.forall(differences(freq), lambda d: F.abs(d - step) <= F.lit(atol) + F.lit(rtol) * F.abs(step))
