"""Spectra: levels, axis checks, duplicates and the dense cache. Files stay one row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.spectral import axis_of, bin_powers, evenly_spaced, level
from linkledger.model import CHANNELS
from linkledger.operators.ordered import first_per_key


def spectral_levels(spectra: DataFrame) -> DataFrame:
    """Long table ``(point, bin, freq, X, Y, Z, NORM)`` in dB; unfolds each file in place."""
    names = ("freq", "re_x", "re_y", "re_z", "im_x", "im_y", "im_z")
    rows = spectra.select("point", F.posexplode(F.arrays_zip(*names)).alias("bin", "v"))
    powers = bin_powers([F.col(f"v.re_{a}") for a in "xyz"], [F.col(f"v.im_{a}") for a in "xyz"])
    return rows.select("point", "bin", F.col("v.freq").alias("freq"), *[level(powers[c]).alias(c) for c in CHANNELS])


def level_arrays(spectra: DataFrame) -> DataFrame:
    """``(point, freq, X, Y, Z, NORM)`` with one dB array per channel and file."""
    zipped = F.arrays_zip("re_x", "re_y", "re_z", "im_x", "im_y", "im_z")

    def channel(name: str) -> Column:
        return F.transform(zipped, lambda v: level(bin_powers([v[f"re_{a}"] for a in "xyz"], [v[f"im_{a}"] for a in "xyz"])[name]))

    return spectra.select("point", "freq", *[channel(c).alias(c) for c in CHANNELS])


def axis_summary(spectra: DataFrame) -> DataFrame:
    """Smallest and largest frequency, median step and bin count per file."""
    return spectra.select("point", "path", axis_of("freq").alias("a")).select("point", "path", "a.*")


def axis_consistency(spectra: DataFrame, order: str = "path") -> DataFrame:
    """Add ``axis_ok``: same axis as the first file by ``order`` and evenly spaced.

    The reference axis is one row, reduced with a partial aggregate and read as a scalar. Null steps (one-bin
    files) compare as equal.
    """
    with_axis = spectra.withColumn("__axis", axis_of("freq"))
    first = with_axis.agg(F.min_by("__axis", order).alias("axis")).scalar()
    same = F.lit(True)
    for part in ("f_min", "f_max", "step", "bins"):
        same = same & F.col(f"__axis.{part}").eqNullSafe(F.col(f"__ref.{part}"))
    regular = F.coalesce(evenly_spaced(F.col("freq"), F.col("__ref.step")), F.size("freq") == 1)
    return with_axis.withColumn("__ref", first).withColumn("axis_ok", same & regular).drop("__axis", "__ref")


def dedupe_points(points: DataFrame, keys: Sequence[str] = ("point",), order: Sequence[str] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """(kept, listed): the first row per key by ``order`` and the others with the winner's order values.

    ``order`` must tell rows of a key apart. The winner is a partial aggregate; the join back has one row per key
    on its side, so a key with very many copies can be split by skew handling.
    """
    winners = first_per_key(points, keys, order, order, "kept_").drop("kept_rows")
    joined = points.join(winners, list(keys))
    is_winner = F.lit(True)
    for c in order:
        is_winner = is_winner & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    kept = joined.where(is_winner).select(points.columns)
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    listed = joined.where(~is_winner).withColumn(
        "reason", F.concat(F.lit("point index "), name, F.lit(" already read from "), F.col(f"kept_{order[0]}").cast("string")))
    return kept, listed


def level_at_frequency(spectra: DataFrame, frequency: float, channel: str = "Z") -> DataFrame:
    """Level of a channel at the bin nearest to a frequency, the first of equally near ones. Looks at one bin per file."""
    distance = F.transform("freq", lambda f: F.abs(f - F.lit(frequency)))
    place = F.array_position(distance, F.array_min(distance)).cast("int")
    names = ("freq", "re_x", "re_y", "re_z", "im_x", "im_y", "im_z")
    at = spectra.select("point", place.alias("__at"), *names).select("point", *[F.element_at(n, F.col("__at")).alias(n) for n in names])
    power = bin_powers([F.col(f"re_{a}") for a in "xyz"], [F.col(f"im_{a}") for a in "xyz"])[channel]
    return at.select("point", level(power).alias("level_db"), "freq")


def level_range(levels: DataFrame, column: str = "level_db") -> DataFrame:
    """Smallest and largest level over all points."""
    return levels.agg(F.min(column).alias("min_db"), F.max(column).alias("max_db"))


def spectra_cache(arrays: DataFrame) -> DataFrame:
    """Dense cache rows ``(channel, point, freq0, step, count, db)``: dB rounded half even to 2 decimals."""
    axis = axis_of("freq")
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.transform(c, lambda x: F.bround(x, 2)).alias("db")) for c in CHANNELS])
    return (arrays.select("point", axis.alias("a"), entries.alias("es")).select("point", "a", F.explode("es").alias("e"))
            .select("e.channel", "point", F.col("a.f_min").alias("freq0"), "a.step", F.col("a.bins").alias("count"), "e.db"))
