"""Frames, extents and display positions as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAPPING = "IFC_X=Acoustic_X; IFC_Y=Acoustic_Z; IFC_Z=Acoustic_Y"

# ---- Fixed values: status texts of a frame by where it came from.
FRAME_STATUS = {
    "PSET": "declared by model; not confirmed by lab",
    "EXPLICIT": "declared in project.json; not confirmed by lab",
    "DEFAULT": "ASSUMED default; nobody declared it",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apply_frame(matrix: Column | str | Sequence[Sequence[float]], x, y, z) -> Column:
    """Struct (x, y, z) of a point moved by a 3x4 or 4x4 row-major matrix (a literal or an array column)."""
    axes = [_col(c) for c in (x, y, z)]

    def cell(i: int, j: int) -> Column:
        if isinstance(matrix, (Column, str)):
            return _col(matrix)[i * 4 + j]
        row = matrix[i]
        return F.lit(float(row[j]) if j < len(row) else 0.0)

    def line(i: int) -> Column:
        return cell(i, 0) * axes[0] + cell(i, 1) * axes[1] + cell(i, 2) * axes[2] + cell(i, 3)

    return F.struct(line(0).alias("x"), line(1).alias("y"), line(2).alias("z"))


def mapped_axis(mapping: Column | str, target: str) -> Column:
    """Scan axis a declared mapping ``IFC_X=Acoustic_X; ...`` gives for a model axis; empty if it names none."""
    return F.regexp_extract(_col(mapping), rf"(?s)^.*IFC_{target}=Acoustic_([XYZ])", 1)


def axis_matrix(sources: dict[str, Column], into: Column) -> Column:
    """16 cells of the axis assignment. Only where model Y comes from scan Z the sign depends on ``into`` (the wall)."""
    def cell(target: str, source: str) -> Column:
        value = F.when(into, 1.0).otherwise(-1.0) if (target, source) == ("Y", "Z") else F.lit(1.0)
        return F.when(sources[target] == source, value).otherwise(0.0)

    cells = [cell(t, s) if s else F.lit(0.0) for t in "XYZ" for s in ("X", "Y", "Z", "")]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def with_frame(df: DataFrame, mapping: Column, z_axis_note: Column, explicit_matrix: Column, name: str = "frame") -> DataFrame:
    """Add struct (kind, status, mapping, matrix, normal_sign, low_face): declared mapping, else explicit matrix, else the default.

    A declared mapping that does not name all three axes is kind ``UNREADABLE`` with a null matrix: it is not
    replaced silently.
    """
    into = F.coalesce(F.lower(z_axis_note).contains("into the wall"), F.lit(False))
    staged = df.withColumns({"__declared": F.nullif(mapping, F.lit("")), "__given": explicit_matrix, "__into": into})
    staged = staged.withColumns({f"__{t}": mapped_axis("__declared", t) for t in "XYZ"})
    declared = F.col("__declared").isNotNull()
    complete = (F.col("__X") != "") & (F.col("__Y") != "") & (F.col("__Z") != "")
    kind = (F.when(declared & ~complete, "UNREADABLE").when(declared, "PSET").when(F.col("__given").isNotNull(), "EXPLICIT").otherwise("DEFAULT"))
    default = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    cells = (F.when(declared & complete, axis_matrix({t: F.col(f"__{t}") for t in "XYZ"}, F.col("__into")))
             .when(~declared, F.coalesce("__given", F.array(*[F.lit(v) for v in default]))))
    staged = staged.withColumns({"__kind": kind, "__cells": cells})
    # The face normal follows the largest cell of the model Y row, the first of equals.
    row = [F.col("__cells")[i] for i in (4, 5, 6)]
    size = [F.abs(c) for c in row]
    lead = (F.when((size[0] >= size[1]) & (size[0] >= size[2]), row[0]).when(size[1] >= size[2], row[1]).otherwise(row[2]))
    staged = staged.withColumn("__lead", F.when(size[0] + size[1] + size[2] == 0, 1.0).otherwise(lead))
    status = F.create_map(*[F.lit(v) for pair in FRAME_STATUS.items() for v in pair])
    frame = F.struct(
        F.col("__kind").alias("kind"), F.coalesce(F.element_at(status, F.col("__kind")), F.lit("mapping cannot be read")).alias("status"),
        F.coalesce("__declared", F.to_json("__given"), F.lit(DEFAULT_MAPPING)).alias("mapping"), F.col("__cells").alias("matrix"),
        F.col("__lead").cast("int").alias("normal_sign"), (F.col("__lead") >= 0).alias("low_face"))
    return staged.withColumn(name, frame).select(*df.columns, name)


def inside_extent(x, z, lo_x, hi_x, lo_z, hi_z, tol: float = 1e-9) -> Column:
    """Is the point within the extent in x and z."""
    return _col(x).between(_col(lo_x) - tol, _col(hi_x) + tol) & _col(z).between(_col(lo_z) - tol, _col(hi_z) + tol)


def face_position(low_face, face_lo, face_hi) -> Column:
    """Depth of the scanned face: the low one for a normal that does not point down the axis."""
    return F.when(_col(low_face), _col(face_lo)).otherwise(_col(face_hi))


def display_position(x, z, face_y, sign, gap: float = 0.001) -> Column:
    """Struct (x, y, z) of a point drawn just off the scanned face."""
    return F.struct(_col(x).alias("x"), (_col(face_y) - gap * _col(sign)).alias("y"), _col(z).alias("z"))
