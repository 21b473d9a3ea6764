"""Column functions on identifiers, labels and literals. Row-local, built-in expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkledger.model import VOCABULARIES

# ---- Fixed values: patterns of the export header and of point literals.
HEADER_PATTERN = (r"Point Index:\t(\d+)\t\[x = ([-\d.eE+]+)\ty = ([-\d.eE+]+)\tz = ([-\d.eE+]+)\]")
POINT_PATTERN = (r"(?i)^\s*(?:<([^>]*)>\s*)?POINT\s*Z?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$")
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
SPECIAL_NUMBER_PATTERN = r"(?i)^\s*[-+]?(nan|inf|infinity)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_name(iri: Column | str) -> Column:
    """The tail after the last ``#``, else after the last ``/`` once trailing slashes are gone."""
    c = _col(iri)
    return (
        F.when(c.contains("#"), F.substring_index(c, "#", -1))
        .otherwise(F.substring_index(F.rtrim(c, F.lit("/")), "/", -1))
    )


def vocabulary(iri: Column | str, table: Mapping[str, tuple[str, str]] = VOCABULARIES) -> Column:
    """Struct (prefix, steward) of the first namespace in ``table`` that starts the IRI."""
    c = _col(iri)
    hit = None
    for prefix, (namespace, steward) in table.items():
        value = F.struct(F.lit(prefix).alias("prefix"), F.lit(steward).alias("steward"))
        test = c.startswith(namespace)
        hit = F.when(test, value) if hit is None else hit.when(test, value)
    other = F.struct(F.lit("other").alias("prefix"), F.lit("unknown").alias("steward"))
    return other if hit is None else hit.otherwise(other)


def keyword_value(name: Column | str, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of the longest keyword contained in the name, ignoring case; earlier entries win ties."""
    c = F.lower(_col(name))
    ranked = sorted(table.items(), key=lambda kv: -len(kv[0]))
    out = None
    for keyword, value in ranked:
        test = c.contains(keyword.lower())
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def parse_number(text: Column | str) -> Column:
    """Text to double; anything but a plain number, NaN or infinity is null."""
    c = _col(text)
    return F.when(c.rlike(NUMBER_PATTERN) | c.rlike(SPECIAL_NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_header(head: Column | str) -> Column:
    """Struct (point, x, y, z) from export header text, null when the header line is not there."""
    c = _col(head)

    def part(i: int, kind: str) -> Column:
        return F.regexp_extract(c, HEADER_PATTERN, i).try_cast(kind)

    fields = F.struct(part(1, "bigint").alias("point"), part(2, "double").alias("x"),
                      part(3, "double").alias("y"), part(4, "double").alias("z"))
    return F.when(c.rlike(HEADER_PATTERN), fields)


def parse_point(wkt: Column | str) -> Column:
    """Struct (frame, x, y, z) of a point literal; null when it does not match."""
    c = _col(wkt)
    frame = F.nullif(F.regexp_extract(c, POINT_PATTERN, 1), F.lit(""))
    axes = [F.regexp_extract(c, POINT_PATTERN, i).try_cast("double").alias(a) for i, a in ((2, "x"), (3, "y"), (4, "z"))]
    return F.when(c.rlike(POINT_PATTERN), F.struct(frame.alias("frame"), *axes))


def format_point(frame: Column | str, x: Column | str, y: Column | str, z: Column | str) -> Column:
    """Point literal with the frame IRI in front."""
    a, b, c = (_col(v).cast("double").cast("string") for v in (x, y, z))
    return F.concat(F.lit("<"), _col(frame), F.lit("> POINT Z ("), a, F.lit(" "), b, F.lit(" "), c, F.lit(")"))


def to_metres(value: Column | str, unit: Column | str) -> Column:
    """Quantity in metres: ``MMT`` is divided by 1000, other units stay, non-numbers are null."""
    number = parse_number(_col(value).cast("string"))
    return F.when(_col(unit) == "MMT", number / 1000.0).otherwise(number)


def year_range(text: Column | str) -> Column:
    """Struct (first_year, last_year) of ``2024/2025`` or ``2024``."""
    parts = F.split(_col(text), "/")
    return F.struct(F.trim(F.try_element_at(parts, F.lit(1))).try_cast("int").alias("first_year"),
                    F.trim(F.try_element_at(parts, F.lit(-1))).try_cast("int").alias("last_year"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_gate(name: Column | str, media_type: Column | str | None = None) -> Column:
    """``accepted``, ``rejected: file type`` or ``rejected: media type`` for a payload file."""
    ending = F.lower(F.regexp_extract(_col(name), r"\.([^./?#]+)$", 1))
    out = F.when(~ending.isin("txt", "csv"), F.lit("rejected: file type"))
    if media_type is not None:
        expected = F.when(ending == "csv", F.lit("text/csv")).otherwise(F.lit("text/tab-separated-values"))
        plain = F.lit("text/plain")
        out = out.when(~(_col(media_type).endswith(expected) | _col(media_type).endswith(plain)), F.lit("rejected: media type"))
    return out.otherwise(F.lit("accepted"))


def identifier_kind(value: Column | str, prototype_host: str = "example.org") -> Column:
    """DOI / HTTP / URN / PROTOTYPE / LOCAL by syntax only; a kind is never promoted to a better one."""
    c = F.trim(_col(value))
    low = F.lower(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit("NONE"))
        .when(low.rlike(r"^(https?://(dx\.)?doi\.org/|doi:)?10\.\d{4,9}/\S+$"), F.lit("DOI"))
        .when(low.rlike(r"^urn:[a-z0-9][a-z0-9-]{0,31}:\S+$"), F.lit("URN"))
        .when(low.rlike(r"^https?://([^/\s]*\.)?" + prototype_host.replace(".", r"\.") + r"([/:?#]|$)"), F.lit("PROTOTYPE"))
        .when(low.rlike(r"^https?://[^/\s]+"), F.lit("HTTP"))
        .otherwise(F.lit("LOCAL"))
    )


def display_name(name: Column | str, material: Column | str, gid: Column | str, kind: Column | str | None = None) -> Column:
    """A generic part name gives way to the material label, unless the target ``kind`` is single; without a name the id is shown."""
    generic = _col(name).isNull() | (_col(name) == "") | _col(name).rlike(r"^(Part|Wall|Basic Wall)\W*:?\s*\d*$")
    label = F.nullif(_col(material), F.lit(""))
    if kind is not None:
        label = F.when(~_col(kind).eqNullSafe(F.lit("single")), label)
    return F.coalesce(F.when(generic & label.isNotNull(), label).otherwise(F.nullif(_col(name), F.lit(""))), _col(gid))


def fill_placeholder(column: Column | str, dtype, tag: Column, mark: str = "{point}") -> Column:
    """Replace ``mark`` in every string below a column of any nested type."""
    kind = dtype.typeName()
    c = _col(column)
    if kind == "string":
        return F.replace(c, F.lit(mark), tag)
    if kind == "array":
        return F.transform(c, lambda item: fill_placeholder(item, dtype.elementType, tag, mark))
    if kind == "map":
        return F.transform_values(c, lambda _, v: fill_placeholder(v, dtype.valueType, tag, mark))
    if kind == "struct":
        filled = F.struct(*[fill_placeholder(c[f.name], f.dataType, tag, mark).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), filled)
    return c
