"""Facts of a lab form: found by label in its lines, given a status, merged into flat records.

A form is one row with its non-blank lines as an array, so every step is row-local.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.text import year_range

STORED, READ_ONLY, NOT_FOUND = "stored in the record", "read, not stored yet", "not found in the form"

# ---- Fixed values: fact key -> (label on the form, status of a found value).
CATALOG = {
    "year": ("Datum der Messung", STORED),
    "location": ("Ort der Messung", STORED),
    "test_rig": ("Prüfstand", STORED),
    "data_origin": ("Herkunftsart der Daten", READ_ONLY),
    "source": ("Quelle", READ_ONLY),
    "responsible": ("Ansprechperson / Autor", STORED),
    "wall_size": ("Maße der Wand", STORED),
    "temperature": ("Raumtemperatur", STORED),
    "humidity": ("Luftfeuchtigkeit", STORED),
    "pressure": ("Luftdruck", STORED),
    "excitation": ("Art der Anregung", STORED),
    "sketch": ("Skizze", STORED),
    "layers": ("Aufbau der Wand", READ_ONLY),
    "area_mass": ("Flächenbezogene Masse", READ_ONLY),
    "room_volumes": ("Volumen der Messräume", READ_ONLY),
}
# ---- Fixed values: name listed as absent when a fact is missing, in listing order.
ABSENT_NAMES = {"wall_size": "wallDimensions", "test_rig": "testRig", "location": "location", "responsible": "responsiblePerson",
                "temperature": "temperature", "humidity": "humidity", "pressure": "pressure", "excitation": "excitation",
                "sketch": "setupSketch", "data_origin": "dataOrigin"}


def form_lines(text: Column | str) -> Column:
    """Trimmed non-blank lines of a text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), F.trim), lambda x: x != "")


def value_after(lines: Column, label: str) -> Column:
    """Text after ``->`` on the first line that matches the label, else the next line; empty text if there is none."""
    place = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)" + label)), True).cast("int")
    line = F.try_element_at(lines, F.when(place > 0, place))
    following = F.try_element_at(lines, F.when(place > 0, place + 1))
    tail = F.trim(F.regexp_extract(line, r"(?s)^.*?->(.*)$", 1))
    next_value = F.when(following.startswith("->"), F.trim(F.substr(following, F.lit(3)))).otherwise(following)
    return F.coalesce(F.when(tail != "", tail).otherwise(next_value), F.lit(""))


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


# ---- Fixed values: the labels of the lab form, by fact. ``after``: what follows the label on its line or the next; ``measure``:
# the number behind the label's arrow; the others are patterns over the whole form.
FORM_LABELS = {
    "year": ("years", r"(?i)Datum der Messung[^\n]*?->\s*(\d{4})(?:\s*/\s*(\d{4}))?"),
    "location": ("after", "^Ort der Messung"),
    "test_rig": ("after", "^Prüfstand"),
    "data_origin": ("after", "Herkunftsart der Daten"),
    "source": ("after", "^Quelle"),
    "responsible": ("after", "Ansprechperson|Verantwortlicher"),
    "wall_size": ("size", r"B\s*\*\s*H\s*=\s*([\d,\.]+)\s*m\s*\*\s*([\d,\.]+)\s*m"),
    "temperature": ("measure", "Raumtemperatur"),
    "humidity": ("measure", "Luftfeuchtigkeit"),
    "pressure": ("measure", "Luftdruck"),
    "excitation": ("before_position", "^Art der Anregung"),
    "sketch": ("group", r"(?i)Skizze:\s*(\S+\.(?:png|jpe?g))"),
    "layers": ("trimmed", r"Schichten:\s*([^\n]+)"),
    "area_mass": ("mass", r"(?m)=\s*([\d,\.]+)\s*kg/m2\s*$"),
    "room_volumes": ("rooms", r"((?:Senderaum|Empfangsraum):\s*[^\n]+)"),
}
DEPTH_MM = r"Dicke\s*=\s*([\d,\.]+)\s*mm"
POSITION = r"\s*[–-]\s*Position der Anregung.*$"


def fact_values(lines: Column | str) -> dict[str, Column]:
    """One text column per fact, null when the form does not give it."""
    ls = F.col(lines) if isinstance(lines, str) else lines
    full = F.array_join(ls, "\n")

    def size(pattern: str) -> Column:
        numbers = [_number(F.regexp_extract(full, pattern, i)) for i in (1, 2)] + [_number(_group(full, DEPTH_MM))]
        named = [n.alias(name) for n, name in zip(numbers, ("width_m", "height_m", "depth_mm"))]
        return F.when(full.rlike(pattern), F.to_json(F.struct(*named)))

    def rooms(pattern: str) -> Column:
        found = F.regexp_extract_all(full, F.lit(pattern), F.lit(1))
        return F.array_join(F.transform(found, lambda r: F.regexp_replace(r, r":\s*", ": ")), "; ")

    kinds = {
        "after": lambda label: value_after(ls, label),
        "before_position": lambda label: F.regexp_replace(value_after(ls, label), POSITION, ""),
        "measure": lambda label: _number(_group(full, rf"(?i){label}\s*->\s*([\d,\.]+)")).cast("string"),
        "years": lambda pattern: F.concat_ws("/", _group(full, pattern, 1), _group(full, pattern, 2)),
        "group": lambda pattern: _group(full, pattern),
        "trimmed": lambda pattern: F.trim(_group(full, pattern)),
        "mass": lambda pattern: F.concat(_group(full, pattern), F.lit(" kg/m²")),
        "size": size, "rooms": rooms,
    }
    return {fact: kinds[kind](value) for fact, (kind, value) in FORM_LABELS.items()}


def wide_facts(forms: DataFrame, lines: str = "lines") -> DataFrame:
    """``(doc_id, facts MAP)`` with only the facts that were found."""
    values = fact_values(lines)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(v, F.lit("")).alias("value")) for k, v in values.items()])
    return forms.select("doc_id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("facts"))


def extract_facts(forms: DataFrame, catalog: Mapping[str, tuple[str, str]] = CATALOG, lines: str = "lines") -> DataFrame:
    """All catalog facts of every form as ``(doc_id, key, label, value, status)``, missing ones included."""
    return with_fact_status(wide_facts(forms, lines), catalog)


def with_fact_status(found: DataFrame, catalog: Mapping[str, tuple[str, str]] = CATALOG) -> DataFrame:
    """One row per document and catalog fact from ``(doc_id, facts MAP)``; blank or missing values are not found."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(status).alias("if_found")) for k, (label, status) in catalog.items()])
    each = found.select("doc_id", "facts", F.explode(rows).alias("c"))
    value = F.nullif(F.trim(F.try_element_at("facts", F.col("c.key"))), F.lit(""))
    return each.select("doc_id", "c.key", "c.label", value.alias("value"),
                       F.when(value.isNotNull(), F.col("c.if_found")).otherwise(NOT_FOUND).alias("status"))


def absent_names(facts: Column | str, names: Mapping[str, str] = ABSENT_NAMES) -> Column:
    """Names to list as absent for the facts a map lacks."""
    m = F.col(facts) if isinstance(facts, str) else facts
    return F.array_compact(F.array(*[F.when(F.try_element_at(m, F.lit(k)).isNull(), F.lit(v)) for k, v in names.items()]))


def missing_field_union(*lists: Column) -> Column:
    """Ordered union of name lists, each name once at its first place."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists]))


def source_conflict(file_names: Column | str, excitation: Column | str) -> Column:
    """``unresolved`` when a file name says shaker but the form says loudspeaker or air, or when nothing is stated."""
    names = F.col(file_names) if isinstance(file_names, str) else file_names
    said = F.col(excitation) if isinstance(excitation, str) else excitation
    shaker = F.coalesce(F.exists(names, lambda n: F.lower(n).contains("shaker")), F.lit(False))
    conflict = shaker & said.rlike("(?i)lautsprecher|luft")
    return F.when(said.isNull() | (said == "") | conflict, "unresolved").otherwise("stated in the lab form")


def merge_facts(flat: DataFrame, facts: DataFrame, key: str = "record_id", file_names: Column | None = None) -> DataFrame:
    """Flat records with lineage, procedure and completeness taken from the facts map.

    A missing fact clears the old value and adds its name to the absent list; nothing older is carried over. The wall's
    size, the sketch and the notes on the period and on a conflict of sources are further fields of the lineage.
    """
    joined = flat.join(facts.select(F.col("doc_id").alias(key), "facts"), key, "left")
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    years = year_range(fact("year"))
    conditions = {"temperature": ("air temperature", "unit:DEG_C"), "humidity": ("relative humidity", "unit:PERCENT"), "pressure": ("air pressure", "unit:HectoPA")}
    measured = F.array_compact(F.array(*[
        F.when(fact(k).isNotNull(), F.struct(F.lit(label).alias("label"), fact(k).try_cast("double").alias("value"), F.lit(unit).alias("unit")))
        for k, (label, unit) in conditions.items()]))
    names = F.array(F.col("integrity.title")) if file_names is None else file_names
    lineage = F.struct(fact("test_rig").alias("rig"), fact("location").alias("location"), years["first_year"].cast("string").alias("year_start"),
                       years["last_year"].cast("string").alias("year_end"), F.when(F.size(measured) > 0, measured).alias("environment"),
                       F.coalesce(fact("responsible"), F.lit("unknown")).alias("agent"),
                       *[F.get_json_object(fact("wall_size"), f"$.{c}").try_cast("double").alias(f"wall_{c}") for c in ("width_m", "height_m", "depth_mm")],
                       F.concat(F.lit("data/"), fact("sketch")).alias("sketch"),
                       F.when(years["first_year"].isNotNull(), F.concat(F.lit("Reported as "), fact("year"), F.lit(" in the lab form; exact date unknown"))).alias("period_note"),
                       F.when(fact("excitation").isNotNull() & (source_conflict(names, fact("excitation")) == "unresolved"),
                              F.lit("the file name says 'Shaker', the form says loudspeaker")).alias("conflict_note"))
    measurement = F.col("measurement").withField("procedure_source", F.coalesce(fact("excitation"), F.lit("not stated"))) \
        .withField("procedure_status", source_conflict(names, fact("excitation")))
    absent = missing_field_union(F.col("completeness.absent"), absent_names(F.coalesce("facts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return joined.withColumns({"lineage": lineage, "measurement": measurement,
                               "completeness": F.col("completeness").withField("absent", absent)}).drop("facts")


def resolve_context(files: DataFrame, shared: Mapping[str, str], per_file: DataFrame, overrides: DataFrame, fields: list[str],
                    key: str = "file") -> DataFrame:
    """Per file and field: non-empty override, else per-file value, else shared value, else ``unknown``."""
    p = per_file.select(key, *[F.col(f).alias(f"p_{f}") for f in fields])
    o = overrides.select(key, *[F.col(f).alias(f"o_{f}") for f in fields])
    joined = files.join(p, key, "left").join(o, key, "left")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    cells = [F.coalesce(full(F.col(f"o_{f}")), full(F.col(f"p_{f}")), F.nullif(F.lit(shared.get(f, "")), F.lit("")), F.lit("unknown")).alias(f) for f in fields]
    return joined.select(*files.columns, *cells)
