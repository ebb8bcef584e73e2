"""What tile names, paths and ids say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The naming grammar.
CELL = r"(?<!\d)(3[23])_(\d{3})_(\d{4})(?!\d)"
CELL_JOINED = r"(?<!\d)(3[23])(\d{3})_(\d{4})(?!\d)"
DATE_TOKEN = r"(?<!\d)(\d{8})(?!\d)"
STATE = r"(?i)_([a-z]{2})_file"
STEM_ENDS = r"(_pred\.tif|\.tif|\.jp2)$"
UNDATED = "00000000"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _group(name: Column, pattern: str, i: int) -> Column:
    return none_if_empty(F.regexp_extract(name, pattern, i))


def cell_key(path: Column, pattern: str = CELL) -> Column:
    """struct(zone, easting_km, northing_km), null where the name has no cell."""
    name = file_name(path)
    part = lambda i: _group(name, pattern, i).cast("int")
    return F.when(name.rlike(pattern), F.struct(part(1).alias("zone"), part(2).alias("easting_km"), part(3).alias("northing_km")))


def date_from_name(path: Column) -> Column:
    """The first eight-digit token of the name that may be a date, else null. Days of a month aren't checked."""
    tokens = F.regexp_extract_all(file_name(path), F.lit(DATE_TOKEN), F.lit(1))
    part = lambda t, a, n: F.substring(t, a, n).cast("int")
    plausible = F.filter(tokens, lambda t: part(t, 1, 4).between(1990, 2099) & part(t, 5, 2).between(1, 12) & part(t, 7, 2).between(1, 31))
    return F.try_element_at(plausible, F.lit(1))


def tile_date(path: Column, year: Column | None = None) -> Column:
    """The date of the name, else <year>0000 for a four-digit year, else 00000000."""
    fallback = F.lit(UNDATED) if year is None else F.when(year.rlike(r"^\d{4}$"), F.concat(year, F.lit("0000"))).otherwise(F.lit(UNDATED))
    return F.coalesce(date_from_name(path), fallback)


def is_dated(date: Column) -> Column:
    return (date != UNDATED) & ~date.endswith("0000")


def date_from_stem(stem: Column) -> Column:
    """The first eight digits, unchecked, as YYYY-MM-DD; null without them."""
    d = _group(stem, r"\d{8}", 0)
    return F.when(d.isNotNull(), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def state_from_stem(stem: Column) -> Column:
    return F.upper(_group(stem, STATE, 1))


def tile_stem(name: Column) -> Column:
    return F.regexp_replace(name, STEM_ENDS, "")


def key_to_id(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(""))


def id_to_key(tile_id: Column) -> Column:
    n = F.length(tile_id)
    return F.concat_ws("_", F.substring(tile_id, 1, 2), F.substr(tile_id, F.lit(3), n - 6), F.right(tile_id, F.lit(4)))


def named_by_rule(key: Column, rule: Column) -> Column:
    """strip_zone_prefix drops a leading 32 of names longer than three characters; zone_dash puts - for the first _; keep keeps."""
    stripped = F.when(key.startswith("32") & (F.length(key) > 3), F.regexp_replace(key, "^32_?", "")).otherwise(key)
    return F.when(rule == "strip_zone_prefix", stripped).when(rule == "zone_dash", F.regexp_replace(key, "^([0-9]+)_", "$1-")).otherwise(key)


def cell_id(zone: Column, easting_km: Column, northing_km: Column) -> Column:
    """The 10 km cell of a 1 km tile."""
    hundred = lambda c: (F.floor(c / 10) * 100).cast("int")
    return F.format_string("UTM%d_E%d_N%d", zone.cast("int"), hundred(easting_km), hundred(northing_km))


def parse_cell_id(cell: Column) -> Column:
    """struct(epsg, x, y): the cell's reference system and lower left corner in metres; null if it isn't one."""
    pattern = r"^UTM(\d+)_E(\d+)_N(\d+)$"
    part = lambda i: _group(cell, pattern, i).cast("int")
    return F.when(cell.rlike(pattern), F.struct((part(1) + 25800).alias("epsg"), (part(2) * 100.0).alias("x"), (part(3) * 100.0).alias("y")))


def cell_folder(path: Column) -> Column:
    """The parent folder if it names a cell, else null."""
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when(parent.startswith("UTM"), parent)


def moved(path: Column, old: str, new: str) -> Column:
    """path with a leading old replaced by new."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def tile_of_point(x: Column, y: Column) -> Column:
    """struct(easting_km, northing_km) of the 1 km tile that holds a projected point."""
    return F.struct(F.floor(x / 1000).cast("int").alias("easting_km"), F.floor(y / 1000).cast("int").alias("northing_km"))


def backbone(path: Column) -> Column:
    b = _group(F.lower(path), r"segformer[_-]?b([0-5])", 1)
    return F.when(b.isNotNull(), F.concat(F.lit("b"), b))


def checksum(content: Column, limit: int | None = None) -> Column:
    """SHA-256, null above the limit of bytes."""
    value = F.sha2(content, 256)
    return value if limit is None else F.when(F.length(content) <= limit, value)


def clean_bin_label(label: Column) -> Column:
    return F.regexp_replace(label, r"^\s*B\d+\s*:\s*", "")


def as_flag(value: Column) -> Column:
    """Yes and no as written in tables; null and unknown words stay null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("true", "1", "1.0", "yes", "urban"), True).when(word.isin("false", "0", "0.0", "no", "rural", "non-urban"), False)


def human_size(n: Column) -> Column:
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    scaled = n / F.pow(F.lit(1024.0), unit)
    return F.when(unit == 0, F.format_string("%d B", n.cast("long"))).otherwise(F.format_string("%.1f %s", scaled, F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit)))


def window_of(text: Column, col: Column, row: Column, width: Column, height: Column) -> Column:
    """A window written as text "(c, r, w, h)", else from its four columns."""
    parts = F.split(F.regexp_replace(text, r"[()\[\] ]", ""), ",")
    item = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    names = ("col_off", "row_off", "width", "height")
    read = F.struct(*(item(i).alias(n) for i, n in enumerate(names)))
    given = F.struct(*(c.cast("int").alias(n) for c, n in zip((col, row, width, height), names, strict=True)))
    return F.when(F.size(parts) == 4, read).otherwise(given)
