"""File names, dates and masks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dapple.schema import FIRST_YEAR, LAST_YEAR


def _int(c: Column) -> Column:
    return c.try_cast("int")


def normalize_mmyy(text: Column) -> Column:
    """``MMYY``, or five digits with a slip of the third, as ``YYYY-MM``; anything else null."""
    digits = text.rlike("^[0-9]+$")
    four = F.when(F.length(text) == 5, F.concat(F.substring(text, 1, 2), F.substring(text, 4, 2))).otherwise(text)
    month, year = _int(F.substring(four, 1, 2)), _int(F.substring(four, 3, 2)) + 2000
    fine = digits & (F.length(four) == 4) & month.between(1, 12) & year.between(FIRST_YEAR, LAST_YEAR)
    return F.when(fine, F.format_string("%04d-%02d", year, month))


def tk_filename(name: Column) -> Column:
    """``<id>-<session>-<mmyy>.jpg`` -> struct(id, session, date); null fields where it does not match."""
    pattern = r"(?i)^([0-9]+)-([0-9]+)-([0-9]+)\.jpe?g$"
    part = [F.regexp_extract(name, pattern, k) for k in (1, 2, 3)]
    fits = name.rlike(pattern)
    return F.struct(
        F.when(fits, _int(part[0])).alias("id"),
        F.when(fits, F.format_string("%02d", _int(part[1]))).alias("session"),
        F.when(fits, normalize_mmyy(part[2])).alias("date"),
    )


def tk_subfolder_date(name: Column) -> Column:
    """The date of the last run of four digits."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]{4})"), F.lit(1))
    return F.when(F.size(runs) > 0, normalize_mmyy(F.element_at(runs, -1)))


def pw_filename(name: Column) -> Column:
    """``<id>-<session> (<shot>).jpg`` -> struct(id, session, shot)."""
    pattern = r"(?i)^([0-9]+)-([0-9]+)\s*\(([0-9]+)\)\.jpe?g$"
    fits = name.rlike(pattern)
    id_, session, shot = (F.when(fits, _int(F.regexp_extract(name, pattern, k))) for k in (1, 2, 3))
    return F.struct(id_.alias("id"), F.format_string("%02d", session).alias("session"), shot.alias("shot"))


def lab_stem(stem: Column) -> Column:
    """``<id>[.<variant>]`` -> struct(id, variant); null id for other stems (the row is then skipped)."""
    parts = F.split(stem, r"\.")
    return F.struct(_int(F.element_at(parts, 1)).alias("id"), F.when(F.size(parts) > 1, _int(F.get(parts, F.lit(1)))).otherwise(0).alias("variant"))


def lab_date(name: Column) -> Column:
    """``D.M.YYYY``, a date of the calendar within the years covered, as ISO; else null."""
    pattern = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$"
    d, m, y = (_int(F.regexp_extract(name, pattern, k)) for k in (1, 2, 3))
    day = F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.when(name.rlike(pattern) & y.between(FIRST_YEAR, LAST_YEAR), F.date_format(day, "yyyy-MM-dd"))


def rle_prefix(text: Column) -> Column:
    """``HxW:body`` -> struct(h, w, mask_empty); anything else is an empty mask."""
    pattern = r"^\s*([0-9]+)x([0-9]+):(.*)$"
    fits = F.coalesce(text.rlike(pattern), F.lit(False))
    h, w = (F.when(fits, _int(F.regexp_extract(text, pattern, k))) for k in (1, 2))
    body = F.trim(F.regexp_extract(text, pattern, 3))
    return F.struct(h.alias("h"), w.alias("w"), F.when(fits, body == "").otherwise(True).alias("mask_empty"))


def namespaced_id(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.format_string("%03d", number.cast("int")))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` of a URL-encoded file path."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/*", "/")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))


def note(old: Column, new: Column) -> Column:
    """Append a note with ``; ``."""
    return F.concat_ws("; ", F.when(F.coalesce(old, F.lit("")) != "", old), new)


def survivor_parts(path: Column) -> Column:
    """What ranks the copies of one file: bare digit in a laboratory folder, generic name, depth, base name."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.struct(
        base.alias("base"),
        stem.rlike("^[0-9]$").alias("single_digit"),
        F.upper(stem).startswith("IMG_").alias("generic"),
        F.contains(stem, F.lit(".")).alias("variant"),
        (F.size(F.split(path, "/")) - 1).alias("depth"),
    )
