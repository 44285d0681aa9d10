"""Text, JSON and datum strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT = 0.3048


def number_or_null(s: Column) -> Column:
    """A double; blanks and other text are null."""
    x = F.nullif(F.trim(s), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def frame_text(datum: Column) -> Column:
    return F.trim(F.replace(datum, F.lit("_"), F.lit(" ")))


def frame_epoch(datum: Column) -> Column:
    return F.when(F.contains(datum, F.lit("2011")), F.lit(2010.0))


#: In order of priority: the first text found in the datum decides.
_REALIZATIONS = [("2011", 6318), ("NSRS2007", 4759), ("2007", 4759), ("CORS96", 6783), ("FBN", 8860), ("HARN", 4152)]
_REALIZATIONS += [(str(year), 4152) for year in range(1991, 2000)] + [("1986", 4269)]
REALIZATIONS = [(token, f"EPSG:{code}") for token, code in _REALIZATIONS]


def datum_crs(datum: Column) -> Column:
    """The EPSG frame of an NAD83 realization; null (to be quarantined) for anything else."""
    plain = F.replace(F.replace(F.upper(datum), F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))
    out = F.when(~F.startswith(plain, F.lit("NAD83")), F.lit(None).cast("string"))
    for token, code in REALIZATIONS:
        out = out.when(F.contains(plain, F.lit(token)), F.lit(code))
    return out


def vertical_crs(datum: Column) -> Column:
    plain = F.replace(F.upper(datum), F.lit(" "), F.lit(""))
    return F.when(F.contains(plain, F.lit("NGVD29")), "EPSG:7968").when(F.contains(plain, F.lit("NAVD88")), "EPSG:5703")


def arcseconds(s: Column) -> Column:
    """Total arcseconds with a hemisphere letter, such as 130806.0700N, as signed degrees."""
    t = F.trim(s)
    size = F.length(t)
    value = F.substr(t, F.lit(1), size - 1).try_cast("double") / 3600
    return F.when(F.substr(t, size, F.lit(1)).isin("S", "W"), -value).otherwise(value)


def feet(s: Column) -> Column:
    return number_or_null(s) * FOOT


def azimuth_digits(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("double"))


def position_class(s: Column) -> Column:
    """surveyed for the surveyed vocabulary, else estimated (missing too)."""
    known = ["MILITARY", "NGS", "ARPTS CONTRACTOR", "3RD PARTY SURVEY"]
    return F.when(F.upper(F.trim(s)).isin(known), "surveyed").otherwise("estimated")


def clean_json(raw: Column) -> Column:
    """Bare NaN values as null, which would otherwise spoil the whole document."""
    return F.regexp_replace(raw, r"(:\s*)-?(?:NaN|Infinity)(\s*[,}])", "$1null$2")


def json_text(raw: Column, key: str) -> Column:
    """A field as trimmed text; blank, NaN, absent and invalid are null; 0 stays "0"."""
    value = F.trim(F.get_json_object(clean_json(raw), f"$.{key}"))
    return F.when((value != "") & ~F.lower(value).isin("nan", "none", "null"), value)


def json_truthy(raw: Column, key: str) -> Column:
    """A field, with everything falsy (0, false, blank) null."""
    value = json_text(raw, key)
    return F.when(~F.coalesce(value.try_cast("double") == 0, F.lit(False)) & (F.lower(value) != "false"), value)


EXPAND_KEYS = (
    "posSource", "posOrder", "posDatum", "vertSource", "vertOrder", "vertDatum", "monumentType", "stability", "setting",
    "condition", "stamping", "lastRecovered",
)


def expand_json(raw: Column, keys: tuple[str, ...] = EXPAND_KEYS, prefix: str = "ngs_") -> list[Column]:
    return [json_text(raw, key).alias(prefix + key) for key in keys]


def azimuth(true_az: Column, raw: Column) -> Column:
    """The column where it is a finite number, else the field of ``raw``; null where neither is."""
    own = true_az.try_cast("double")
    return F.coalesce(F.when(~F.isnan(own), own), json_text(raw, "true_az").try_cast("double"))


GEOIDS = {f"GEOID{year}": f"geoid{year}" for year in ("09", "06", "03", "99")} | {"GEOID18": "g2018", "GEOID12A": "g2012a", "GEOID12B": "g2012b"}


def geoid_fragment(name: Column) -> Column:
    """What a geoid model's grid files have in their names; null for unknown models."""
    known = F.create_map(*[F.lit(x) for item in sorted(GEOIDS.items()) for x in item])
    return F.try_element_at(known, F.replace(F.upper(name), F.lit(" "), F.lit("")))


def append_tag(transform_id: Column, tag: Column | str) -> Column:
    """Provenance tags joined by +; a missing id gives the tag alone."""
    return F.concat_ws("+", transform_id, F.lit(tag) if isinstance(tag, str) else tag)


def utm_label(code: Column) -> Column:
    """UTM zone of an EPSG number 326xx or 327xx, else null."""
    zone, half = code % 100, F.floor(code / 100)
    ok = half.isin(326, 327) & zone.between(1, 60)
    return F.when(ok, F.concat(F.lit("UTM "), zone.cast("int").cast("string"), F.when(half == 326, "N").otherwise("S")))


def nice_length(span: Column) -> Column:
    """The largest of 1, 2 or 5 times a power of ten within a fifth of a span; null unless the span is positive."""
    raw = F.when(span > 0, span) / 5
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return unit * F.when(raw >= 5 * unit, 5.0).when(raw >= 2 * unit, 2.0).otherwise(1.0)
