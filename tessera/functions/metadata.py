"""Slide metadata rules as column functions: resolution, magnification, vendor and the like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in order of trust.
#: Plausible microns per pixel, both ends included.
MPP_RANGE = (0.1, 10.0)
#: Properties that hold microns per pixel, and those whose text may tell them.
MPP_KEYS = ("openslide.mpp-x", "openslide.mpp-y", "openslide.mirax.MPP", "aperio.MPP", "hamamatsu.XResolution")
TEXT_KEYS = ("openslide.comment", "tiff.ImageDescription")
MAG_KEYS = ("aperio.AppMag", "openslide.objective-power", "hamamatsu.SourceLens")
#: Upper bounds of microns per pixel for each magnification.
MAG_STEPS = ((0.16, 80), (0.2, 60), (0.3, 40), (0.6, 20), (1.2, 10), (2.4, 5))
#: Exact keys of an attribute; its own name is the substring that is tried next.
ATTRIBUTE_KEYS = {
    "vendor": ("openslide.vendor", "tiff.make", "tiff.model", "hamamatsu.model", "leica.scanner"),
    "institution": ("tiff.institution", "tiff.institutionname", "aperio.institution", "openslide.institution", "dicom.institutionname"),
    "stain": ("aperio.stain", "aperio.staindescription", "openslide.stain", "hamamatsu.stain", "philips.stain"),
}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A plain decimal number as a double, or null; no hexadecimal, suffixes or names of infinities."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def valid_mpp(mpp: Column) -> Column:
    return F.when(mpp.between(*MPP_RANGE), mpp)


def mpp_error(mpp: Column) -> Column:
    """Why a resolution is refused, or null."""
    return F.when(mpp.isNull(), F.lit("missing")).when(~mpp.between(*MPP_RANGE), F.lit("out of range"))


def mpp_from_text(text: Column) -> Column:
    """Microns per pixel in free text: after "mpp" and a sign, else after "microns per pixel"."""
    short = F.regexp_extract(text, r"(?i)mpp\s*[:=]\s*([0-9]*\.?[0-9]+)", 1)
    long = F.regexp_extract(text, r"(?i)microns?\s+per\s+pixel[^0-9]*([0-9]*\.?[0-9]+)", 1)
    return number(F.when(short != "", short).otherwise(F.nullif(long, F.lit(""))))


def extract_mpp(meta: Column) -> Column:
    """Microns per pixel from a property map, by precedence, to four decimals (half to even)."""
    get = lambda k: F.try_element_at(meta, F.lit(k))
    named = [F.bround(number(get(k)), 4) for k in MPP_KEYS]
    texts = [F.bround(mpp_from_text(get(k)), 4) for k in TEXT_KEYS]
    unit = F.lower(get("tiff.ResolutionUnit"))
    per_unit = F.when(unit == "centimeter", F.lit(10000.0)).when(unit == "inch", F.lit(25400.0))
    tiff = F.bround(F.try_divide(per_unit, number(get("tiff.XResolution"))), 4)
    mags = [number(get(k)) for k in MAG_KEYS]
    by_mag = [F.when(m > 0, F.bround(F.lit(10.0) / m, 4)) for m in mags]
    return F.coalesce(*named, *texts, tiff, *by_mag)


def infer_mag(mpp: Column) -> Column:
    """Nominal magnification of a resolution; null from 2.4 microns on."""
    out = F.lit(None).cast("int")
    for bound, mag in reversed(MAG_STEPS):
        out = F.when(mpp < bound, F.lit(mag)).otherwise(out)
    return out


def extract_mag(meta: Column, mpp: Column) -> Column:
    """Objective power cut to an integer, else inferred from the resolution."""
    power = number(F.try_element_at(meta, F.lit("openslide.objective-power"))).cast("int")
    return F.coalesce(power, infer_mag(mpp))


def clean(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _lowered(meta: Column) -> Column:
    """Cleaned entries by lower-case key; of keys that differ in case only, the first with a value counts."""
    entries = F.filter(F.transform(F.map_entries(meta), lambda e: F.struct(F.lower(e["key"]).alias("key"), clean(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def find_meta_value(meta: Column, keys: Sequence[str], contains: Sequence[str] = ()) -> Column:
    """First value under exact keys (any case) in order, else of the least key with one of the substrings."""
    known = _lowered(meta)
    exact = [F.try_element_at(known, F.lit(k.lower())) for k in keys]
    if not contains:
        return F.coalesce(*exact)
    hit = lambda k: F.greatest(*[k.contains(t.lower()) for t in contains]) if len(contains) > 1 else k.contains(contains[0].lower())
    other = F.get(F.array_sort(F.filter(F.map_keys(known), hit)), F.lit(0))
    return F.coalesce(*exact, F.try_element_at(known, other))


def attribute(meta: Column, name: str) -> Column:
    return find_meta_value(meta, ATTRIBUTE_KEYS[name], [name])


def metadata_attrs(meta: Column, mpp: Column, mag: Column) -> Column:
    """Map of the attributes a slide has; absent ones have no key."""
    pairs = [F.lit("mpp"), mpp.cast("string"), F.lit("magnification"), mag.cast("string")]
    for name in ATTRIBUTE_KEYS:
        pairs += [F.lit(name), attribute(meta, name)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
