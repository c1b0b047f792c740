"""Text column functions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title patterns and the type keywords they imply.
# Blanks are Unicode's, as the titles' no-break spaces need.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
SURFACE_PATTERN = rf"(\d+){BLANK}*m[²2]"
ROOMS_PATTERN = rf"(\d+){BLANK}*pièce"
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ROOMS_T_PATTERN = r"[tT](\d+)"
# (keyword regex on the lower-cased title, type) in the order they are tried;
# a later match overrides an earlier one.
TYPE_KEYWORDS = [
    ("appart", "Appartement"),
    ("maison|villa", "Maison"),
    ("parking|garage", "Parking"),
    ("terrain", "Terrain"),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_upper(col) -> Column:
    """Strip surrounding whitespace (any Unicode space) and upper-case.

    ``trim`` alone only removes ASCII spaces, hence the list of blanks; a pattern
    would be tried at every character.  Null stays null.
    """
    return F.upper(F.btrim(_c(col), F.lit(BLANKS)))


def is_blank(col) -> Column:
    """True when null or empty after stripping whitespace, which ends at the first
    character that is none."""
    c = _c(col)
    return c.isNull() | (F.ltrim(c, F.lit(BLANKS)) == "")


def first_number(col, pattern: str) -> Column:
    """First capture group of ``pattern`` as a double; null when absent.

    The cast makes a null of the empty text; ``nullif`` would match twice."""
    return F.regexp_extract(_c(col), pattern, 1).try_cast("double")


def surface_from_title(title) -> Column:
    """C4: first ``<digits> m²`` (or ``m2``) of the title."""
    return first_number(title, SURFACE_PATTERN)


def rooms_from_title(title) -> Column:
    """First ``<digits> pièce``, else the first ``T<digits>``."""
    return F.coalesce(first_number(title, ROOMS_PATTERN), first_number(title, ROOMS_T_PATTERN))


def type_from_title(type_col, title) -> Column:
    """Replace a null or 'Autre' type by the keyword found in the title.

    Keywords are applied in order with the last match winning, so the
    ``when`` chain tests them in reverse.  A null title leaves the type.
    """
    t, low = _c(type_col), F.lower(_c(title))
    replace = t.isNull() | (F.upper(t) == "AUTRE")
    out = t
    for pattern, name in TYPE_KEYWORDS:
        out = F.when(replace & low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def numeric_text(col) -> Column:
    """C1: '150 000 €' / '45 m²' / '30,5' -> double; unparsable -> null.

    Lower-case, drop 'm2', 'm²' and '€', comma -> dot, keep digits and dots.
    Applied to string columns only (numbers pass through untouched).
    """
    s = F.lower(_c(col))
    for token in ("m2", "m²", "€"):
        s = F.replace(s, F.lit(token), F.lit(""))
    s = F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^0-9.]", "")
    return F.nullif(s, F.lit("")).try_cast("double")


def sha256_hex(col) -> Column:
    """SHA-256 hex digest of the UTF-8 text; null stays null."""
    return F.sha2(_c(col).cast("string"), 256)


def pad_zipcode(col) -> Column:
    """Left-pad to five characters with zeros; longer codes are kept."""
    c = _c(col)
    return F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)


def city_from_label(col) -> Column:
    """C15: 'Paris, 75000' -> 'PARIS' (text before the first comma)."""
    return strip_upper(F.split_part(_c(col), F.lit(","), F.lit(1)))
