"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of an address from the word that begins its unit; a fixed value.
UNIT = r"\s+(APT|UNIT|#|SUITE|STE|FL|FLOOR|RM|ROOM|P-?\S+).*$"
#: The same where a word's end must follow, and a hyphen or an H a P.
STRICT_UNIT = r"\s+(?:(?:APT|UNIT|SUITE|STE|FL|FLOOR|RM|ROOM|P-\S+|PH)\b|#).*$"
#: Spellings of an apartment's label and the one that replaces each; fixed values, in this order.
APARTMENTS = (
    (r"^(GRNDFL|GRFLO|GRDFLR|GRDFL|GDFL|GRFL|GFL)\s*(.*)$", "GROUND FL $2"),
    (r"^SUITE$", "STE"),
    (r"^(\d+)\s*(FLOOR|FLOO|FLR|FRL|FL)$", "$1 FL"),
    (r"^(FLOOR|FLOO|FLR|FL)\s*(\d+)$", "$2 FL"),
    (r"^(\d+)\s*(APART|APT)$", "APT $1"),
    (r"^(APART|APT)\s*(\d+)$", "APT $2"),
    (r"^(\d+)\s*(SUITE|STE)$", "STE $1"),
    (r"^(SUITE|STE)\s*(\d+)$", "STE $2"),
    (r"^(BASEMENT|BASEME|BASE|BSMNT|BSMT)\s*(\d*)$", "BSMT $2"),
    (r"^(\d*)\s*(BASEMENT|BASEME|BASE|BSMNT|BSMT)$", "BSMT $1"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_words(*parts: Column | str) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *map(col, parts))


def squish(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def norm_address(text: Column | str, strip_unit: bool = False, strict_unit: bool = False) -> Column:
    """An address for equality: upper case, single blanks, optionally without its unit.

    The unit's words match without a boundary after them, so that ``100 FLOWER ST`` and ``100 PARK
    AVE`` lose their streets; ``strict_unit`` asks for the boundary, and for a hyphen or an H after a P.
    """
    out = F.trim(F.coalesce(col(text), F.lit("")))
    if strip_unit:
        out = F.regexp_replace(out, f"(?i){STRICT_UNIT if strict_unit else UNIT}", "")
    return F.upper(F.regexp_replace(out, r"\s+", " "))


def match_or_null(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def house_number(address: Column | str) -> Column:
    return match_or_null(address, r"^\s*(\d+\S*)")


def street_name(address: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(address), r"^\s*\d+\S*\s*", ""))


def slugify(text: Column | str) -> Column:
    """Lower case with hyphens between runs of letters, digits, hyphens and underscores."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(col(text))), r"[^a-z0-9_-]+", "-"), F.lit("-"))


def initcap_words(text: Column | str) -> Column:
    """Capitals at the start of every run of letters and digits, also after a hyphen or an apostrophe."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def title_case(text: Column | str) -> Column:
    return F.initcap(F.lower(col(text)))


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\D", "")


def plain_upper(text: Column | str) -> Column:
    """Without anything but capitals, digits and white space."""
    return F.regexp_replace(col(text), r"[^A-Z0-9\s]", "")


def normal_apartment(text: Column | str) -> Column:
    """An apartment's label in one spelling: floors, apartments, suites and basements."""
    out = plain_upper(text)
    for pattern, by in APARTMENTS:
        out = F.regexp_replace(out, pattern, by)
    return out


def sentence_list(items: Column | str) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    own = col(items)
    n = F.size(own)
    head = F.array_join(F.slice(own, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n < 1, F.lit("")).when(n == 1, F.get(own, 0)).when(n == 2, F.array_join(own, " and ")).otherwise(F.concat(head, F.lit(", and "), F.get(own, n - 1)))


def stringify_contacts(contacts: Column | str) -> Column:
    """``value (title)—house street apt zip`` for each contact; an empty or null list is empty."""
    def one(c: Column) -> Column:
        address = F.concat_ws(" ", c["address"]["housenumber"], c["address"]["streetname"], c["address"]["apartment"], c["address"]["zip"])
        return F.concat(c["value"], F.lit(" ("), c["title"], F.lit(")"), F.when(c["address"].isNotNull(), F.concat(F.lit("—"), address)).otherwise(F.lit("")))

    return F.coalesce(F.array_join(F.transform(col(contacts), one), ", "), F.lit(""))


def stringify_counts(items: Column | str) -> Column:
    """``type (count)`` for each entry; an empty or null list is empty."""
    return F.coalesce(F.array_join(F.transform(col(items), lambda c: F.concat(c["type"], F.lit(" ("), c["count"].cast("string"), F.lit(")"))), ", "), F.lit(""))


def csv_cell(value: Column, is_array: bool) -> Column:
    """A value as a CSV cell: lists joined by commas, null as nothing."""
    return F.coalesce(F.array_join(value.cast("array<string>"), ",") if is_array else value.cast("string"), F.lit(""))
