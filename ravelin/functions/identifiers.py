"""Identifiers, numbers and vocabulary terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two published forms of a protein accession, and the loose one.
STRICT = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"
LOOSE = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]|[A-Z0-9]{10})$"


def _null_unless(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def bare(value: Column) -> Column:
    """Upper-case identifier without `sp|..|` wrapping and isoform suffix."""
    text = F.upper(F.trim(value))
    inner = F.when(text.rlike(r"^[A-Z]+\|[^|]+(?:\||$)"), F.split(text, r"\|")[1]).otherwise(text)
    return F.regexp_replace(inner, r"-(?:PRO_)?[0-9]+$", "")


def accession_strict(value: Column) -> Column:
    """Accession of a `uniprotkb:` or bare value; other namespaces and malformed ones give null."""
    text = F.trim(value)
    spaced = text.rlike(r"^[A-Za-z/ -]+:")
    name = F.when(text.rlike(r"(?i)^uniprotkb:"), F.substring(text, F.lit(11), F.length(text))).when(~spaced, text)
    return _null_unless(bare(name), STRICT)


def accession_with_taxid(value: Column) -> Column:
    """As strict, after a numeric `taxid:` or `taxid.` prefix, and any ten letters and digits pass."""
    return _null_unless(bare(F.regexp_replace(F.trim(value), r"^[0-9]+[:.]", "")), LOOSE)


def accession_loose(value: Column) -> Column:
    """Any ten letters and digits pass; a numeric prefix is not taken off."""
    return _null_unless(bare(value), LOOSE)


def resolve(fields: list[Column], parse) -> Column:
    """(value, status): the first field with candidates decides; several make it ambiguous, none missing.

    A field is a `|`-separated list; `parse` turns an element into a candidate
    or null.
    """
    return told(first_candidates([candidates(f, parse) for f in fields]))


def candidates(field: Column, parse) -> Column:
    """The distinct candidates of a `|`-separated field."""
    return F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(field, F.lit("")), r"\|"), parse)))


def first_candidates(lists: list[Column]) -> Column:
    """The first list that has candidates."""
    chosen = F.array().cast("array<string>")
    for found in reversed(lists):
        chosen = F.when(F.size(found) > 0, found).otherwise(chosen)
    return chosen


def told(chosen: Column) -> Column:
    """(value, status) of a list of candidates."""
    status = F.when(F.size(chosen) == 1, "ok").when(F.size(chosen) > 1, "ambiguous").otherwise("missing")
    return F.struct(F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))).alias("value"), status.alias("status"))


def taxid(field: Column) -> Column:
    """Positive number of `taxid:9606(human)` or `9606`; anything else is null."""
    number = F.regexp_extract(F.coalesce(field, F.lit("")), r"^(?:taxid:)?(-?[0-9]+)", 1).try_cast("long")
    return F.when(number > 0, number)


def number(value: Column) -> Column:
    """Double, or null for text, NaN and infinity."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def whole_number(value: Column) -> Column:
    """Integer of `7` or `7.0`; anything else is null."""
    x = number(value)
    return F.coalesce(value.try_cast("long"), F.when(x == F.floor(x), x.cast("long")))


def terms(field: Column) -> Column:
    """(label, id) pairs of `psi-mi:"MI:0018"(two hybrid)|...`, distinct, in order; (-, -) if there is none."""
    parsed = F.transform(F.split(F.coalesce(field, F.lit("")), r"\|"), lambda t: F.struct(F.regexp_extract(t, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*$", 1).alias("label"), F.regexp_extract(t, r'"?([A-Z]+:[0-9]+)"?', 1).alias("id")))
    known = F.array_distinct(F.filter(parsed, lambda p: (p["id"] != "") | (p["label"] != "")))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.struct(F.lit("-").alias("label"), F.lit("-").alias("id"))))


def slug(value: Column, prefix: str) -> Column:
    """`prefix:` and the value in lower case, runs of other characters as one underscore."""
    return F.concat(F.lit(f"{prefix}:"), F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def ordered_pair(a: Column, b: Column, *sides: tuple[Column, Column]) -> list[Column]:
    """least and greatest of a pair, and attributes of both ends swapped in step."""
    straight = a <= b
    out = [F.least(a, b), F.greatest(a, b)]
    for x, y in sides:
        out += [F.when(straight, x).otherwise(y), F.when(straight, y).otherwise(x)]
    return out


def flag(value: Column) -> Column:
    """True for true, t, 1, yes and y in any case; null stays null."""
    return F.lower(F.trim(value.cast("string"))).isin("true", "t", "1", "1.0", "yes", "y")


def shown(value: Column) -> Column:
    """true, false, the value as text, or NA."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def binned(value: Column, edges: list[tuple[float, str]], above: str, strict: bool = False) -> Column:
    """Name of the first edge that is not exceeded (`strict`: not reached); `above` beyond, unknown for null."""
    out = F.when(value.isNull(), F.lit("unknown"))
    for edge, name in edges:
        out = out.when(value < edge if strict else value <= edge, F.lit(name))
    return out.otherwise(F.lit(above))


def safe_neglog10(value: Column) -> Column:
    return F.when(value <= 0, F.lit(300.0)).otherwise(-F.log10(value))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b in double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
