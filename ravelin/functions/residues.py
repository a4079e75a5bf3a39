"""Residue properties, and positions of aligned strings, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue names, property classes, largest accessible areas in square angstroms, and the published hydropathy index.
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M"}
CHARGE = {"K": 1, "R": 1, "H": 1, "D": -1, "E": -1}
HYDROPHOBIC, POLAR, AROMATIC = "AVILMFWYC", "STNQYCH", "FYW"
LARGEST_AREA = {"A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "Q": 223.0, "E": 225.0, "G": 104.0, "H": 224.0, "I": 197.0, "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0}
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
HELIX, SHEET = "HGI", "EB"


def _look_up(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def one_letter(name: Column) -> Column:
    text = F.upper(F.trim(name))
    return F.when(F.length(text) == 1, text).otherwise(F.coalesce(_look_up(ONE_LETTER, text), F.lit("X")))


def charge(letter: Column) -> Column:
    return F.coalesce(_look_up(CHARGE, letter), F.lit(0))


def hydropathy(letter: Column) -> Column:
    """Published hydropathy index; 0 for letters without one."""
    return F.coalesce(_look_up(HYDROPATHY, letter), F.lit(0.0))


def in_class(letter: Column, members: str) -> Column:
    return F.coalesce(letter.isin(*members), F.lit(False))


def three_states(code: Column) -> Column:
    """helix, sheet or coil of an eight-state code; anything else is coil."""
    text = F.upper(F.trim(code))
    return F.when(text.isin(*HELIX), "helix").when(text.isin(*SHEET), "sheet").otherwise("coil")


def relative_area(area: Column, letter: Column) -> Column:
    return area / _look_up(LARGEST_AREA, letter)


def _letters(text: Column) -> Column:
    return F.split(text, "")


def query_row(query: Column, target: Column, start: Column, length: Column) -> Column:
    """The target's letters at the query's positions, `-` elsewhere; an error where they leave the query.

    `start` counts from 1 in a query of `length` letters.
    """
    zipped = F.arrays_zip(_letters(query).alias("q"), _letters(target).alias("t"))
    kept = F.array_join(F.transform(F.filter(zipped, lambda z: z["q"] != "-"), lambda z: z["t"]), "")
    row = F.rpad(F.concat(F.repeat(F.lit("-"), start - 1), kept), length, "-")
    return F.when(start - 1 + F.length(kept) <= length, row).otherwise(F.raise_error(F.lit("an aligned row leaves its query")).cast("string"))


def covered(query: Column, target: Column, start: Column, end: Column) -> Column:
    """Query positions at which neither string has a gap; they fall where start > end."""
    zipped = F.arrays_zip(_letters(query).alias("q"), _letters(target).alias("t"))
    places = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda s, z: F.struct((s["n"] + F.when(z["q"] != "-", 1).otherwise(0)).alias("n"), F.when((z["q"] != "-") & (z["t"] != "-"), F.array_append(s["at"], s["n"])).otherwise(s["at"]).alias("at")),
    )["at"]
    return F.transform(places, lambda i: F.when(start <= end, start + i).otherwise(start - i))


def position_map(query: Column, subject: Column, q_start: Column, q_end: Column, s_start: Column, s_end: Column) -> Column:
    """Map from subject position to query position where both have a letter."""
    zipped = F.arrays_zip(_letters(query).alias("q"), _letters(subject).alias("s"))
    entry = "array<struct<key:int,value:int>>"
    q_step, s_step = F.when(q_start <= q_end, 1).otherwise(-1), F.when(s_start <= s_end, 1).otherwise(-1)

    def step(a: Column, z: Column) -> Column:
        has_q, has_s = z["q"] != "-", z["s"] != "-"
        pair = F.struct((s_start + s_step * a["s"]).cast("int").alias("key"), (q_start + q_step * a["q"]).cast("int").alias("value"))
        return F.struct((a["q"] + F.when(has_q, 1).otherwise(0)).alias("q"), (a["s"] + F.when(has_s, 1).otherwise(0)).alias("s"), F.when(has_q & has_s, F.array_append(a["e"], pair)).otherwise(a["e"]).alias("e"))

    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("s"), F.array().cast(entry).alias("e"))
    return F.map_from_entries(F.aggregate(zipped, start, step)["e"])


def trim_gaps(row: Column, query: Column) -> Column:
    """`row` without the columns at which the aligned query has a gap."""
    zipped = F.arrays_zip(_letters(query).alias("q"), _letters(row).alias("r"))
    return F.array_join(F.transform(F.filter(zipped, lambda z: z["q"] != "-"), lambda z: z["r"]), "")


def chain_lengths(structure: Column) -> Column:
    """(l1, l2) of a two-chain structure line: the first chain is its leading run of `H`; an empty chain is an error."""
    first = F.length(F.regexp_extract(structure, "^(H+)", 1))
    second = F.length(structure) - first
    lengths = F.struct(first.alias("l1"), second.alias("l2"))
    return F.when((first > 0) & (second > 0), lengths).otherwise(F.raise_error(F.lit("no two chains in a structure line")).cast("struct<l1:int,l2:int>"))


def structure_line(l1: Column, l2: Column) -> Column:
    """`H` for each position of the first chain, `B` for each of the second."""
    return F.concat(F.repeat(F.lit("H"), l1), F.repeat(F.lit("B"), l2))
