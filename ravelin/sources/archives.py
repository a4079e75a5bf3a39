"""Formats whose state spans lines or members: mmCIF atom loops, spreadsheets, sets of files."""

from __future__ import annotations

import io
import re
import shlex
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ATOM = "path string, model long, chain string, number long, name string, atom string, x double, y double, z double"


def _tokens(line: str) -> list[str]:
    return shlex.split(line, posix=True) if "'" in line or '"' in line else line.split()


def cif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model of mmCIF files, by label chain and number; a file a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[c.split()[0] for c in _ATOM.split(", ")[1:]]]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                columns, rows, first = [], [], None
                for line in io.TextIOWrapper(io.BytesIO(content), "utf-8"):
                    if line.startswith("_atom_site."):
                        columns.append(line.split(".")[1].strip())
                    elif columns and line.startswith(("ATOM", "HETATM")):
                        r = dict(zip(columns, _tokens(line), strict=False))
                        model = int(r.get("pdbx_PDB_model_num", 1))
                        first = model if first is None else first
                        if model == first and r["label_seq_id"] != ".":
                            rows.append((file, model, r["label_asym_id"], int(r["label_seq_id"]), r["label_comp_id"], r["label_atom_id"], *(float(r[f"Cartn_{a}"]) for a in "xyz")))
                    elif columns and rows and line.startswith("#"):
                        break
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _ATOM)


def contact_atom(atoms: DataFrame) -> DataFrame:
    """One row per residue: the CB atom's place, or else CA's."""
    rank = F.when(F.col("atom") == "CB", 0).when(F.col("atom") == "CA", 1)
    kept = atoms.withColumn("_r", rank).where("_r IS NOT NULL")
    return kept.groupBy("path", "chain", "number", "name").agg(F.min_by(F.struct("x", "y", "z"), "_r").alias("p")).select("path", "chain", "number", "name", "p.*")


def _column(reference: str) -> int:
    """`A1` is 0, `AB7` is 27."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of the first sheet of spreadsheets, blanks as nulls; a file a task."""

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    shared = [text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
                    sheet = ElementTree.fromstring(z.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
                rows = []
                for row in (e for e in sheet.iter() if e.tag.endswith("}row")):
                    cells: dict[int, str | None] = {}
                    for c in row:
                        v = next((e.text for e in c if e.tag.endswith("}v")), None)
                        cells[_column(c.get("r"))] = shared[int(v)] if c.get("t") == "s" and v is not None else text(c) if c.get("t") == "inlineStr" else v
                    rows.append((file, int(row.get("r")), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def sectioned(rows: DataFrame, sections: Mapping[str, str], data: str, least: int) -> DataFrame:
    """(path, row, section, cells) of the data rows of sheets, each with the section header last seen above it.

    A row whose first cell is a key of `sections` is a header, and its value
    counts for the rows after it; a row whose first cell matches `data` is
    data, and others are left out. Data before any header has section null; a
    data row of fewer than `least` cells stops the job. A sheet has 2**20 rows
    at most, so a window may hold one.
    """
    first = F.trim(F.get("cells", F.lit(0)))
    named = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])[first] if sections else F.lit(None).cast("string")
    above = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_head", named).withColumn("section", F.last("_head", True).over(above))
    short = F.raise_error(F.concat(F.lit("too few cells in row "), F.col("row").cast("string"), F.lit(" of "), F.col("path"))).cast("array<string>")
    cells = F.when(F.size("cells") >= least, F.col("cells")).otherwise(short)
    return told.where(F.col("_head").isNull() & first.rlike(data)).select("path", "row", "section", cells.alias("cells"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path) of the files of a folder, without those that a file system keeps beside them; Spark lists no file without content."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(~F.col("name").startswith("._"))


def role_files(spark: SparkSession, folder: str, wanted: DataFrame, roles: Mapping[str, str], key: str = "id") -> DataFrame:
    """(id, status, role, path): for each wanted id the one file of its first role that has any.

    `roles` maps a role to a pattern of whole file names whose first group is
    the id, in order of preference. An id whose role has several files is
    `ambiguous` and one without files `missing`, both without a path; no later
    role stands in for an ambiguous one.
    """
    of = F.array_compact(F.array(*[F.when(F.col("name").rlike(f"^(?:{p})$"), F.struct(F.lit(i).alias("at"), F.regexp_extract("name", f"^(?:{p})$", 1).alias("id"))) for i, p in enumerate(roles.values())]))
    found = _files(spark, folder).select("path", F.explode(of).alias("r")).groupBy("r.id", "r.at").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    first = found.groupBy("id").agg(F.min_by(F.struct("at", "n", "path"), "at").alias("f"))
    asked = wanted.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct().join(first, "id", "left")
    one = F.col("f.n") == 1
    status = F.when(one, "found").when(F.col("f.n") > 1, "ambiguous").otherwise("missing")
    return asked.select("id", status.alias("status"), F.get(F.array(*[F.lit(r) for r in roles]), F.col("f.at")).alias("role"), F.when(one, F.col("f.path")).alias("path"))


def complete_ids(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Ids for which `<id><suffix>` exists in `folder` for every suffix."""
    files = _files(spark, folder).select("name")
    hits = [files.where(F.col("name").endswith(s)).select(F.expr(f"left(name, length(name) - {len(s)})").alias("id")) for s in suffixes]
    out = hits[0]
    for more in hits[1:]:
        out = out.intersect(more)
    return out
