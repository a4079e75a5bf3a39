"""Scans of text formats: FASTA, hit tables, pair tables, clusters, structures, matrices.

All are `spark.read.text` or `csv` and expressions, so they split and push
down; members of archives are read by `zip_source`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import identifiers
from ravelin.functions.residues import ONE_LETTER
from ravelin.operators import joins
from ravelin.sources import zip_source


def line_order() -> Column:
    """Where a line stands: a struct that orders lines as if all files were read one after another, by name.

    Spark packs the splits of files into partitions by size, so an id that grows
    from partition to partition follows no such order. Within a split it does,
    hence file, start of the split, and id.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def fasta(spark: SparkSession, path: str, whole_header: bool = False) -> DataFrame:
    """(path, n, id, sequence) of one or more records a file, plain or gzip; upper case, no blanks.

    A record is cut at `>` at a line's start, so a large file is read in
    splits. An id is the header's first word unless `whole_header`.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), line_order().alias("n"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^>", "").alias("v"))
    cut = F.split("v", "\n", 2)
    header = F.trim(cut[0])
    name = header if whole_header else F.split(header, r"\s+")[0]
    sequence = F.upper(F.regexp_replace(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), r"\s", ""))
    return raw.where(F.trim("v") != "").select("path", "n", name.alias("id"), sequence.alias("sequence"))


def single_fasta(spark: SparkSession, path: str, whole_header: bool = False, allow_gaps: bool = False) -> DataFrame:
    """One record per file; a file with more, or a gap where none is allowed, stops the job."""
    records = fasta(spark, path, whole_header)
    count = F.count(F.lit(1)).over(Window.partitionBy("path"))
    bad = (count != 1) if allow_gaps else ((count != 1) | F.col("sequence").rlike("[-.]"))
    return records.withColumn("sequence", F.when(bad, F.raise_error(F.concat(F.lit("not a single ungapped record: "), "path")).cast("string")).otherwise(F.col("sequence")))


def wanted_records(records: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """(id, sequence, path): the first record, by files in order of name, of each wanted id.

    A record answers to its own id and to the accession in it, so `P12345` is
    found in `sp|P12345|NAME`. Records are sifted by a filter of the wanted ids
    in the scan, before they are shuffled; ids that no record has give no row.
    """
    ids = wanted.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
    forms = F.array_distinct(F.array_compact(F.array("id", identifiers.accession_loose(F.col("id")))))
    named = records.select(F.explode(forms).alias("id"), "n", "sequence", "path")
    found = joins.may_be_in(named, F.col("id"), ids, "id").join(ids, "id", "left_semi")
    return found.groupBy("id").agg(F.min_by(F.struct("sequence", "path"), "n").alias("r")).select("id", "r.sequence", "r.path")


# The columns of a tabular search result.
HIT_COLUMNS = ("query", "subject", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")
_INTEGERS = ("length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send")


def hits(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Twelve-column search hits with file and line order `n`.

    Rows with malformed numbers or another width are dropped; `strict` stops on
    another width.
    """
    raw = spark.read.text(path).select(line_order().alias("n"), F.split("value", "\t").alias("c")).where(F.size("c") > 1)
    wrong = F.size("c") != len(HIT_COLUMNS)
    if strict:
        raw = raw.withColumn("c", F.when(wrong, F.raise_error(F.lit("a hit has another number of columns")).cast("array<string>")).otherwise(F.col("c")))
    else:
        raw = raw.where(~wrong)
    kinds = {c: "string" for c in HIT_COLUMNS[:2]} | {c: "long" if c in _INTEGERS else "double" for c in HIT_COLUMNS[2:]}
    # The generator keeps the filter behind it, which would split a line again for each column.
    rows = raw.select("n", F.inline(F.array(F.struct(*[F.col("c")[i].try_cast(kinds[c]).alias(c) for i, c in enumerate(HIT_COLUMNS)]))))
    return rows.dropna(subset=list(HIT_COLUMNS))


def tsv(spark: SparkSession, path: str, required: Sequence[str] = (), comment: str | None = None) -> DataFrame:
    """Header table as strings, `NA`, `-` and blanks as nulls; a missing required column is an error."""
    reader = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {', '.join(missing)}")
    return df.select(*[F.when(~F.trim(c).isin("", "NA", "-"), F.trim(c)).alias(c) for c in df.columns])


def pair_table(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """Pairs under either pair of header names, as `a` and `b` and the other columns."""
    df = tsv(spark, path, comment=comment)
    for a, b in (("accA", "accB"), ("protein_1", "protein_2")):
        if a in df.columns and b in df.columns:
            return df.withColumnRenamed(a, "a").withColumnRenamed(b, "b")
    raise ValueError(f"{path} has no pair of accession columns")


# The two headers of a links table.
LINK_HEADERS = (
    "protein1 protein2 experimental database textmining combined_score",
    "protein1 protein2 experimental experimental_transferred database database_transferred textmining textmining_transferred combined_score",
)


def links(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated scored links with row order `n`, plain or gzip; scores as integers, another header is an error."""
    df = spark.read.option("header", True).option("sep", " ").csv(path)
    if " ".join(df.columns) not in LINK_HEADERS:
        raise ValueError(f"{path} has an unknown header")
    return df.select(line_order().alias("n"), *[F.col(c) if c.startswith("protein") else F.col(c).try_cast("int").alias(c) for c in df.columns])


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(member, cluster) of a cluster listing; a header counts for the lines after it.

    A listing is one ordered text, so its lines are read by one task per file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    number = F.last(F.when(F.col("line").rlike(r"^>Cluster"), F.regexp_extract("line", r"([0-9]+)", 1)), True).over(w)
    return lines.withColumn("cluster", number.try_cast("long")).withColumn("member", F.regexp_extract("line", r">(.+?)\.\.\.", 1)).where("member <> ''").select("path", "member", "cluster")


def atoms(spark: SparkSession, path: str, hetero: bool = True) -> DataFrame:
    """Fixed-width atoms of amino acids: blank or first alternate, without hydrogens; file order in `n`.

    Residues whose name has no one-letter code, such as waters, metals and
    ligands, are left out; of lines that repeat an atom of a residue the first
    counts.
    """
    line = F.col("value")
    part = lambda a, n: F.trim(F.substring(line, a, n))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), line_order().alias("n"), line)
    kinds = ["ATOM", "HETATM"] if hetero else ["ATOM"]
    name = F.upper(part(18, 3))
    rows = rows.where(part(1, 6).isin(*kinds) & F.substring(line, 17, 1).isin(" ", "A") & name.isin(*ONE_LETTER))
    element = F.when(part(77, 2) != "", part(77, 2)).otherwise(F.regexp_extract(part(13, 4), "([A-Z])", 1))
    found = rows.select("path", "n", part(13, 4).alias("atom"), name.alias("name"), part(22, 1).alias("chain"), part(23, 4).try_cast("int").alias("number"), part(27, 1).alias("insertion"), *[part(a, 8).try_cast("double").alias(x) for a, x in ((31, "x"), (39, "y"), (47, "z"))], part(61, 6).try_cast("double").alias("b"), element.alias("element")).where("element <> 'H' AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    key = ["path", "chain", "number", "insertion", "name", "atom"]
    rest = [c for c in found.columns if c not in key]
    return found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*[f"r.{c}" if c in rest else c for c in found.columns])


def residues(atom_rows: DataFrame) -> DataFrame:
    """One row per residue in file order: the CA atom's place, or the mean of its atoms."""
    key = ["path", "chain", "number", "insertion", "name"]
    ca = F.col("atom") == "CA"
    place = [F.coalesce(F.max(F.when(ca, F.col(c))), F.avg(c)).alias(c) for c in "xyz"]
    rows = atom_rows.groupBy(*key).agg(F.min("n").alias("n"), *place)
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("path", "chain").orderBy("n")).cast("long"))


def areas(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, number, area, relative) of the `RES` lines of an area listing."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("RES"))
    return rows.select(F.col("_metadata.file_path").alias("path"), c[2].alias("chain"), c[3].alias("number"), c[4].try_cast("double").alias("area"), c[5].try_cast("double").alias("relative"))


def secondary(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, chain, letter, code, area) of a secondary-structure listing, chain breaks left out.

    Residues stand after the header line that names RESIDUE and STRUCTURE; the
    statistics before it, whose lines begin with numbers too, are not read, and
    a file without the header gives no rows. A blank code is coil, `C`.
    """
    line = F.col("value")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), line_order().alias("n"), line)
    heads = rows.where(line.rlike("^  #.*RESIDUE.*STRUCTURE")).groupBy("path").agg(F.min("n").alias("_head"))
    body = rows.where((F.length(line) >= 38) & ~F.substring(line, 14, 1).isin("!", "*")).join(heads, "path").where(F.col("n") > F.col("_head"))
    number = F.trim(F.substring(line, 6, 5)).try_cast("int")
    code = F.trim(F.substring(line, 17, 1))
    return body.select("path", number.alias("number"), F.substring(line, 12, 1).alias("chain"), F.substring(line, 14, 1).alias("letter"), F.when(code == "", "C").otherwise(code).alias("code"), F.trim(F.substring(line, 35, 4)).try_cast("double").alias("area")).where("number IS NOT NULL")


def coupled(spark: SparkSession, path: str, l1: int, l2: int) -> DataFrame:
    """(i, j, score) of coupling lines whose columns and index base vary by line; j counts in the second chain.

    Columns 4-6 are tried first, then 1-3, then the last three; from 1 before
    from 0. Cells inside one chain are left out, both orders fold into one.
    """
    n = l1 + l2
    # A line is split once, and each value read once, in a projection of its own: columns used several times stay columns.
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"))
    places = [(F.lit(a), F.lit(b), F.lit(s)) for a, b, s in ((3, 4, 5), (0, 1, 2))] + [tuple(F.size("c") - k for k in (3, 2, 1))]
    read = lambda k, kind: F.when(k >= 0, F.get("c", k)).try_cast(kind)
    rows = rows.select(*[read(k, kind).alias(f"{name}{at}") for at, place in enumerate(places) for k, name, kind in zip(place, "xyv", ("int", "int", "double"), strict=True)])

    def attempt(at: int) -> Column:
        x, y, v = (F.col(f"{name}{at}") for name in "xyv")
        one = x.between(1, n) & y.between(1, n) & v.isNotNull()
        zero = x.between(0, n - 1) & y.between(0, n - 1) & v.isNotNull()
        cell = lambda d: F.struct((F.least(x, y) + d).alias("p"), (F.greatest(x, y) + d).alias("q"), v.alias("score"))
        return F.when(one, cell(0)).when(zero, cell(1))

    # The generator keeps the filter behind it, which would repeat all of the above for every use of a column.
    cells = rows.select(F.inline(F.array(F.coalesce(*[attempt(at) for at in range(3)])))).where(F.col("p").between(1, l1) & (F.col("q") > l1))
    return cells.groupBy(F.col("p").alias("i"), (F.col("q") - l1).alias("j")).agg(F.max("score").alias("score"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, score) of the non-zero cells of a dense tab-separated matrix, from 1."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "[\\r\\n]+$", ""), "\r?\n")).alias("i", "line"))
    cells = rows.select("path", "i", F.posexplode(F.split("line", "\t")).alias("j", "v"))
    return cells.select("path", (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"), F.col("v").cast("double").alias("score")).where("score <> 0")


def shaped_matrix(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """As `matrix`, for one shape: other files stop the job, but a single row or column is turned to fit.

    A matrix of one line (or one value a line) with the wanted number of values
    is read in either direction.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", "[\\r\\n]+$", ""), "\r?\n").alias("lines"))
    grid = lines.withColumn("grid", F.transform("lines", lambda x: F.split(x, "\t")))
    height, width = F.size("grid"), F.size(F.col("grid")[0])
    even = F.forall("grid", lambda r: F.size(r) == F.size(F.col("grid")[0]))
    turned = (height == columns) & (width == rows) & ((height == 1) | (width == 1)) & F.lit(rows != columns)
    fits = even & (((height == rows) & (width == columns)) | turned)
    checked = F.when(fits, F.col("grid")).otherwise(F.raise_error(F.concat(F.lit("a matrix has another shape: "), "path")).cast("array<array<string>>"))
    cells = grid.select("path", turned.alias("turned"), F.posexplode(checked).alias("i", "row")).select("path", "turned", "i", F.posexplode("row").alias("j", "v"))
    at = lambda a, b: (F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)) + 1).cast("long")
    return cells.select("path", at("i", "j").alias("i"), at("j", "i").alias("j"), F.col("v").cast("double").alias("score")).where("score <> 0")


def profile(spark: SparkSession, path: str, position: str, value: str, length: int) -> DataFrame:
    """(position, value) of a header table; a position from 1 to `length` that is absent, or one beyond, stops the job."""
    rows = tsv(spark, path, [position, value]).select(F.col(position).try_cast("long").alias("position"), F.col(value).try_cast("double").alias("value"))
    every = spark.range(1, length + 1).select(F.col("id").alias("position"))
    joined = every.withColumn("_asked", F.lit(True)).join(rows.withColumn("_here", F.lit(True)), "position", "full_outer")
    whole = F.col("_asked").isNotNull() & F.col("_here").isNotNull()
    stop = F.raise_error(F.concat(F.lit("a profile does not cover position "), F.col("position").cast("string"))).cast("long")
    return joined.select(F.when(whole, F.col("position")).otherwise(stop).alias("position"), F.coalesce("value", F.lit(0.0)).alias("value"))


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents; a path that does not exist gives none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def zipped_rows(spark: SparkSession, path: str, skip: Sequence[str], least: int, first_only: bool = False, header_lines: int = 0) -> DataFrame:
    """(path, member, n, columns) of the `.txt` members of ZIP files, split at tabs.

    Members whose names contain a word of `skip` are left out; rows with fewer
    than `least` columns, those that begin with `#`, and the first
    `header_lines` lines are dropped. `n` orders rows by file, member and line.
    """
    lines = zip_source.zip_lines(spark, path, ".txt", list(skip), first_only)
    n = F.struct(F.concat_ws("!", "path", "member").alias("file"), F.lit(0).cast("long").alias("start"), F.col("line").alias("at"))
    rows = lines.where((F.col("line") >= header_lines) & ~F.col("value").startswith("#"))
    return rows.select("path", "member", n.alias("n"), F.split("value", "\t").alias("columns")).where(F.size("columns") >= least)
