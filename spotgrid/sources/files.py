"""Text files of an expression data set.

Rows and columns of these files are identified by position only, and a count
file has tens of thousands of columns.  So lines are read as text, numbered, and
exploded to the long form; gene and cell names become rows, and the plan does
not grow with the width of a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.sources.lines import numbered_lines

# File names of a data set.
INSITU_FILE = "Insitu_count.txt"
LOCATION_FILE = "Locations.txt"
SCRNA_FILE = "scRNA_count_sorted.csv"


def first_line(spark: SparkSession, path: str) -> DataFrame:
    """One-row table ``value``: the first non-blank line of the first file, by name, that has one.

    Only a file's first block is asked, which ``take`` reads alone; one line comes to the driver.
    """
    for name in sorted(spark.read.text(path).inputFiles()):
        lines = spark.read.text(name).where((F.col("_metadata.file_block_start") == 0) & F.col("value").rlike("\\S"))
        found = lines.select("value").take(1)
        if found:
            return spark.createDataFrame([(found[0]["value"],)], "value string")
    return spark.createDataFrame([], "value string")


def _fields(line: Column, sep: str) -> Column:
    """Fields of a line; quoted fields may hold the separator."""
    mark = f"\\Q{sep}\\E"
    pattern = f'{mark}("[^"]*(?:""[^"]*)*"|[^{mark}]*)'
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(pattern), F.lit(1))
    unquoted = F.transform(
        quoted,
        lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f),
    )
    return F.when(F.instr(line, '"') > 0, unquoted).otherwise(F.split(line, mark, -1))


def _with_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The first header line, and the numbered body lines ``(row, value)`` without the header of each file."""
    lines = numbered_lines(spark, path)
    row = F.col("total_line") - F.col("file_no") - 1
    return first_line(spark, path), lines.where("line > 0").select(row.alias("row"), "value")


def _named(header: DataFrame, sep: str, skip: int, index: str, name: str) -> DataFrame:
    names = F.slice(_fields(F.col("value"), sep), skip + 1, 1 << 30)
    return header.select(F.posexplode(names).alias(index, name))


def gene_index(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``genes(gene_idx, gene)`` from the header alone, in column order.

    Serves both directions: name to index and index to name.
    """
    return _named(first_line(spark, path), sep, 0, "gene_idx", "gene")


def header_width(spark: SparkSession, path: str, sep: str, skip: int = 0) -> DataFrame:
    """One-row table ``width``: number of header fields after ``skip`` index columns."""
    return first_line(spark, path).select((F.size(_fields(F.col("value"), sep)) - F.lit(skip)).alias("width"))


def _first_field(line: Column, sep: str) -> Column:
    """The first field alone; the rest of a line without quotes is not split."""
    return F.when(line.startswith('"'), _fields(line, sep)[0]).otherwise(F.split(line, f"\\Q{sep}\\E", 2)[0])


def _exploded(body: DataFrame, width: DataFrame, sep: str, skip: int, keep_zeros: bool) -> DataFrame:
    """``(row, col, value, first)`` of every cell; short rows are filled with NULL."""
    fields = body.crossJoin(F.broadcast(width)).select("row", _fields(F.col("value"), sep).alias("f"), "width")
    cells = F.slice("f", skip + 1, F.col("width"))
    missing = F.greatest(F.col("width") - F.size("f") + F.lit(skip), F.lit(0))
    padded = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), missing))
    first = F.get("f", F.lit(0)) if skip else F.lit(None).cast("string")
    long = fields.select("row", first.alias("first"), F.posexplode(padded).alias("col", "text"))
    text = F.trim("text")
    value = F.when(text != "", text).cast("float")
    long = long.select("row", "first", "col", value.alias("value"))
    return long if keep_zeros else long.where(F.col("value").isNull() | (F.col("value") != 0))


def read_wide_counts(
    spark: SparkSession, path: str, sep: str = "\t", keep_zeros: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``insitu_long(spot_id, gene_idx, value)`` and ``genes`` from a spots-by-genes file.

    The row number is the spot, the column number the gene; blank cells are NULL.
    Repeated header names stay distinct genes.
    """
    return _wide_counts(*_with_header(spark, path), sep, keep_zeros)


def _wide_counts(header: DataFrame, body: DataFrame, sep: str, keep_zeros: bool) -> tuple[DataFrame, DataFrame]:
    width = header.select(F.size(_fields(F.col("value"), sep)).alias("width"))
    cells = _exploded(body, width, sep, 0, keep_zeros)
    counts = cells.select(F.col("row").cast("long").alias("spot_id"), F.col("col").alias("gene_idx"), "value")
    return counts, _named(header, sep, 0, "gene_idx", "gene")


def read_locations(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``spots(spot_id, x, y)``: the first two columns by position; missing or bad numbers raise."""
    _, body = _with_header(spark, path)
    fields = body.select("row", _fields(F.col("value"), sep).alias("f"))

    def number(at: int) -> Column:
        value = F.trim(F.get("f", F.lit(at))).cast("double")
        message = F.concat(F.lit("location is not a number in row "), F.col("row").cast("string"))
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(message).cast("double"))

    return fields.select(F.col("row").cast("long").alias("spot_id"), number(0).alias("x"), number(1).alias("y"))


def read_count_matrix(
    spark: SparkSession, path: str, sep: str = ",", keep_zeros: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``scrna_long(gene_idx, cell_idx, count)``, ``genes`` and ``cells`` from a genes-by-cells file."""
    header, body = _with_header(spark, path)
    width = header.select((F.size(_fields(F.col("value"), sep)) - 1).alias("width"))
    cells = _exploded(body, width, sep, 1, keep_zeros)
    counts = cells.select(
        F.col("row").cast("int").alias("gene_idx"), F.col("col").alias("cell_idx"), F.col("value").alias("count")
    )
    genes = body.select(F.col("row").cast("int").alias("gene_idx"), _first_field(F.col("value"), sep).alias("gene"))
    return counts, genes, _named(header, sep, 1, "cell_idx", "cell")


@dataclass(frozen=True)
class DataSet:
    """The tables of one data set; ``count_rows(spot_id)`` has a row per line of the spots-by-genes file."""

    insitu: DataFrame
    genes: DataFrame
    spots: DataFrame
    scrna: DataFrame
    scrna_genes: DataFrame
    cells: DataFrame
    count_rows: DataFrame


def load_dataset(spark: SparkSession, folder: str) -> DataSet:
    """Read the three fixed file names of a folder, with or without a trailing slash."""
    base = folder.rstrip("/")
    header, body = _with_header(spark, f"{base}/{INSITU_FILE}")
    insitu, genes = _wide_counts(header, body, "\t", False)
    count_rows = body.select(F.col("row").cast("long").alias("spot_id"))
    spots = read_locations(spark, f"{base}/{LOCATION_FILE}")
    scrna, scrna_genes, cells = read_count_matrix(spark, f"{base}/{SCRNA_FILE}")
    return DataSet(insitu, genes, spots, scrna, scrna_genes, cells, count_rows)
