"""Consistency checks of a data set and its settings.

Every table is measured by one aggregate of one row, and all checks read these
rows; or, with :class:`Watch`, the measures are taken by whatever job reads the
tables anyway.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What is measured of each table.
MEASURES = {
    "spots": lambda: F.count(F.lit(1)),
    "count_rows": lambda: F.count(F.lit(1)),
    "genes": lambda: F.count(F.lit(1)),
    "gene_rows": lambda: F.count(F.lit(1)),
    "cells": lambda: F.count(F.lit(1)),
    "pixels": lambda: F.coalesce(F.max(F.greatest("px", "py")), F.lit(-1)),
    "tokens": lambda: F.coalesce(F.max("pos"), F.lit(-1)),
}


def _checks(
    image_size: int, layers: int, codebook_size: int | None, seq_len: int | None, has_counts: bool, has_embeddings: bool, superres: bool, cond_image_size: int | None
) -> list[tuple[str, Column, Column]]:
    """``(check, failed, detail)`` over a row of measures; a table that is not there has a null measure and fails nothing."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    tokens = (image_size >> layers) ** 2
    spots, count_rows, genes, gene_rows, cells, edge, last = (F.col(name) for name in MEASURES)
    return [
        ("spots", spots != count_rows, say("spots ", spots, ", count rows ", count_rows)),
        ("genes", genes > gene_rows, say("genes ", genes, ", matrix rows ", gene_rows)),
        ("divisible", F.lit(image_size % (1 << layers) != 0), F.lit(f"image size {image_size}, divisor {1 << layers}")),
        ("inputs", F.lit(has_counts == has_embeddings), F.lit("exactly one of counts and embeddings is needed")),
        ("condition", F.lit(superres and cond_image_size is None), F.lit("super-resolution needs a condition image size")),
        ("sequence", F.lit(seq_len is not None and tokens > seq_len), F.lit(f"tokens {tokens}, limit {seq_len}")),
        ("codebook", F.lit(codebook_size is not None) & (cells != F.lit(codebook_size or 0)), say("cells ", cells, f", codes {codebook_size}")),
        ("image", edge >= image_size, say("pixel ", edge, f", image size {image_size}")),
        ("tokens", F.lit(seq_len is not None) & (last >= F.lit(seq_len or 0)), say("position ", last, f", limit {seq_len}")),
    ]


def _violations(row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    entry = "struct<check:string,detail:string>"
    found = [F.when(failed, F.struct(F.lit(check).alias("check"), detail.alias("detail"))).cast(entry) for check, failed, detail in checks]
    return row.select(F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("e.check", "e.detail")


def validate_dataset(
    spots: DataFrame,
    count_rows: DataFrame,
    genes: DataFrame,
    matrix_genes: DataFrame,
    cells: DataFrame,
    image_size: int,
    layers: int,
    codebook_size: int | None = None,
    seq_len: int | None = None,
    pixels: DataFrame | None = None,
    tokens: DataFrame | None = None,
    has_counts: bool = True,
    has_embeddings: bool = False,
    superres: bool = False,
    cond_image_size: int | None = None,
) -> DataFrame:
    """``violations(check, detail)``: one row per failed check, none if all hold.

    ``count_rows``, ``matrix_genes`` and ``cells`` have a row per line or column of
    the files, counts or not.  Every table is read once, by an aggregate with partial
    sums; nothing is collected.
    """
    given = {"spots": spots, "count_rows": count_rows, "genes": genes, "gene_rows": matrix_genes, "cells": cells, "pixels": pixels, "tokens": tokens}
    rows = [df.agg(MEASURES[name]().cast("bigint").alias(name)) for name, df in given.items() if df is not None]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)
    row = row.withColumns({name: F.lit(None).cast("bigint") for name, df in given.items() if df is None})
    return _violations(row, _checks(image_size, layers, codebook_size, seq_len, has_counts, has_embeddings, superres, cond_image_size))


class Watch:
    """Measures of a data set's tables, taken by the jobs that read them.

    ``watch.of("spots", spots)`` gives the table back with the measure attached; once
    a job has read all watched tables to the end, :meth:`violations` has the checks
    without another pass.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def of(self, name: str, table: DataFrame) -> DataFrame:
        """``table``, watched as one of :data:`MEASURES`."""
        if name not in MEASURES:
            raise ValueError(f"nothing is measured of {name!r}")
        self._seen[name] = Observation()
        return table.observe(self._seen[name], MEASURES[name]().cast("bigint").alias(name))

    def violations(
        self, spark: SparkSession, image_size: int, layers: int, codebook_size: int | None = None, seq_len: int | None = None,
        has_counts: bool = True, has_embeddings: bool = False, superres: bool = False, cond_image_size: int | None = None,
    ) -> DataFrame:
        """:func:`validate_dataset` from what was measured; waits for jobs that have begun."""
        row = {name: self._seen[name].get[name] if name in self._seen else None for name in MEASURES}
        schema = ", ".join(f"{name} bigint" for name in MEASURES)
        return _violations(spark.createDataFrame([tuple(row.values())], schema), _checks(image_size, layers, codebook_size, seq_len, has_counts, has_embeddings, superres, cond_image_size))
