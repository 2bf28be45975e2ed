"""Registry of queries and the SQL fragments they share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under ``name`` with its SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql if sql.startswith("WITH ") else with_parts(sql)
        return fn

    return register


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def R6(text: str) -> str:
    """SQL form of :func:`r6`."""
    return f"(round(CAST({text} AS DOUBLE), 6) + 0.0)"


def U(*parts: object) -> str:
    """SQL form of the keyed uniform draw."""
    keys = ", ".join(f"'{p}'" if isinstance(p, int) else str(p) for p in parts)
    return f"(CAST('0x' || substr(md5(concat_ws(':', {keys})), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def LOGC(text: str) -> str:
    """SQL natural log with a floored input."""
    return f"ln(greatest({text}, 1e-20))"


def GUMBEL(u: str) -> str:
    """SQL form of Gumbel noise."""
    inner = LOGC(u)
    return f"(-{LOGC(f'(-{inner})')})"


# Named parts of the SQL texts; a text that mentions a name gets it, with all it needs, as a WITH entry.
PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    """Add a named SQL part."""
    PARTS[name] = text


def with_parts(text: str) -> str:
    """Prefix ``text`` with the WITH entries it mentions, in order of definition."""
    needed: set[str] = set()
    pending = [text]
    while pending:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", pending.pop()))
        for name in PARTS:
            if name in words and name not in needed:
                needed.add(name)
                pending.append(PARTS[name])
    if not needed:
        return text
    entries = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in PARTS.items() if name in needed)
    return f"WITH {entries}\n{text}"


part("t_genes", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS gene_idx, p_brand AS gene FROM (SELECT DISTINCT p_brand FROM part)")
part("t_spots", "SELECT c_custkey AS spot_id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
part(
    "t_insitu",
    "SELECT o_custkey AS spot_id, gene_idx, sum(l_quantity) AS value FROM lineitem"
    " JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN t_genes ON gene = p_brand GROUP BY 1, 2",
)
part(
    "t_scrna",
    "SELECT gene_idx, CAST(l_suppkey AS INTEGER) AS cell_idx, sum(l_quantity) AS cnt FROM lineitem"
    " JOIN part ON l_partkey = p_partkey JOIN t_genes ON gene = p_brand GROUP BY 1, 2",
)
part(
    "t_scaled",
    "SELECT spot_id, CAST(trunc((x - lx) / (hx - lx) * 15) AS INTEGER) AS px, CAST(trunc((y - ly) / (hy - ly) * 15) AS INTEGER) AS py"
    " FROM t_spots, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM t_spots)",
)
part("t_winners", "SELECT px, py, max(spot_id) AS spot_id FROM t_scaled GROUP BY px, py")
part("t_pixels", "SELECT gene_idx, px, py, value FROM t_winners JOIN t_insitu USING (spot_id) WHERE value <> 0")
part(
    "e_cells",
    "SELECT CAST(vec_id AS INTEGER) AS gene_idx, CAST(i // 8 AS INTEGER) AS px, CAST(i % 8 AS INTEGER) AS py, i AS pos, v AS value"
    " FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)",
)
part("e_pixels", "SELECT gene_idx, px, py, value FROM e_cells WHERE value <> 0")
part(
    "e_patches",
    "SELECT gene_idx, CAST(px // 2 AS INTEGER) AS prow, CAST(py // 2 AS INTEGER) AS pcol,"
    + ",".join(f" sum(CASE WHEN (px % 2) * 2 + py % 2 = {i} THEN CAST(value AS DOUBLE) ELSE 0 END) AS v{i}" for i in range(4))
    + " FROM e_pixels GROUP BY 1, 2, 3",
)
part(
    "e_codebook",
    "SELECT CAST(label * 16 + prow * 4 + pcol AS INTEGER) AS code_id, [avg(v0), avg(v1), avg(v2), avg(v3)] AS cvec"
    " FROM e_patches JOIN embeddings ON vec_id = gene_idx GROUP BY 1",
)
part(
    "e_sims",
    "SELECT gene_idx, prow, pcol, v0, v1, v2, v3, code_id, cvec, round(list_cosine_similarity([v0, v1, v2, v3], cvec), 9) AS sim"
    " FROM e_patches CROSS JOIN e_codebook",
)
part(
    "e_codes",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_idx, prow, pcol ORDER BY sim DESC, code_id) AS rn FROM e_sims) WHERE rn = 1",
)
part(
    "e_tokens",
    "SELECT CAST(gene_idx AS BIGINT) AS sample_id, prow * 4 + pcol AS pos, code_id AS token_id FROM e_codes",
)
part("e_cond", "SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS cond FROM embeddings")
part(
    "e_recon",
    "SELECT gene_idx, CAST(prow * 2 + i // 2 AS INTEGER) AS px, CAST(pcol * 2 + i % 2 AS INTEGER) AS py, v AS value"
    " FROM (SELECT gene_idx, prow, pcol, unnest(cvec) AS v, unnest(range(4)) AS i FROM e_codes) WHERE v <> 0",
)
