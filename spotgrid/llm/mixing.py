"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most ``cap`` times its own
words; what a capped source leaves is shared again by weight.  A source first
gives whole epochs; the rest of its target goes to a sample without replacement:
every document draws an exponential key divided by its quality weight, documents
are sorted by key within their source, and a running sum of sizes is cut before the document
that exceeds the budget.  What is left of the budget is filled ``FILLS`` times more in
the same way, passing over documents larger than that; the last rest goes to one
document, that of the nearest size (ties by key), if this brings the source nearer
its target.

Rows: a null text has no words and takes none; a null source is one source, last
in order; null ids draw by their text; documents alike in id and text draw the
same key and stand beside each other, in any order since they are alike; a weight
that is null, not finite or outside the bounds counts as the nearest bound; an empty
table gives an empty table; columns other than the named ones are ignored.  Draws
hash the seed, the id and the text, so reruns agree on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotgrid.llm.common import SPACES, stored, text_or_empty, word_count
from spotgrid.llm.registry import query, table
from spotgrid.plans.sizing import bounded

SEED = "mix-1"
#: Documents per slice of keys, within which sizes are added up by a window.
SLICE_ROWS = 4096
#: Cuts after the first one.
FILLS = 2
#: Quality weights lie between these, so that slices of keys stay even.
LOWEST_WEIGHT, HIGHEST_WEIGHT = 0.25, 1.0


def quality_weight(text: Column) -> Column:
    """Share of a text's characters, apart from white space, that are letters; within the bounds."""
    bare = F.length(F.regexp_replace(text, SPACES, ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(LOWEST_WEIGHT), F.when(bare > 0, letters / bare).otherwise(0.0))


def draw(*parts: Column, seed: str = SEED) -> Column:
    """Uniform draw in (0, 1) of 52 bits from a hash of the seed and the parts (nulls count as empty)."""
    keyed = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substr(F.md5(keyed), F.lit(1), F.lit(13)), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in order of capped share per weight: those up to the first whose cap
    lies above the level of the rest stop at their cap; the rest share by weight.
    The windows run over the table of sources alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    weighed = sizes.select("source", "source_size", weight.alias("weight"))
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = weighed.withColumn("left", left).withColumn("rest", F.sum("weight").over(after))
    capped = levels.withColumn("capped", F.col("source_size") * cap * F.col("rest") <= F.col("weight") * F.col("left"))
    free = F.col("capped") == F.lit(False)
    level_left = F.max(F.when(free, F.col("left"))).over(everything)
    level_rest = F.max(F.when(free, F.col("rest"))).over(everything)
    shared = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * level_left).cast("double") / level_rest)
    return capped.select("source", "source_size", shared.alias("target"))


def bounded_weight(weight: Column) -> Column:
    """A weight within the bounds; the lowest for null and NaN."""
    known = F.when(F.isnan(weight.cast("double")), None).otherwise(weight.cast("double"))
    return F.greatest(F.lit(LOWEST_WEIGHT), F.least(F.lit(HIGHEST_WEIGHT), F.coalesce(known, F.lit(LOWEST_WEIGHT))))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED, slice_rows: int = SLICE_ROWS, weight: str | None = None
) -> DataFrame:
    """What the mix takes of each row of ``doc_id, source, text``.

    ``weight`` names a column of quality weights, such as a classifier's score; without
    one, :func:`quality_weight` of the text serves.  Returns ``doc_id, text_key, source, size, source_size, target, copies, taken``:
    ``copies`` times the whole document, ``taken`` words in all.
    """
    text = text_or_empty()
    text_key = F.md5(text)
    keyed = docs.select("doc_id", "source", text_key.alias("text_key"), word_count(text).alias("size"), (quality_weight(text) if weight is None else bounded_weight(F.col(weight))).alias("quality"))
    slim = keyed.withColumn("key", -F.log(draw(F.col("doc_id"), F.col("text_key"), seed=seed)) / F.col("quality"))
    slim = stored(slim.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    per_source = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean_quality")), "mix-sources")
    n_sources = per_source.count()
    targets = source_targets(per_source.select("source", "source_size"), weights, cap).join(
        per_source.select(F.col("source").alias("other"), "n", "mean_quality"), F.col("source").eqNullSafe(F.col("other"))
    ).drop("other")
    targets = targets.withColumnRenamed("source", "its_source")
    rows = slim.join(bounded(targets, n_sources, 96), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    # Keys of the mean weight fall evenly into slices; others stretch them by a bounded factor.
    slices = F.ceil(F.col("n") / slice_rows)
    rows = rows.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_quality"))) * slices), slices - 1).cast("bigint"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rows = rows.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("sampled", F.lit(False))
    n_slices = n_sources + -(-slim.count() // slice_rows)
    for _ in range(1 + FILLS):
        rows = _filled(rows, n_sources, n_slices)
    gap = F.abs(F.col("left") - F.col("size"))
    nearer = rows.where(~F.col("sampled") & (F.col("size") > 0) & (gap < F.col("left")))
    alone = nearer.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "key", "doc_id", "text_key", "uid")).alias("one"))
    final = rows.join(bounded(alone.select(F.col("one.uid").alias("uid"), F.lit(True).alias("alone")), n_sources, 32), "uid", "left")
    more = F.col("sampled") | F.coalesce("alone", F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + more.cast("bigint")).cast("bigint")
    return final.withColumn("copies", copies).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _filled(rows: DataFrame, n_sources: int, n_slices: int) -> DataFrame:
    """One cut: of the documents not sampled yet and no larger than what is ``left``, those whose running sum fits it."""
    open_size = F.when(~F.col("sampled") & (F.col("size") <= F.col("left")), F.col("size")).otherwise(0)
    rows = rows.withColumn("open", open_size)
    sums = rows.groupBy("source", "slice").agg(F.sum("open").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("its_source"), F.col("slice").alias("its_slice"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum("open").over(within))
    placed = placed.join(bounded(offsets, n_slices, 64), F.col("source").eqNullSafe(F.col("its_source")) & (F.col("slice") == F.col("its_slice")))
    upto = F.col("offset") + F.col("within")
    cut = stored(placed.withColumn("upto", upto).withColumn("fits", (F.col("open") > 0) & (upto <= F.col("left"))).drop("its_source", "its_slice", "offset", "within", "open"), "mix-cut")
    spent = cut.where("fits").groupBy(F.col("source").alias("its_source")).agg(F.max("upto").alias("spent"))
    after = cut.join(bounded(spent, n_sources, 64), F.col("source").eqNullSafe(F.col("its_source")), "left")
    after = after.withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0))).withColumn("sampled", F.col("sampled") | F.col("fits"))
    return after.drop("its_source", "spent", "upto", "fits")


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them whole; columns unchanged.

    Rows alike in id, source and text are told apart by nothing, so what is taken of
    them together is dealt to them in turn.
    """
    copies = mix(docs, **options).where(F.col("copies") > 0)
    per_text = copies.groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"))
    keys = ["k_id", "k_source", "k_text", "k_copies"]
    while set(keys) & set(docs.columns):  # names of the caller's columns stay free
        keys = [f"{k}_" for k in keys]
    tag = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))  # noqa: E731  a null is a key of its own
    wanted = per_text.select(tag("doc_id").alias(keys[0]), tag("source").alias(keys[1]), F.col("text_key").alias(keys[2]), F.col("copies").alias(keys[3]))
    own = docs.withColumns({keys[0]: tag("doc_id"), keys[1]: tag("source"), keys[2]: F.md5(text_or_empty())})
    joined = own.join(wanted, keys[:3])
    place = F.row_number().over(Window.partitionBy(*keys[:3]).orderBy(*keys[:3])) - 1
    alike = F.count(F.lit(1)).over(Window.partitionBy(*keys[:3]))
    numbered = joined.withColumns({keys[0]: place, keys[1]: alike})
    share = F.floor((F.col(keys[3]) - 1 - F.col(keys[0])) / F.col(keys[1])) + 1
    return numbered.withColumn(keys[3], F.explode(F.array_repeat(F.lit(1), share.cast("int")))).select(*docs.columns)


_FILLS = ""
for _i in range(1 + FILLS):
    _FILLS += f"""
), u{_i} AS (
  SELECT *, sum(CASE WHEN NOT sampled AND size <= budget THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p{_i}
), f{_i} AS (
  SELECT *, NOT sampled AND size > 0 AND size <= budget AND upto <= budget AS fits FROM u{_i}
), p{_i + 1} AS (
  SELECT * EXCLUDE (upto, fits, budget, sampled), sampled OR fits AS sampled, budget - coalesce(max(CASE WHEN fits THEN upto END) OVER (PARTITION BY source), 0) AS budget FROM f{_i}"""
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    length(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', '', 'g')) AS bare,
    length(regexp_replace(coalesce(text, ''), '[^\pL]+', '', 'g')) AS letters FROM documents
), k AS (
  SELECT doc_id, source, text_key, size,
    -ln((CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_key), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / greatest({LOWEST_WEIGHT}, CASE WHEN bare > 0 THEN letters / bare ELSE 0.0 END) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l_left,
    sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST)
), c AS (
  SELECT *, source_size * 3 * rest <= weight * l_left AS capped FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE)
    ELSE CAST(weight * max(l_left) FILTER (NOT capped) OVER () AS DOUBLE) / CAST(max(rest) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM c
), e AS (
  SELECT k.doc_id, k.source, text_key, key, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), p0 AS (
  SELECT *, false AS sampled, target - epochs * source_size AS budget FROM e{_FILLS}
), g AS (
  SELECT *, NOT sampled AND size > 0 AND abs(budget - size) < budget AS nearer, abs(budget - size) AS gap FROM p{1 + FILLS}
), o AS (
  SELECT *, nearer AND row_number() OVER (PARTITION BY source, nearer ORDER BY gap, key, doc_id NULLS FIRST, text_key) = 1 AS alone FROM g
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN size > 0 AND (sampled OR alone) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


@query("op6_mixing", OP6_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3 over the sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
