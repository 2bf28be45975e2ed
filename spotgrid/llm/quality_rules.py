"""Quality rules: a threshold table compiled into one projection without user functions.

Rows: a null or empty text has no words, so it fails the base rule and is not
kept; repeated rows are judged one by one; an empty table gives an empty table;
columns named like a measure do not disturb it, since measures live in one struct
that :func:`measure` names.  A text is one row, so memory is bounded by the
longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm.common import let, text_or_empty, words_of
from spotgrid.llm.registry import query, table

# Symbols that mark junk, as the contract lists them.
SYMBOLS = "#*$%&|<>"
# Frequent short words of the four languages, in lower case.
STOP_WORDS = (
    "the and of to in is that it for on with as was are this be by at from or an not "
    "le la les de des et un une en pour que qui dans est sur au pas avec "
    "der die das und zu den mit von ist im auf ein eine nicht sich "
    "el los y por con para no del se las es"
).split()


@dataclass(frozen=True)
class Rule:
    """``lowest <= 100 * part / whole <= highest``; an absent bound always holds, and so does an empty whole."""

    name: str
    part: str
    whole: str
    lowest: int | None = None
    highest: int | None = None


#: Measures: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_stop_words.
DEFAULT_RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "word_chars", None, 5),
    Rule("stop words", "n_stop_words", "n_words", 4, 80),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 40),
)
BASE_WORDS, BASE_REPEATED = 50, 50


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Hashes of the windows find texts without any repeat, which most are; the rest
    sort the windows themselves, so that a collision of hashes changes nothing.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", words[i], words[i + 1], words[i + 2])

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda s, k: F.when(k + 1 < F.size(found), F.least(F.lit(3), F.get(found, k + 1) - s)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def twice(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1

        def same(j: Column) -> Column:
            here = sorted_windows[j]["w"]
            before = (j > 0) & (F.get(sorted_windows, j - 1)["w"] == here)
            return F.coalesce(before, F.lit(False)) | F.coalesce((j < last) & (F.get(sorted_windows, j + 1)["w"] == here), F.lit(False))

        flagged = F.filter(F.sequence(F.lit(0), last), same)
        return let(F.sort_array(F.transform(flagged, lambda j: sorted_windows[j]["i"])), covered)

    exact = let(F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), twice)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 4, 0).when(some, exact).otherwise(0)


def measures(text: Column, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """All measures of a text as one struct of longs."""

    def on_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
        )

    def on_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return F.struct(let(words_of(text), on_words).alias("words"), let(lines, on_lines).alias("lines"), symbols.alias("n_symbols"))


def _flat(m: Column) -> dict[str, Column]:
    return {
        **{k: m["words"][k] for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")},
        **{k: m["lines"][k] for k in ("n_lines", "n_dup_lines")},
        "n_symbols": m["n_symbols"],
    }


def compile_rules(m: dict[str, Column], rules: tuple[Rule, ...]) -> Column:
    """One boolean: every rule of the table holds.  Whole numbers only, so the verdict is exact."""
    verdict = F.lit(True)
    for rule in rules:
        part, whole = m[rule.part] * 100, m[rule.whole]
        if rule.lowest is not None:
            verdict = verdict & (part >= whole * rule.lowest)
        if rule.highest is not None:
            verdict = verdict & (part <= whole * rule.highest)
    return verdict


def measure(docs: DataFrame, name: str = "quality", rules: tuple[Rule, ...] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``name``: the measures, ``base_failed`` and ``kept``.

    An existing column of that name raises, as it would be overwritten.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists already")
    with_measures = docs.withColumn(name, measures(text_or_empty(text)))
    m = _flat(F.col(name))
    failed = (m["n_words"] < BASE_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * BASE_REPEATED)
    columns = [c.alias(k) for k, c in m.items()]
    return with_measures.withColumn(name, F.struct(*columns, failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept")))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns and nothing else."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return measure(docs, name, rules).where(F.col(name)["kept"]).drop(name)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP9_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words
  FROM l LEFT JOIN cov USING (r)
), f AS (
  SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1500 * n_words
    AND 100 * n_symbols <= 5 * word_chars AND 100 * n_stop_words >= 4 * n_words AND 100 * n_stop_words <= 80 * n_words
    AND 100 * n_dup_lines <= 40 * n_lines AS kept,
  n_lines, n_stop_words
FROM f
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and the verdict of the threshold table."""
    judged = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")
    return judged.select("doc_id", *(F.col("quality")[k].alias(k) for k in names))
