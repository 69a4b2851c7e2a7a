"""Operator 10, quality rules with adaptive thresholds (DataFrame functions only).

Each language and source gets its own cut-offs: mergeable KLL sketches of the
rule measures, one a group, are built in one aggregation (partial sketches merge
across tasks, so a hot group never sits in one task), quartiles are read from
them, and a row fails if a measure lies beyond the outer fence
``q3 + FENCE * max(q3 - q1, floor)`` (or below ``q1 - ...`` for the mean word
length). The thresholds join back on the group, a row a group.

Measures are computed once and written to the checkpoint folder, as both the
sketches and the join read them.

Defined results: a null text counts as empty (no words, so base_failed); null
languages and sources form groups of their own; a group of fewer than
``LEAST_ROWS`` rows takes the thresholds of the whole table; repeated rows give
equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import SPACE, checkpointed, table

SYMBOLS = "#*$%&|<>"
LEAST_ROWS, FENCE = 50, 6.0
#: measure: (least spread that a fence assumes, whether low values fail too).
MEASURES = {"symbol_share": (0.01, False), "dup_line_share": (0.05, False), "repeat_share": (0.05, False), "mean_chars": (0.5, True)}


def words_of(text: Column) -> Column:
    """Words of a text by the contract's white space; no empty ones."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\x09-\\x0D]+"))


def _covered(at: Column) -> Column:
    """Words that windows at these places cover, each once."""
    return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda x: x + 1), F.transform(at, lambda x: x + 2))))


def measures(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, n_words and the four counts of the contract.

    Windows of three words become hashes; sorted, equal ones are neighbours,
    which gives the hashes that occur twice or more. A few of them are looked
    up in the text's windows directly. For many, windows are sorted again, with
    their places beside the whole hashes. Each step is a projection of its own,
    so that none is computed twice.
    """
    few = 24
    base = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    split = base.select(*keys, "__t", words_of(F.col("__t")).alias("__w"), F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__l"))
    counted = split.select(
        *keys,
        "__w",
        F.size("__w").alias("__n"),
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("__lines"),
    )
    kept = [*keys, "__n", "word_chars", "n_symbols", "n_dup_lines", "__lines"]
    n = F.col("__n")
    zipped = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.greatest(n, F.lit(1))).alias("b"), F.slice("__w", F.lit(3), F.greatest(n, F.lit(1))).alias("c"))
    hashed = counted.select(*kept, F.slice(F.transform(zipped, lambda x: F.xxhash64(x)), F.lit(1), F.greatest(n - 2, F.lit(0))).alias("__h"))
    ordered = hashed.select(*kept, "__h", F.sort_array("__h").alias("__o"))
    neighbours = F.filter(F.arrays_zip(F.col("__o").alias("a"), F.slice("__o", F.lit(2), F.greatest(n, F.lit(1))).alias("b")), lambda x: x["a"] == x["b"])
    twice = ordered.select(*kept, "__h", F.array_distinct(neighbours["a"]).alias("__d"))
    placed = F.when(F.size("__d") > few, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    packing = twice.select(*kept, "__h", "__d", placed.alias("__p"))
    found = F.filter(F.transform("__h", lambda x, i: F.when(F.array_contains("__d", x), i)), lambda i: i.isNotNull())
    pairs = F.filter(F.arrays_zip(F.col("__p").alias("a"), F.slice("__p", F.lit(2), F.greatest(n, F.lit(1))).alias("b")), lambda x: x["a"]["h"] == x["b"]["h"])
    many = F.concat(pairs["a"]["i"], pairs["b"]["i"])
    repeated = F.when(F.size("__d") == 0, F.lit(0)).when(F.size("__d") <= few, _covered(found)).otherwise(_covered(many))
    return packing.select(*keys, F.col("__n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "__lines")


def shares(df: DataFrame) -> DataFrame:
    some = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "*",
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / some).alias("repeat_share"),
        (F.col("word_chars") / some).alias("mean_chars"),
    )


def fences(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per group its rows and a low and a high bound a measure, from KLL sketches."""
    sketched = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"), *[F.call_function("kll_sketch_agg_double", F.col(m)).alias(m) for m in MEASURES])
    out = [*groups, "__rows"]
    for m, (floor, _) in MEASURES.items():
        q1, q3 = (F.call_function("kll_sketch_get_quantile_double", F.col(m), F.lit(q)) for q in (0.25, 0.75))
        spread = F.lit(FENCE) * F.greatest(q3 - q1, F.lit(floor))
        out += [(q1 - spread).alias(f"__low_{m}"), (q3 + spread).alias(f"__high_{m}")]
    return sketched.select(*out)


def quality_rules(df: DataFrame, keys: list[str], groups: list[str], text: str = "text") -> DataFrame:
    """The counts, base_failed and kept of each row."""
    named = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(g).cast("string").alias(f"__g{i}") for i, g in enumerate(groups)], F.col(text).alias("__text"))
    ks, gs = [f"__k{i}" for i in range(len(keys))], [f"__g{i}" for i in range(len(groups))]
    measured = shares(checkpointed(measures(named, ks + gs, "__text")))
    own = fences(measured, gs).filter(F.col("__rows") >= LEAST_ROWS).drop("__rows")
    whole = fences(measured, []).drop("__rows")
    whole = whole.select(*[F.col(c).alias(f"{c}_all") for c in whole.columns])
    joined = measured.alias("a").join(own.alias("b"), [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in gs], "left").drop(*[F.col(f"b.{g}") for g in gs])
    # One row for the whole table.
    joined = joined.join(F.broadcast(whole), how="left", on=F.lit(True))
    fails = F.lit(False)
    for m, (_, low) in MEASURES.items():
        fails = fails | (F.col(m) > F.coalesce(f"__high_{m}", f"__high_{m}_all"))
        if low:
            fails = fails | (F.col(m) < F.coalesce(f"__low_{m}", f"__low_{m}_all"))
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return joined.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~F.coalesce(fails, F.lit(False))).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"], ["lang", "source"])


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express: all but the verdict."""
    return op10_quality_rules(spark, sf_dir).drop("kept")


QUERIES = {"op10_quality_rules": op10_quality_rules, "base_quality_counts": base_quality_counts}
ORACLE_SQL = {
    "base_quality_counts": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) s),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) r WHERE c > 1) q GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN cov USING (doc_id)"""
}
