"""Operator 7, language identification by a multilingual mixture.

Character n-grams (one to three, lower case, hashed to buckets) have a
multinomial per language, trained from labelled rows. For each document
expectation-maximisation estimates the proportions with which the languages
make up its n-grams. The language set is chosen by penalised likelihood:
starting from the best single language, the language that raises the
likelihood most is added while the gain exceeds half a log(n) a language (BIC).
The prediction is the language with the largest share, the score its share.

The model is fitted on a sample of ``MAX_ROWS`` labelled rows a language on
average, drawn by a hash of the id. Every row is predicted.

Defined results: a null text or one without letters gives ``und`` with score 0;
if there are no labelled rows, every row gives ``und``; a null label is not
learned from; rows whose id is null count as held out of training; repeated rows
get equal predictions; very long texts count whole; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import crc_mod, map_rows, slices, table

BUCKETS = 1 << 15
#: Bound of the training sample, for each language, and EM steps.
MAX_ROWS, STEPS, ALPHA = 5_000, 12, 0.05


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(c: np.ndarray) -> np.ndarray:
    """Hashed n-grams (n = 1, 2, 3) of code points; every character that is no letter counts as one blank."""
    if not len(c):
        return np.zeros(0, np.intp)
    c = np.where((c < 128) & ~(((c | 32) >= 97) & ((c | 32) <= 122)), np.uint32(32), c).astype(np.uint64)
    if len(c) > 1:
        c = c[(c != 32) | np.append(True, c[:-1] != 32)]
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = (c + np.uint64(1)) * mix
    two = ((one[:-1] ^ (one[:-1] >> np.uint64(29))) + c[1:]) * mix
    three = ((two[:-1] ^ (two[:-1] >> np.uint64(31))) + c[2:]) * mix
    return (np.concatenate([one, two, three]) >> np.uint64(49)).astype(np.intp)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text[:64].isalpha() else True


def count_ngrams(rows: DataFrame, lang: str, text: str) -> tuple[list[str], np.ndarray]:
    """Languages and bucket counts (language, bucket): summed in each task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for label, t in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if t:
                        if label not in totals:
                            totals[label] = np.zeros(BUCKETS, np.int64)
                        totals[label] += np.bincount(buckets(points(t)), minlength=BUCKETS)
        for label, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(partial, "lang string, bucket int, n long")
    # At most one row a bucket and language; one array a language reaches the driver.
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").collect()
    matrix = np.zeros((len(summed), BUCKETS))
    for i, row in enumerate(summed):
        for b, n in row["c"]:
            matrix[i, b] = n
    return [r["lang"] for r in summed], matrix


def train(df: DataFrame, key: str, text: str, lang: str, usable) -> tuple[list[str], np.ndarray]:
    """Languages and P(bucket | language) as (bucket, language), from a bounded sample of the labelled rows."""
    labelled = df.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # A row a language reaches the driver; with the counts at hand the sample is a filter, and no text is shuffled.
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.try_element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, MAX_ROWS / n))]), F.col(lang))
    point = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = labelled.filter(point < share).select(F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    labels, counts = count_ngrams(sample, "__lang", "__text")
    if not labels:
        return [], np.zeros((BUCKETS, 0))
    background = (counts.sum(0) + 1) / (counts.sum() + BUCKETS)
    smooth = ALPHA * BUCKETS
    return labels, np.ascontiguousarray(((counts + smooth * background) / (counts.sum(1, keepdims=True) + smooth)).T)


def mixture(likelihood: np.ndarray, weight: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages by EM, and the log-likelihood."""
    p = likelihood[:, chosen]
    share = np.full(len(chosen), 1 / len(chosen))
    if len(chosen) > 1:
        total = weight.sum()
        for _ in range(STEPS):
            r = p * share
            share = (weight / r.sum(1)) @ r / total
    return share, float(weight @ np.log(p @ share))


def proportions(text: str, model: np.ndarray) -> np.ndarray:
    """Share of each language in a text: the set grows while the penalised likelihood rises."""
    found, weight = np.unique(buckets(points(text)), return_counts=True)
    likelihood = model[found]
    logs = weight @ np.log(likelihood)
    chosen = [int(logs.argmax())]
    share, best = np.ones(1), float(logs.max())
    penalty = 0.5 * np.log(weight.sum() + 1)
    while len(chosen) < model.shape[1]:
        rest = [k for k in range(model.shape[1]) if k not in chosen]
        # A language can only help if it explains some n-grams far better than the present mixture.
        gain = [float(np.maximum(weight * (np.log(likelihood[:, k]) - np.log(likelihood[:, chosen] @ share)), 0).sum()) for k in rest]
        k = rest[int(np.argmax(gain))]
        if max(gain) < penalty:
            break
        s, value = mixture(likelihood, weight, [*chosen, k])
        if value - best <= penalty:
            break
        chosen, share, best = [*chosen, k], s, value
    out = np.zeros(model.shape[1])
    out[chosen] = share
    return out


def language_id(df: DataFrame, keys: list[str], labels: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """Main language, its share, and the set with shares (``lang:share``, largest first) of each row."""
    context = df.sparkSession.sparkContext
    sent = context.broadcast(model.astype(np.float64))  # BUCKETS x languages

    def kernel(texts: list[str | None]) -> list[tuple]:
        out = []
        for t in texts:
            if not t or not labels or not has_letter(t):
                out.append(("und", 0.0, ""))
                continue
            share = proportions(t, sent.value)
            order = sorted(np.flatnonzero(share), key=lambda k: (-share[k], labels[k]))
            out.append((labels[order[0]], float(min(1.0, share[order[0]])), ",".join(f"{labels[k]}:{share[k]:.4f}" for k in order)))
        return out

    return map_rows(df, kernel, keys, text, "lang_pred string, score double, languages string")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    labels, model = train(docs, "doc_id", "text", "lang", ~held_out)
    found = language_id(docs, ["doc_id"], labels, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op7_language_id": op7_language_id}
