"""Operator 8, toxicity by maximum-scoring segments.

Token scores are log-odds of toxic against clean documents under nested
Dirichlet priors: a word's rate is drawn towards that of its prefix of six
letters, that towards five, four and three letters, and those towards the share
of toxic documents. A token scores the lower credible bound of its log-odds;
tokens without evidence score ``-DRIFT``. A linear-time scan (Ruzzo and Tompa)
finds every maximal-scoring passage. Scores of passages in clean text follow an
extreme-value law (Karlin and Altschul): lambda and K are fitted on clean rows
that gave no counts, each passage's surplus is ``lambda * S - ln(K * n)``, and a
logistic curve fitted on the same rows turns the sum of the positive surpluses
into a probability.

Counts come from a bounded sample of labelled rows (``MAX_ROWS``, smallest hash
of the id); every row is scored on its whole text.

Defined results: a null or empty text has no passages and gets the score of
that; without labelled rows of both kinds every score is the share of toxic
rows (0 without any); repeated ids in the labels are separate examples; very
long texts are scanned whole in time in proportion to them; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import checkpointed, crc_mod, holds, map_rows, slices, table

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Bound of the labelled sample; weight of a prior; credible bound in standard deviations; score of a token without evidence.
MAX_ROWS, PRIOR, BOUND, DRIFT, HIGHEST = 40_000, 10.0, 4.0, 0.25, 6.0
BINS = 64  # of positive scores
LEAST_TOXIC = 3  # toxic rows that a feature needs to score above zero
PER_WORD = 2
CACHE_WORDS = 50_000


def features(word: str) -> list[str]:
    """The word and its prefixes, longest first; prefixes end in ``*``."""
    return [word, *[word[:k] + "*" for k in reversed(PREFIXES) if len(word) > k]]


def count_features(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """feature: (toxic rows, clean rows) of rows (text, label).

    A prefix counts each of its words ``PER_WORD`` times at most, so that it
    stands for many words and not for a single frequent one. Tasks sum before
    the shuffle; what reaches the driver is bounded by the sample's vocabulary.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, 0):
                for text, label in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for w in set(WORD.findall((text or "").lower())):
                        counts.setdefault(w, [0, 0])[1 - label] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "t", "c"])

    words = rows.mapInArrow(partial, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    prefixes = F.array_compact(F.array(*[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in PREFIXES]))
    whole = F.array(F.struct(F.col("word").alias("feature"), "t", "c"))
    part = F.transform(prefixes, lambda x: F.struct(x.alias("feature"), F.least("t", F.lit(PER_WORD)).alias("t"), F.least("c", F.lit(PER_WORD)).alias("c")))
    found = words.select(F.inline(F.concat(whole, part))).groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") >= LEAST_TOXIC)
    return {r["feature"]: (r["t"], r["c"]) for r in found.collect()}


def log_odds(counts: dict[str, tuple[int, int]], share: float) -> dict[str, float]:
    """Positive scores by feature: lower bounds of log-odds under the nested priors."""
    root = math.log(share / (1 - share))
    rates: dict[str, float] = {}

    def parent(f: str) -> float:
        word = f.rstrip("*")
        for k in reversed(PREFIXES):
            if len(word) > k and (p := word[:k] + "*") in rates:
                return rates[p]
        return share

    for f in sorted(counts, key=lambda f: (not f.endswith("*"), len(f))):
        t, c = counts[f]
        rates[f] = (t + PRIOR * parent(f)) / (t + c + PRIOR)
    out = {}
    for f, q in rates.items():
        t, c = counts[f]
        s = math.log(q / (1 - q)) - root - BOUND * math.sqrt(1 / (t + PRIOR * share) + 1 / (c + PRIOR * (1 - share)))
        out[f] = min(s, HIGHEST)
    return out


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal-scoring passage (first token, last token, score), in order.

    ``scored``: tokens with positive scores by position; all others score
    ``-drift``. The stack holds (score before it, score with it, first, last, place
    of the nearest passage below that begins lower); a search goes from link to
    link, and what it has passed it never meets again: linear time.
    """
    stack: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for i, s in scored:
        total -= drift * (i - at)
        low, first = total, i
        total, at = total + s, i + 1
        high = total
        while True:
            # The nearest passage that begins lower: those in between never can be joined later.
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, first, i, j))
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, h - low) for low, h, a, b, _ in stack]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  # features with evidence
    share: float
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0

    def token(self, word: str) -> float:
        for f in features(word):
            if f in self.scores:
                return self.scores[f]
        return -DRIFT


class Scorer:
    """A model with a bounded cache of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def scored(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and the positions and scores of those above zero."""
        words = WORD.findall((text or "").lower())
        cache = self.cache
        if unknown := [w for w in set(words) if w not in cache]:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                unknown = list(set(words))
            cache.update((w, self.model.token(w)) for w in unknown)
        found, seen = [(i, s) for i, s in enumerate([cache[w] for w in words]) if s > 0], set()
        # A word is evidence once: its repeats score as tokens without evidence.
        return len(words), [x for x in found if words[x[0]] not in seen and not seen.add(words[x[0]])]

    def passages(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Probability, tokens, and the significant passages (first token, last token, surplus)."""
        m = self.model
        n, scored = self.scored(text)
        found = [(a, b, x) for a, b, s in maximal_segments(scored, DRIFT) if (x := m.lam * s - math.log(m.k * max(n, 1))) > 0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.a + m.b * math.log1p(sum(x for *_, x in found)))))), n, found


def root_of_extremes(hist: np.ndarray, tokens: int) -> tuple[float, bool]:
    """The lambda that solves E[exp(lambda * score)] = 1 over clean tokens, whose positive scores are counted in BINS equal bins up to HIGHEST; and whether there is one.

    One token of a middling score is added, so that text without any positive score has a root.
    """
    edges = np.linspace(0, HIGHEST, BINS + 1)
    hist = hist + np.histogram([2.0], bins=edges)[0]
    mid, share = (edges[:-1] + edges[1:]) / 2, hist / (tokens + 1)

    def excess(lam: float) -> float:
        return float(share @ np.exp(lam * mid) + (1 - share.sum()) * math.exp(-lam * DRIFT) - 1)

    low, high = 1e-3, 20.0
    if excess(low) >= 0:
        return low, False
    for _ in range(80):
        mean = (low + high) / 2
        low, high = (mean, high) if excess(mean) < 0 else (low, mean)
    return low, True


def fit_extremes(seen: DataFrame) -> tuple[float, float]:
    """lambda and K of the clean ones of rows (__label, n, positive, passages). Only a histogram and sums reach the driver.

    K comes from the mean of the rows' best passages.
    """
    clean = seen.filter("__label = 0")
    bin_ = F.least(F.floor(F.col("s") / HIGHEST * BINS), F.lit(BINS - 1)).cast("int")
    hist = np.zeros(BINS)
    for r in clean.select(F.explode("positive").alias("s")).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c")).collect():
        hist[r["bin"]] = r["c"]
    sizes = clean.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    if not sizes["rows"]:
        return 1.0, 1.0
    lam, found = root_of_extremes(hist, sizes["tokens"])
    if not found:
        return lam, 1.0
    best = clean.filter((F.size("passages") > 0) & (F.col("n") > 0)).agg(F.count(F.lit(1)).alias("c"), F.avg(F.least(F.lit(50.0), F.array_max("passages") * lam) - F.ln("n")).alias("mean")).first()
    if not best["c"]:
        return lam, 1e-3
    # Rows without a passage lie below the law's mode: the share of rows with one bounds K * n * exp(-lambda * s).
    return lam, min(1.0, max(1e-4, best["c"] / sizes["rows"] * math.exp(best["mean"])))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic regression, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, counted: Column, calibrated: Column) -> Model:
    """A model from labelled rows: counts from those in ``counted``, the laws and the curve from those in ``calibrated`` (conditions on ``key``)."""
    usable = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"), F.when(counted, 0).when(calibrated, 1).alias("__fold"))
    usable = usable.filter(F.col("__fold").isNotNull() & F.col("__label").isin(0, 1))
    sample = usable.orderBy(F.xxhash64("__key"), "__key", "__label").limit(MAX_ROWS)
    # At most MAX_ROWS rows of three numbers: a bounded broadcast.
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), "__key").select("__text", "__label", "__fold")
    sizes = {(r["__fold"], r["__label"]): r["count"] for r in sample.groupBy("__fold", "__label").count().collect()}
    toxic, clean = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    if not toxic or not clean:
        every = sum(sizes.values())
        share = sum(n for (_, y), n in sizes.items() if y) / every if every else 0.0
        return Model({}, share, a=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    share = toxic / (toxic + clean)
    model = Model(log_odds(count_features(rows.filter("__fold = 0").select("__text", "__label")), share), share)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[str | None]) -> list[tuple]:
        scorer = Scorer(sent.value)
        out = []
        for t in texts:
            n, scored = scorer.scored(t)
            out.append((n, [s for _, s in scored], [s for *_, s in maximal_segments(scored, DRIFT)]))
        return out

    # Read several times; written, so that the bounded sample's texts are scored once.
    seen = checkpointed(map_rows(rows.filter("__fold = 1").withColumnRenamed("__text", "text"), kernel, ["__label"], "text", "n long, positive array<double>, passages array<double>"))
    lam, k = fit_extremes(seen)
    surplus = F.aggregate("passages", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), s * lam - F.ln(F.greatest("n", F.lit(1)) * k)))
    # Two numbers a row of the bounded sample.
    points = seen.select(F.log1p(surplus).alias("x"), "__label").collect()
    x, y = np.array([r["x"] for r in points]), np.array([r["__label"] for r in points], float)
    a, b = fit_curve(x, y) if len(set(y)) == 2 else (math.log(share / (1 - share)), 1.0)
    return Model(model.scores, share, lam, k, a, b)


def toxicity(df: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """Probability, verdict and the significant passages (``first-last:surplus`` in tokens) of each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # features with LEAST_TOXIC toxic rows of a bounded sample

    def kernel(texts: list[str | None]) -> list[tuple]:
        holds("toxicity", _scorer.clear)
        # The model is held with its scorer, so that no other can take its place in memory.
        if not _scorer or _scorer[0] is not sent.value:
            _scorer[:] = [sent.value, Scorer(sent.value)]
        scorer = _scorer[1]
        out = []
        for t in texts:
            p, _, found = scorer.passages(t)
            out.append((p, int(p >= 0.5), ",".join(f"{a}-{b}:{x:.2f}" for a, b, x in found)))
        return out

    return map_rows(df, kernel, keys, text, "score double, predicted int, passages string")


_scorer: list = []


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """The model of the query: rows whose crc32(id) mod 5 is 0 give nothing, those of 4 calibrate."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    part = crc_mod("doc_id", 5)
    return fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", part.isin(1, 2, 3), part == 4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), ["doc_id"], trained(spark, sf_dir))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "passages")


QUERIES = {"op8_toxicity": op8_toxicity}
