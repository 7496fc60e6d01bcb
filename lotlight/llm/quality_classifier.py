"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression over counts of a document's text, and over its hashed words
and pieces of words, gives its own evidence. The
evidence is summed by host and path in grouped aggregations; a host's posterior
is shrunk to the global mean and a path's to its host's, the more the fewer
documents it has, with prior strengths from the moments of the sums themselves.
A document's score adds to its own log-odds how far its path, without the
document, lies from the global mean.

The regression is fitted on at most `max_labels` labelled documents, those whose
ids hash lowest; everything else covers all documents.

Defined results: a null text counts as empty; null hosts or paths are values like
others; labels that are null are not used, of several for one document the highest counts; without labels of both classes every
document's evidence is the share of the class there is, or a half; ties don't
arise; a very long text is read whole, in one task; equal rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import durable, spread_join

# Frequent words of English, French, German and Spanish.
FREQUENT = frozenset("the of and to in a is that for it was on with as are de la le et les des en un du une que est pour dans der die und den von zu das mit auf für ist el y los del se las por con para".split())
FEATURES = ("bias", "log_words", "word_length", "upper", "digit", "symbol", "mark", "bar", "beyond_ascii", "frequent", "distinct", "top_word", "same_as_last", "repeated_lines", "odd_ends")


@dataclass(frozen=True)
class ClassifierParams:
    max_labels: int = 10_000
    ridge: float = 1.0
    rounds: int = 25
    #: How far the path's posterior moves a document's log-odds.
    site_weight: float = 0.5
    threshold: float = 0.5


#: Hashed features: words, and four characters each that begin and end a word.
HASHED = 1 << 10
LONGEST = 40


class Slots(dict):
    """The hashed features of a word as written; the table starts anew at `most` words."""

    most = 1 << 17

    def __missing__(self, word: str) -> tuple[int, ...]:
        from xxhash import xxh3_64_intdigest

        small = word[:LONGEST].lower()
        found = tuple(xxh3_64_intdigest(x, k) % HASHED for k, x in enumerate((small, f"^{small[:4]}", f"{small[-4:]}$")))
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


SLOTS = Slots()


def hashed(text: str) -> np.ndarray:
    """The share of a text's features in each slot, as square roots, so that frequent ones don't rule."""
    at = np.array([k for w in text.split() for k in SLOTS[w]], np.int64)
    return np.sqrt(np.bincount(at, minlength=HASHED) / max(len(at), 1))


SYMBOL, MARK, UPPER, DIGIT = (re.compile(x) for x in (r"[#*$%&<>@=_~^]", r"[!?]", r"[A-Z]", r"[0-9]"))


def features(text: str) -> np.ndarray:
    """FEATURES, then the hashed ones."""
    return np.concatenate([counted(text), hashed(text)])


def counted(text: str) -> list[float]:
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda pattern: len(pattern.findall(text)) / size
    return [
        1.0,
        math.log1p(len(words)) / 10,
        min(sum(map(len, words)) / n / 10, 3.0),
        share(UPPER) * 4,
        share(DIGIT) * 4,
        share(SYMBOL) * 10,
        share(MARK) * 10,
        text.count("|") / n * 4,
        (len(text.encode()) - len(text)) / size * 4,
        sum(counts[w] for w in FREQUENT & counts.keys()) / n * 4,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n * 4,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / n * 4,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, p: ClassifierParams = ClassifierParams()) -> np.ndarray:
    """Ridge-penalised weights by Newton's method; the first feature, the bias, goes free."""
    penalty = np.diag(np.append(1e-6, np.full(x.shape[1] - 1, p.ridge)))
    w = np.zeros(x.shape[1])
    for _ in range(p.rounds):
        m = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (m * (1 - m))[:, None]) + penalty, x.T @ (y - m) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, p: ClassifierParams = ClassifierParams()) -> list[float]:
    """Weights of the features for `quality` 1, from a bounded sample of labelled documents."""
    sample = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labels)  # bounded: the sample is a parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    found = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.mapInArrow(run, "doc_id long, quality int, x binary").collect())  # `max_labels` rows
    y = np.array([r[1] for r in found], float)
    if len(set(y)) < 2:
        ever = [0.0] * (len(FEATURES) + HASHED)
        ever[0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return ever
    return fit_logistic(np.array([np.frombuffer(r[2], "<f4") for r in found], float), y, p).tolist()


def evidence(docs: DataFrame, weights: list[float], host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p: each document's own chance of quality."""
    w = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") @ w for t in b.column(3)])
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], ["doc_id", "host", "path", "p"])

    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), blank(host).alias("host"), blank(path).alias("path"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, host string, path string, p double")


def _strength(mean: Column, between: Column) -> Column:
    """Pseudo-documents of a beta prior, from the variance of the groups' true means."""
    m = mean * (1 - mean) / F.greatest(between, F.lit(1e-6)) - 1
    return F.least(F.greatest(m, F.lit(1.0)), F.lit(1e6))


def _spread(groups: DataFrame, around: Column) -> Column:
    """Variance of the groups' true means around a mean, weighted by documents: what is seen less what sampling gives."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    seen = F.sum(n * (s / n - around) * (s / n - around)) / F.sum(n)
    chance = F.sum(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))) / F.sum(n)
    return F.greatest(seen - chance, F.lit(0.0))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """host, path, n, s, m (strength), host_posterior, path_posterior; and the global mean. Sums only: one row per path."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = durable(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return paths.select("host", "path", "n", "s", F.lit(1.0).alias("m"), F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), 0.5
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6)
    host_m = hosts.agg(_strength(F.lit(mean), _spread(hosts, F.lit(mean))).alias("m")).first()["m"]
    hosts = hosts.select("host", ((F.col("s") + host_m * mean) / (F.col("n") + host_m)).alias("host_posterior"))
    joined = paths.join(hosts, "host")
    path_m = joined.agg(_strength(F.lit(mean), _spread(joined, F.col("host_posterior"))).alias("m")).first()["m"]
    out = joined.withColumns({"m": F.lit(path_m), "path_posterior": (F.col("s") + path_m * F.col("host_posterior")) / (F.col("n") + path_m)})
    return out.select("host", "path", "n", "s", "m", "host_posterior", "path_posterior"), mean


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, p: ClassifierParams = ClassifierParams()) -> DataFrame:
    """doc_id, host, path, doc_score, host_posterior, path_posterior, score, keep."""
    scored = durable(evidence(docs, fit(docs, labels, p), host, path))
    sites, mean = posteriors(scored)
    df = spread_join(scored, sites, ["host", "path"], F.col("doc_id"), how="inner")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    others = (F.col("s") - F.col("p") + F.col("m") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("m"))
    odds = logit(F.col("p")) + p.site_weight * (logit(others) - math.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-odds))
    return df.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", score.alias("score"), (score >= p.threshold).alias("keep"))
