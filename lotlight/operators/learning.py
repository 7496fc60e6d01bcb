"""Folds, candidates, cross-validated leaderboards, tuning and soft votes with Spark ML."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlight.operators import forest, linear, metrics

MODELS = ("logreg", "rf", "svm", "xgb")
# What tuning tries. A depth of 30 is the deepest there is here.
GRIDS: dict[str, dict[str, list]] = {
    "logreg": {"C": [0.01, 0.1, 1, 10]},
    "rf": {"numTrees": [200, 500], "maxDepth": [30, 20], "minInstancesPerNode": [1, 3]},
    "svm": {"C": [1, 10, 100], "gamma": ["scale", 0.001, 0.01]},
    "xgb": {"maxIter": [200, 500], "maxDepth": [4, 6, 8], "stepSize": [0.05, 0.1]},
}


def draw(*key: str, seed: int = 0) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def _dealt(df: DataFrame, key: str, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """`df` with _slice, one of 256 by its draw, and _place within label and slice; and label, _slice, _n, _before (rows in earlier
    slices), _all (rows of the label). So the rows of a label are ordered without being in one task."""
    h = draw(key, seed=seed)
    cut = df.withColumn("_h", h).withColumn("_slice", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h", key))).drop("_h")
    sizes = cut.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(label))})
    return placed, sizes


def in_order(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """`df` with _rank: the place of each row among its label's in the order of `draw`; and _all, their number."""
    placed, sizes = _dealt(df, key, label, seed)
    return placed.join(F.broadcast(sizes), [label, "_slice"]).withColumn("_rank", F.col("_before") + F.col("_place")).drop("_slice", "_place", "_n", "_before")  # 256 rows a label


def subsample(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each label."""
    return in_order(df, key, label, seed).where(F.col("_rank") <= n).select(df.columns)


def holdout(df: DataFrame, group: str, label: str, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """`df` with part: train or test by whole groups if both parts then have both labels, else by rows of each label."""
    groups = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(draw(group, seed=seed), group)  # a row for each group
    groups = groups.withColumn("_test", F.row_number().over(order) <= F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(F.lit(0))) * share)))
    sides = groups.groupBy("_test").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()  # two rows at most
    if len(sides) == 2 and all(0 < s["pos"] < s["n"] for s in sides):
        marked = df.join(groups.select(group, "_test"), group)
    else:
        marked = in_order(df, key, label, seed).withColumn("_test", F.col("_rank") <= F.ceil(F.col("_all") * share))
    return marked.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).select(*df.columns, "part")


def folds(df: DataFrame, group: str, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """`df` with fold 0 to k - 1: whole groups dealt to and fro by their share of label 1, then size, if there are k of them; else
    rows of each label dealt round. Either way folds have like shares of the labels."""
    groups = df.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("share"))
    if groups.limit(k).count() >= k:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("share"), F.desc("n"), group)) - 1  # a row for each group
        turn = F.pmod(place, F.lit(2 * k))
        return df.join(groups.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold")), group)
    return in_order(df, key, label, seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


def group_or_frame(df: DataFrame, group: str, frame: str, k: int) -> DataFrame:
    """`df` with cv_group: the group, or group and frame where there are fewer than k + 2 groups."""
    few = df.select(group).distinct().limit(k + 2).count() < k + 2
    return df.withColumn("cv_group", F.concat_ws("/", group, frame) if few else F.col(group).cast("string"))


def fourier(df: DataFrame, source: str, out: str, width: int, n: int = 128, gamma: float = 0.05, seed: int = 0) -> DataFrame:
    """Random Fourier features of a vector column: a linear model on them approximates an RBF kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (width, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def run(v):
        import pandas as pd

        x = np.stack(v.to_numpy()) if len(v) else np.empty((0, width))
        return pd.Series(list(np.sqrt(2 / n) * np.cos(x @ w + b)))

    return df.withColumn(out, array_to_vector(run(vector_to_array(source))))


@dataclass
class Candidate:
    """A feature set (columns of `features`) and a model; `settings` (those of GRIDS, and the estimator's own) replace its defaults."""

    name: str
    columns: list[int]
    model: str
    settings: dict = field(default_factory=dict)
    small: bool = False

    def estimator(self, n: int):
        """For n rows: a penalty of 1 / C on the sum of losses is one of 1 / (C n) on their mean."""
        c = {"featuresCol": "x", "labelCol": "label"}
        own = {k: v for k, v in self.settings.items() if k not in ("C", "gamma")}
        reg = lambda least: 1 / (self.settings.get("C", least) * max(n, 1))
        if self.model == "logreg":
            return LogisticRegression(**{**c, "maxIter": 100, "regParam": reg(1.0), **own})
        if self.model == "xgb":
            return GBTClassifier(**{**c, "maxIter": 10 if self.small else 300, "maxDepth": 3 if self.small else 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 0, **own})
        if self.model == "svm":
            return LinearSVC(**{**c, "maxIter": 30, "regParam": reg(10.0), **own})
        raise ValueError(f"no model is called {self.model}")

    def fit(self, df: DataFrame) -> Fitted:
        width = len(self.columns)
        linear = self.model in ("logreg", "svm")
        stages: list = [VectorSlicer(inputCol="features", outputCol="_part" if linear else "x", indices=self.columns)]
        if linear:
            stages.append(StandardScaler(inputCol="_part", outputCol="x", withMean=True))
        if self.model == "svm" and width > 300:
            stages[-1].setOutputCol("_scaled")
            stages.append(PCA(k=_components(stages, df), inputCol="_scaled", outputCol="x"))
        before = Pipeline(stages=stages).fit(df)
        ready, gamma = before.transform(df), 0.0
        if self.model == "svm":
            width = len(ready.select("x").first()["x"])
            gamma = self.settings.get("gamma", "scale")
            gamma = 1 / width if gamma == "scale" else float(gamma)
            ready = fourier(ready.withColumnRenamed("x", "_x"), "_x", "x", width, gamma=gamma)
        if self.model == "rf":
            names = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "least", "seed": "seed"}
            own = {"trees": 20 if self.small else 300, "depth": 5 if self.small else 20, **{names[k]: v for k, v in self.settings.items()}}
            return Fitted(self, before, forest.fit(ready, **own), width)
        return Fitted(self, before, self.estimator(df.count()).fit(ready), width, gamma)


    def fit_blocks(self, rows: DataFrame, blocks: list[str] | tuple[str, ...]) -> Fitted:
        """A logreg candidate from rows at hand (label, and blocks of floats that are side by side the features), which are never made vectors."""
        columns = np.array(self.columns)
        line = linear.fit(rows.select("label", *blocks), 1 / self.settings.get("C", 1.0), make=lambda c: linear.matrix(c)[:, columns])
        spark_ml, gateway = rows.sparkSession._jvm.org.apache.spark.ml, rows.sparkSession.sparkContext._gateway

        def vector(values: np.ndarray):
            made = gateway.new_array(gateway.jvm.double, len(values))
            for k, v in enumerate(values.tolist()):
                made[k] = v
            return spark_ml.linalg.Vectors.dense(made)

        weights = line.weights * line.deviation
        scaler = StandardScalerModel(spark_ml.feature.StandardScalerModel("scaler", vector(line.deviation), vector(line.mean)))
        model = LogisticRegressionModel(spark_ml.classification.LogisticRegressionModel("logreg", vector(weights), float(line.offset + line.weights @ line.mean)))
        scaler = scaler._set(withMean=True).setInputCol("_part").setOutputCol("x")
        return Fitted(self, PipelineModel([VectorSlicer(inputCol="features", outputCol="_part", indices=self.columns), scaler]), model.setFeaturesCol("x"), len(self.columns))


def _components(stages: list, df: DataFrame, share: float = 0.95) -> int:
    scaled = Pipeline(stages=stages).fit(df).transform(df)
    seen = PCA(k=min(300, len(scaled.first()["_scaled"])), inputCol="_scaled", outputCol="_p").fit(scaled).explainedVariance.toArray()
    return int(np.searchsorted(np.cumsum(seen), share)) + 1 if seen.sum() >= share else len(seen)


@dataclass
class Fitted:
    candidate: Candidate
    before: PipelineModel
    model: object
    width: int
    gamma: float = 0.0

    def line(self, n: int) -> linear.Line | None:
        """The same score as one sum over all n features, if the model is a regression on scaled values."""
        if self.candidate.model != "logreg":
            return None
        scaler, columns = self.before.stages[-1], self.candidate.columns
        mean, deviation, own = scaler.mean.toArray(), scaler.std.toArray(), self.model.coefficients.toArray()
        part = np.divide(own, deviation, out=np.zeros(len(own)), where=deviation > 0)
        weights = np.zeros(n)
        np.add.at(weights, columns, part)
        return linear.Line(weights, float(self.model.intercept - part @ mean), np.zeros(n), np.ones(n))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """`df` with the chance of label 1, or the sigmoid of the margin."""
        ready = self.before.transform(df)
        if self.candidate.model == "svm":
            ready = fourier(ready.withColumnRenamed("x", "_x"), "_x", "x", self.width, gamma=self.gamma)
        if isinstance(self.model, forest.Forest):
            return self.model.score(ready, "x", "_s").select(*df.columns, F.col("_s").alias(out))
        done = self.model.transform(ready)
        raw = vector_to_array("probability")[1] if "probability" in done.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return done.withColumn("_s", raw).select(*df.columns, F.col("_s").alias(out))


def soft_vote(members: list[Fitted], df: DataFrame, out: str = "score") -> DataFrame:
    names = [f"_m{k}" for k in range(len(members))]
    scored = reduce(lambda d, m: m[1].score(d, m[0]), zip(names, members), df)
    return scored.withColumn(out, reduce(lambda a, b: a + b, map(F.col, names)) / len(names)).drop(*names)


def fold_scores(df: DataFrame, fits, k: int) -> DataFrame:
    """fold, accuracy, precision, recall, f1, roc_auc of what `fits` (train -> scorer of a frame) makes on each fold."""
    parts = [fits(df.where(F.col("fold") != i))(df.where(F.col("fold") == i)).select("fold", F.col("label").cast("int").alias("truth"), "score") for i in range(k)]
    every = reduce(DataFrame.unionByName, parts).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.ratios(metrics.confusion(every, ["fold"])).join(metrics.roc_auc(every, ["fold"]), "fold", "left")


SCORES = ("accuracy", "precision", "recall", "f1", "roc_auc")


def board_row(scores: DataFrame, c: Candidate, fit_s: float) -> DataFrame:
    cols = [x for s in SCORES for x in (F.avg(s).alias(f"cv_{s}"), F.stddev_pop(s).alias(f"cv_{s}_std"))]
    named = [F.lit(c.name).alias("candidate"), F.lit(c.model).alias("model"), F.lit(len(c.columns)).alias("n_features")]
    return scores.agg(*cols).select(*named, "*", F.lit(fit_s).alias("fit_s"), F.lit(None).cast("double").alias("latency_ms"))


def cross_validate(df: DataFrame, candidates: list[Candidate], k: int) -> DataFrame:
    """The leaderboard of candidates over `fold`, ranked; one small row each."""
    return metrics.leaderboard(reduce(DataFrame.unionByName, [_judged(df, c, lambda t, c=c: c.fit(t).score, k) for c in candidates]))


def _judged(df: DataFrame, c: Candidate, fits, k: int) -> DataFrame:
    """A board row, worked out at once so that the time of fits and folds can be told."""
    began = time.perf_counter()
    scores = fold_scores(df, fits, k).collect()  # k rows
    spent = (time.perf_counter() - began) / k
    return board_row(df.sparkSession.createDataFrame(scores, "fold int, tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double, roc_auc double"), c, spent)


def latency_ms(score, df: DataFrame, n: int = 200, repeats: int = 3) -> float:
    """Median milliseconds a row of scoring n rows that are at hand, after one call to warm up; a job's start-up counts."""
    rows = df.limit(n).persist()
    size, spent = max(rows.count(), 1), []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        score(rows).select("score").write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - began)
    rows.unpersist()
    return 1000 * float(np.median(spent[1:])) / size


def tune(df: DataFrame, c: Candidate, k: int, grid: dict[str, list] | None = None) -> tuple[dict, float]:
    """The settings of best mean f1 over `fold`, the first of equals, and that f1: the candidate itself, scaling and all, is fitted with each."""
    grid = GRIDS[c.model] if grid is None else grid
    tried = [dict(zip(grid, values)) for values in product(*grid.values())]
    f1 = lambda settings: fold_scores(df, lambda t: replace(c, settings={**c.settings, **settings}).fit(t).score, k).agg(F.avg("f1")).first()[0]
    found = [f1(settings) for settings in tried]
    at = int(np.argmax(found))
    return tried[at], float(found[at])


@dataclass
class Selection:
    board: DataFrame
    winner: str
    #: Scores of the winner on the part held out.
    test: DataFrame
    #: The same of the five best, for the report alone.
    top: DataFrame
    models: dict


def run_selection(df: DataFrame, candidates: list[Candidate], k: int = 5, ensemble_top: int = 3, min_gain: float = 0.002, tune_top: int = 0, report_top: int = 5, grids: dict[str, dict[str, list]] | None = None) -> Selection:
    """Hold out, cross-validate, time the best, tune them, vote, choose by cross-validation alone, test once. `df` has key, grp, label, features."""
    parts = holdout(df, "grp", "label", "key")
    train, test = folds(parts.where("part = 'train'"), "grp", "label", "key", k).persist(), parts.where("part = 'test'").persist()
    named = {c.name: c for c in candidates}
    spark, ready = df.sparkSession, {}

    def fits(name: str, t: DataFrame):
        """A scorer; of an ensemble, the vote of its members, each fitted anew."""
        members = votes.get(name, [name])
        fitted = [named[m].fit(t) for m in members]
        return (lambda d: soft_vote(fitted, d)), fitted

    def whole(name: str):
        if name not in ready:
            ready[name] = fits(name, train)
        return ready[name]

    def timed(board: DataFrame, names: list[str]) -> DataFrame:
        ms = spark.createDataFrame([(n, latency_ms(whole(n)[0], test)) for n in names], "candidate string, ms double")
        return metrics.leaderboard(board.drop("rank").join(F.broadcast(ms), "candidate", "left").withColumn("latency_ms", F.coalesce("ms", "latency_ms")).drop("ms").select(board.drop("rank").columns))

    top = lambda board, n: [r["candidate"] for r in board.orderBy("rank").limit(n).select("candidate").collect()]
    votes: dict[str, list[str]] = {}
    board = cross_validate(train, candidates, k)
    board = timed(board, top(board, max(tune_top, ensemble_top, report_top)))
    for name in top(board, tune_top):
        c = named[name]
        settings, _ = tune(train, c, k, (grids or GRIDS)[c.model])
        if settings.items() <= c.settings.items():
            continue
        tuned = replace(c, name=f"{name} (tuned)", settings={**c.settings, **settings})
        named[tuned.name] = tuned
        row = _judged(train, tuned, lambda t, c=tuned: c.fit(t).score, k)
        board = timed(board.drop("rank").unionByName(row), [tuned.name])
    if ensemble_top > 1:
        members = [r["candidate"] for r in metrics.best_of_families(board, ensemble_top).collect()]  # ensemble_top rows
        together = Candidate(f"ensemble[{' + '.join(members)}]", candidates[0].columns, "soft-vote")
        votes[together.name] = members
        row = _judged(train, together, lambda t: fits(together.name, t)[0], k)
        board = timed(board.drop("rank").unionByName(row), [together.name])
    winner = metrics.chosen(board, min_gain).first()["candidate"]
    scores = lambda name: metrics.ratios(metrics.confusion(p := _predicted(whole(name)[0](test)))).crossJoin(metrics.roc_auc(p.withColumn("one", F.lit(1)), ["one"]).drop("one")).select(F.lit(name).alias("candidate"), "*")
    report = reduce(DataFrame.unionByName, [scores(name) for name in top(board, report_top)])
    fitted = dict(zip(votes.get(winner, [winner]), whole(winner)[1]))
    return Selection(board, winner, scores(winner), report, fitted)


def _predicted(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("label").cast("int").alias("truth"), (F.col("score") >= 0.5).cast("int").alias("pred"), "score")


def window_sizes(boxes: DataFrame, k: int = 5, runs: int = 10) -> list[tuple[int, int]]:
    """Typical widths and heights: k-means over their logarithms, the best of `runs` starts."""
    wh = boxes.select(array_to_vector(F.array(F.log("w"), F.log("h"))).alias("features")).persist()
    k = min(k, boxes.select(F.bround("w"), F.bround("h")).distinct().limit(k).count())
    if k < 2:
        row = boxes.agg(F.exp(F.avg(F.log("w"))).alias("w"), F.exp(F.avg(F.log("h"))).alias("h")).first()
        return [(round(row["w"]), round(row["h"]))] if row["w"] else []
    fits = [KMeans(k=k, seed=s).fit(wh) for s in range(runs)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return sorted({(int(round(np.exp(a))), int(round(np.exp(b)))) for a, b in best.clusterCenters()})
