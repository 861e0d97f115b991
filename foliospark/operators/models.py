"""Scores by windows, MLlib baselines on fixed splits, batch scoring."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foliospark.operators.scan import running
from foliospark.sources.store import stage

#: Rows that a fit and an evaluation need, and positives in each split for a tail classifier.
TRAIN_ROWS, EVAL_ROWS, TAIL_EVENTS = 50, 20, 15


def regression_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE and R-squared of (y, yhat); R-squared is null where y doesn't vary."""
    e = F.col("y") - F.col("yhat")
    out = rows.where("y IS NOT NULL AND yhat IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst"))
    return out.withColumn("r2", 1 - F.try_divide(F.col("sse"), F.col("sst"))).drop("sse", "sst")


def roc_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chance that a positive's score is above a negative's, ties half. Counts a distinct score
    first, then takes one running sum over ranges of scores: not over pairs, not in one task."""
    per = rows.where("y IS NOT NULL AND score IS NOT NULL").groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    below = running(per, by, ["score"], sums={"below": F.col("neg")})
    wins = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    return below.withColumn("wins", wins).groupBy(*by).agg(X_div(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def X_div(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def average_precision(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Sum of precision at every positive over the positives, scores falling, ties by ``tie``;
    places and hits are running sums over ranges of scores."""
    y = F.col("y").cast("long")
    ranked = running(rows.where("y IS NOT NULL AND score IS NOT NULL"), by, [F.desc("score"), tie], sums={"hits": y, "place": F.lit(1)})
    ranked = ranked.withColumn("precision", F.when(y == 1, (F.col("hits") + 1) / (F.col("place") + 1)))
    return ranked.groupBy(*by).agg(X_div(F.sum("precision"), F.sum(F.col("y").cast("long"))).alias("average_precision"))


def classification_scores(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Prevalence, Brier score, precision and recall at a threshold (0 where undefined)."""
    y, hit = F.col("y").cast("long"), F.col("score") >= threshold
    tp = F.count_if(hit & (y == 1))
    zero = lambda a, b: F.coalesce(X_div(a, b), F.lit(0.0))
    e = F.col("score") - y
    return rows.where("y IS NOT NULL AND score IS NOT NULL").groupBy(*by).agg(F.avg(y.cast("double")).alias("prevalence"), F.avg(e * e).alias("brier"), zero(tp, F.count_if(hit)).alias("precision"), zero(tp, F.sum(y)).alias("recall"))


def target_profile(dataset: DataFrame, target: str) -> DataFrame:
    t = F.col(target)
    return dataset.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.count(t).alias("labelled"), F.avg(t).alias("mean"), F.min(t).alias("least"), F.max(t).alias("most"))


def missingness(dataset: DataFrame, features: Iterable[str]) -> DataFrame:
    features = list(features)
    shares = dataset.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("missing")) for f in features])))


def tail_counts(dataset: DataFrame) -> DataFrame:
    """Labelled rows and tail events of each split, and whether all three have enough."""
    per = dataset.where("split IN ('train', 'validation', 'test') AND tail_event_20d IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("tail_event_20d").alias("positives"))
    every = Window.partitionBy(F.lit(1))
    return per.withColumn("usable", (F.min("positives").over(every) >= TAIL_EVENTS) & (F.count(F.lit(1)).over(every) == 3))


def enough(dataset: DataFrame, target: str) -> bool:
    """Whether train and evaluation splits have the rows that a fit needs."""
    n = {r["split"]: r["n"] for r in dataset.where(F.col(target).isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get("train", 0) >= TRAIN_ROWS and min(n.get("validation", 0), n.get("test", 0)) >= EVAL_ROWS


def _prepared(features: list[str]) -> list:
    filled = [f"{f}_filled" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="vector", handleInvalid="keep")]


def ridge(features: list[str], target: str) -> Pipeline:
    """Median imputation and ridge regression. MLlib scales features and averages the loss, so
    its penalty isn't that of libraries that sum it."""
    return Pipeline(stages=[*_prepared(features), LinearRegression(featuresCol="vector", labelCol=target, predictionCol="yhat", regParam=1e-3, elasticNetParam=0.0)])


def boosted(features: list[str], target: str, trees: int = 30, depth: int = 3, step: float = 0.1, rate: float = 0.9, seed: int = 7) -> Pipeline:
    """Boosted trees after median imputation (MLlib trees have no branch for missing values)."""
    return Pipeline(stages=[*_prepared(features), GBTRegressor(featuresCol="vector", labelCol=target, predictionCol="yhat", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=rate, seed=seed)])


def tail_classifier(features: list[str], trees: int = 30, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[*_prepared(features), GBTClassifier(featuresCol="vector", labelCol="y", maxIter=trees, maxDepth=3, seed=seed)])


def fit_gated(pipeline: Pipeline, dataset: DataFrame, target: str) -> PipelineModel | None:
    """A fit on the train rows, or None, for 'insufficient', where a split has too few of them."""
    return fit_split(pipeline, dataset, target) if enough(dataset, target) else None


def fit_split(pipeline: Pipeline, dataset: DataFrame, target: str) -> PipelineModel:
    return pipeline.fit(dataset.where((F.col("split") == "train") & F.col(target).isNotNull()))


def gains(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))


def mean_scores(dataset: DataFrame, target: str) -> DataFrame:
    """Scores of the train mean as the prediction of every other split: the least a model has to beat."""
    known = dataset.where(F.col(target).isNotNull())
    mean = known.where("split = 'train'").agg(F.avg(target).alias("yhat"))
    rows = known.where("split IN ('validation', 'test')").select("split", F.col(target).alias("y")).join(F.broadcast(mean))
    return regression_scores(rows, ["split"])


def fit_tail(dataset: DataFrame, features: list[str], **kind) -> PipelineModel | None:
    """The tail classifier, or None where tail_counts() finds too few events in a split."""
    usable = tail_counts(dataset).select("usable").first()
    if usable is None or not usable["usable"]:
        return None
    return fit_split(tail_classifier(features, **kind), dataset.where("tail_event_20d IS NOT NULL").withColumn("y", F.col("tail_event_20d").cast("double")), "y")


def tune(dataset: DataFrame, features: list[str], target: str, grid: list[dict], objective: str = "mae") -> tuple[dict, float]:
    """The grid point that does best on the validation split, by least MAE or, for a flag
    (``objective`` ap), by greatest average precision; test rows are never seen."""
    from foliospark.operators.quality import firewall, tuning_rows

    rows = firewall(tuning_rows(dataset)).where(F.col(target).isNotNull())
    if objective == "ap":
        rows = rows.withColumn("y", F.col(target).cast("double"))
    rows = rows.cache()
    tried = []
    for point in grid:
        seen = rows.where("split = 'validation'")
        if objective == "ap":
            from pyspark.ml.functions import vector_to_array

            scored = fit_split(tail_classifier(features, **point), rows, "y").transform(seen).select(F.lit(1).alias("one"), F.col("y"), vector_to_array("probability")[1].alias("score"), F.monotonically_increasing_id().alias("tie"))
            value = -(average_precision(scored, ["one"], "tie").first()["average_precision"] or 0.0)
        else:
            value = fit_split(boosted(features, target, **point), rows, target).transform(seen).agg(F.avg(F.abs(F.col(target) - F.col("yhat")))).first()[0]
        tried.append((value, len(tried)))
    rows.unpersist()
    best = min(tried)
    return grid[best[1]], abs(best[0])


def tune_by_halving(dataset: DataFrame, features: list[str], target: str, grid: list[dict], shares: tuple[float, ...] = (0.2, 0.4, 1.0), keep: float = 0.4, side_by_side: int = 4) -> tuple[dict, float, float]:
    """(grid point, its MAE on the validation split, effort in whole fits) by successive halving.

    All points are fitted with a share of their trees, the best ``keep`` of them with more, the last
    ones with all; rungs run ``side_by_side`` fits at a time over one written feature table, so Spark
    shares its tasks among them. Test rows are never seen.
    """
    from foliospark.operators.quality import firewall, tuning_rows

    rows = stage(firewall(tuning_rows(dataset)).where(F.col(target).isNotNull()).select("split", target, *features), "tuning")
    seen = rows.where("split = 'validation'")

    def loss(point: dict, share: float) -> float:
        trees = max(1, round(point.get("trees", 30) * share))
        scored = fit_split(boosted(features, target, **{**point, "trees": trees}), rows, target).transform(seen)
        return scored.agg(F.avg(F.abs(F.col(target) - F.col("yhat")))).first()[0]

    alive, effort, losses = list(range(len(grid))), 0.0, {}
    with ThreadPoolExecutor(side_by_side) as pool:
        for share in shares:
            losses = dict(zip(alive, pool.map(lambda i, share=share: loss(grid[i], share), alive), strict=True))
            effort += share * len(alive)
            best = sorted(alive, key=lambda i: (losses[i], i))
            alive = best[: max(1, round(len(alive) * keep))] if share != shares[-1] else best[:1]
    return grid[alive[0]], losses[alive[0]], effort


def refit_best(rows: DataFrame, features: list[str], target: str, point: dict) -> PipelineModel:
    """A model of the frozen parameters on the train and validation rows; a test row among them
    stops the job."""
    from foliospark.operators.quality import firewall

    known = firewall(rows).where(F.col(target).isNotNull() & F.col("split").isin("train", "validation"))
    return boosted(features, target, **point).fit(known)


def score_once(model: PipelineModel, dataset: DataFrame, target: str) -> DataFrame:
    """Scores on the test split, for a model that was refitted before."""
    scored = model.transform(dataset.where((F.col("split") == "test") & F.col(target).isNotNull()))
    return regression_scores(scored.select("split", F.col(target).alias("y"), "yhat"), ["split"])


def check_schema(model: PipelineModel, dataset: DataFrame) -> None:
    """Stops where the dataset lacks a column that the model was fitted on, or has it as text."""
    needs = [c for stage_ in model.stages if isinstance(stage_, ImputerModel) for c in stage_.getInputCols()]
    kinds = dict(dataset.dtypes)
    if missing := sorted(set(needs) - set(kinds)):
        raise ValueError(f"the dataset lacks {missing}")
    if odd := sorted(c for c in needs if not isinstance(dataset.schema[c].dataType, NumericType)):
        raise ValueError(f"the model needs numbers in {odd}")


def score_rows(by_family: dict[str, PipelineModel], dataset: DataFrame) -> DataFrame:
    """Predictions for every row with a return: by the model of family ``holdings`` where the fund's
    holdings are known, else by that of ``market``; ``check_schema`` comes first."""
    family = F.when(F.col("holding_count").isNotNull(), "holdings").otherwise("market")
    rows, out = dataset.where("return_1d IS NOT NULL").withColumn("family", family), None
    for name, model in by_family.items():
        check_schema(model, dataset)
        mine = model.transform(rows.where(F.col("family") == name)).select("fund_id", "trading_date", "family", "yhat")
        out = mine if out is None else out.unionByName(mine)
    return out


def score_latest(by_family: dict[str, PipelineModel], dataset: DataFrame, features: dict[str, list[str]]) -> DataFrame:
    """Predictions for the newest usable row of each fund, as score_rows() gives them. Missing feature
    columns are an error."""
    missing = sorted({f for fs in features.values() for f in fs} - set(dataset.columns))
    if missing:
        raise ValueError(f"the dataset lacks {missing}")
    newest = F.row_number().over(Window.partitionBy("fund_id").orderBy(F.desc("trading_date")))
    return score_rows(by_family, dataset.where("return_1d IS NOT NULL").withColumn("nth", newest).where("nth = 1"))


#: Pairs without a holding that links are judged by, for each fund; draws for each pair in a round.
NEGATIVES, DRAWS = 20, 8


def negative_pairs(held: DataFrame, n: int, seed: int = 7, rounds: int = 8) -> DataFrame:
    """``n`` securities for each fund that it doesn't hold, drawn without replacement with chances in
    proportion to the number of funds that hold them; fewer where it holds nearly all that it meets
    in ``rounds``. The same for the same edges and seed, whatever their order.

    A draw is an edge by its running number, at a hash of seed, fund and draw: its security comes by
    an equi join, so funds and securities are never paired with each other. Repeats and held pairs
    go, and funds that are short draw on.
    """
    pairs = stage(held.select("etf_node_id", "security_node_id").distinct(), "pairs")
    numbered = stage(running(pairs, [], ["security_node_id", "etf_node_id"], sums={"number": F.lit(1)}).select("number", "security_node_id"), "numbered")
    edges, funds = numbered.count(), pairs.select("etf_node_id").distinct()
    short, got = funds, None
    for r in range(rounds):
        draw = F.explode(F.sequence(F.lit(r * n * DRAWS), F.lit((r + 1) * n * DRAWS - 1))).alias("draw")
        at = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "etf_node_id", "draw"), 256), 1, 15), 16, 10).cast("long"), F.lit(edges))
        drawn = short.select("etf_node_id", draw).select("etf_node_id", "draw", at.alias("number")).join(numbered, "number")
        fresh = drawn.groupBy("etf_node_id", "security_node_id").agg(F.min("draw").alias("draw")).join(pairs, ["etf_node_id", "security_node_id"], "left_anti")
        both = fresh if got is None else got.unionByName(fresh).groupBy("etf_node_id", "security_node_id").agg(F.min("draw").alias("draw"))
        nth = F.row_number().over(Window.partitionBy("etf_node_id").orderBy("draw"))
        got = stage(both.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth"), "negatives")
        short = funds.join(got.groupBy("etf_node_id").count().where(F.col("count") >= n), "etf_node_id", "left_anti")
        if short.isEmpty():
            break
    return got.select("etf_node_id", "security_node_id")


def holding_links(held: DataFrame, rank: int = 8, seed: int = 7) -> DataFrame:
    """Implicit-feedback factors of funds and securities, and their score for held pairs and for
    NEGATIVES others a fund, of the pairs left out by hash."""
    from foliospark.operators.graph import hash_split, node_index

    funds = node_index(held, "etf_node_id").withColumnsRenamed({"node_id": "etf_node_id", "index": "f"})
    securities = node_index(held, "security_node_id").withColumnsRenamed({"node_id": "security_node_id", "index": "s"})
    pairs = held.select("etf_node_id", "security_node_id").distinct().join(funds, "etf_node_id").join(securities, "security_node_id")
    pairs = hash_split(pairs, "etf_node_id", "security_node_id").select(F.col("f").cast("int"), F.col("s").cast("int"), F.lit(1.0).alias("y"), "split")
    drawn = hash_split(negative_pairs(held, NEGATIVES, seed), "etf_node_id", "security_node_id")
    others = drawn.join(funds, "etf_node_id").join(securities, "security_node_id").select(F.col("f").cast("int"), F.col("s").cast("int"), F.lit(0.0).alias("y"), "split")
    model = ALS(rank=rank, implicitPrefs=True, userCol="f", itemCol="s", ratingCol="y", seed=seed, coldStartStrategy="drop").fit(pairs.where("split = 'train'"))
    return model.transform(pairs.unionByName(others).where("split <> 'train'")).withColumnRenamed("prediction", "score")
