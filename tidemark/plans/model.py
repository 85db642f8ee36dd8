"""Walk-forward stacked classifier on Spark ML.

Members are any Spark ML estimators with a probability column. Per fold every member learns the
training part and scores the validation part; a logistic meta-model learns the out-of-fold scores; a
candidate member stays only if it lowers the stack's out-of-fold log-loss enough. Only fold bounds
and loss figures reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from statistics import median

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.exprs import brier, log_loss
from tidemark.operators import folds as fold_ops
from tidemark.operators import vennabers
from tidemark.operators.asof import coverage
from tidemark.operators.boosting import Settings, Tree, best_round, grow
from tidemark.operators.metrics import baseline, group_rates
from tidemark.operators.quality import require_target
from tidemark.plans import grading
from tidemark.plans.registry import register
from tidemark.sources.io import ContractError, append
from tidemark.sources.scratch import at_once, new_path, settled, stage

#: ``member(features, label)``; boosted ones also take ``rounds`` for the refit on all rows.
Member = Callable[..., Estimator]
#: Models by fold and member; fold 0 stands for all rows.
Fits = dict[tuple[int, str], PipelineModel]


def _prepared(features: Sequence[str], *last) -> Pipeline:
    """Median imputation with missing indicators, assembled. The only imputation in the engine."""
    from pyspark.ml.feature import SQLTransformer

    flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS _m_{c}" for c in features)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS _d_{c}" for c in features)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {flags}, {casts} FROM __THIS__"),
        Imputer(strategy="median", inputCols=[f"_d_{c}" for c in features], outputCols=[f"_i_{c}" for c in features]),
        VectorAssembler(inputCols=[f"_i_{c}" for c in features] + [f"_m_{c}" for c in features], outputCol="_x"),
        *last,
    ])


#: Rows of a task that learns: each level of a tree and each step of a linear fit is a job, whose tasks cost more than few rows do.
TASK_ROWS = 200_000
#: Most boosting rounds, and rounds without gain on held rows after which boosting ends.
MOST_ROUNDS, PATIENCE = 1000, 50


def _marked(dataset: DataFrame, features: Sequence[str]) -> DataFrame:
    """``dataset`` with ``_held``: as it is marked, or else a tenth of the rows by hash."""
    return dataset if "_held" in dataset.columns else dataset.withColumn("_held", F.pmod(F.xxhash64(*features), F.lit(10)) == 0)


def tasks_for(n: int) -> int:
    """Tasks that ``n`` rows to be learnt ask for."""
    return max(1, -(-n // TASK_ROWS))


def _dealt(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows`` in as many even partitions as their number ``n`` asks for."""
    return rows.repartition(tasks_for(rows.count() if n is None else n))


class BoostedTrees(Estimator):
    """Boosted trees for the logistic loss, as many as serve the rows marked ``_held`` best.

    ``boosting.grow`` grows the rounds in one stage, whose tasks hold the rows that were binned once and take the loss of the held ones
    after every round. Where ``patience`` rounds in turn brought no gain it ends, and the ensemble is cut back to its best round.
    ``rounds`` fixes the number of trees, and no row is held.
    """

    #: Callers hand such a member its validation rows, marked ``_held``.
    stops_on_held = True

    def __init__(self, features: Sequence[str], label: str, rounds: int | None = None, most: int = MOST_ROUNDS, patience: int = PATIENCE, step: float = 0.05):
        super().__init__()
        self.features, self.label, self.rounds, self.most, self.patience, self.step = list(features), label, rounds, most, patience, step
        self.losses: list[float] = []

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        marked = dataset.withColumn("_held", F.lit(False)) if self.rounds else _marked(dataset, self.features)
        ready = _prepared(self.features).fit(marked.where("NOT _held"))
        rows = ready.stages[1].transform(ready.stages[0].transform(marked))
        known = ready.stages[1].surrogateDF.first().asDict()
        values, flags, imputed = zip(*[(f"_i_{c}", f"_m_{c}", known[f"_d_{c}"]) for c in self.features])
        most = self.rounds or self.most
        trees, losses = grow(rows, values, flags, imputed, self.label, tasks_for, Settings(most, 0 if self.rounds else self.patience, self.step))
        best, done = best_round(losses, self.patience)
        if self.rounds:
            best = self.rounds
        elif not losses:  # nothing is held
            best = min(best_rounds([]), self.most)
        self.losses = losses[: best + self.patience] if done else losses
        return PipelineModel([*ready.stages, _ensemble(dataset.sparkSession, trees[:best], self.step, 2 * len(self.features))])


def _ensemble(spark: SparkSession, trees: Sequence[Tree], step: float, features: int) -> GBTClassificationModel:
    """A model of the first tree and, at ``step``, the others. It is read from files as Spark writes them: a call of the JVM for each
    node would take longer than growing it."""
    kind = lambda of, uid: {"class": f"org.apache.spark.ml.{of}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": {"featuresCol": "_x"}, "defaultParamMap": {"impurity": "variance"}}
    path, nodes = new_path(spark, "ensemble"), []
    for i, t in enumerate(trees):
        for v, (n, total, squares) in enumerate(zip(t.rows, t.total, t.squares)):
            mean = total / n if n else 0.0
            inner = t.feature[v] >= 0
            split = (t.feature[v], [t.threshold[v]] if inner else [], -1)
            nodes.append((i, (v, mean, max(0.0, squares / n - mean * mean) if n else 0.0, [n, total, squares], int(n), t.gain[v] if inner else -1.0, t.left[v], t.right[v], split)))
    split = "struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>"
    node = f"struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, split {split}>"
    spark.createDataFrame(nodes, f"treeID int, nodeData {node}").coalesce(1).write.parquet(f"{path}/data")
    single = [(i, json.dumps(kind("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}")), step if i else 1.0) for i in range(len(trees))]
    spark.createDataFrame(single, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = kind("classification.GBTClassificationModel", f"GBTClassifier_{uuid.uuid4().hex[:12]}") | {"numFeatures": features, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


class WeightedPenalty(Estimator):
    """Logistic regression with the penalty ``1 / (C n)``, for ``n`` rows."""

    def __init__(self, logistic: LogisticRegression, c: float):
        super().__init__()
        self.logistic, self.c = logistic, c

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        rows = settled(_dealt(dataset.select(self.logistic.getFeaturesCol(), self.logistic.getLabelCol()), n))  # every step of the fit reads them
        return self.logistic.copy({self.logistic.regParam: 1.0 / (self.c * max(1, n))}).fit(rows)


def boosted_member(features: Sequence[str], label: str, rounds: int | None = None, most: int = MOST_ROUNDS) -> Estimator:
    """Boosted trees; without ``rounds`` the rows marked ``_held`` end the boosting, or where none are, a tenth by hash."""
    return BoostedTrees(features, label, rounds, most)


def linear_member(features: Sequence[str], label: str, c: float = 1.0) -> Estimator:
    logistic = LogisticRegression(labelCol=label, featuresCol="_z", elasticNetParam=0.5, standardization=False)
    return _prepared(features, StandardScaler(inputCol="_x", outputCol="_z", withMean=True), WeightedPenalty(logistic, c))


def forest_member(features: Sequence[str], label: str) -> Estimator:
    return _prepared(features, RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=20, maxDepth=6, seed=42))


MEMBERS: dict[str, Member] = {"boosted": boosted_member, "linear": linear_member}


def _scored(model: PipelineModel, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def chained(models: dict[str, PipelineModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and one score column per model: the models transform the same rows in turn, and nothing is joined."""
    rows = df.select(F.struct(*keep).alias("_keep"), F.struct(*df.columns).alias("_row"))
    for name, model in models.items():
        held = [c for c in rows.columns if c != "_row"]
        rows = model.transform(rows.select("_row.*", *[F.col(c).alias(f"_kept_{c}") for c in held]))
        rows = rows.select(*[F.col(f"_kept_{c}").alias(c) for c in held], F.struct(*df.columns).alias("_row"), vector_to_array("probability")[1].alias(f"_p_{name}"))
    return rows.select("_keep.*", *[F.col(f"_p_{name}").alias(name) for name in models])


def observed(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with any observed value; the imputer refuses the others."""
    seen = df.agg(*[F.count(c).alias(c) for c in features]).first().asDict()
    return [c for c in features if seen[c]]


def rounds_of(model: PipelineModel) -> int | None:
    """Trees of a boosted model, null for others."""
    last = model.stages[-1]
    return last.getNumTrees if isinstance(last, GBTClassificationModel) else None


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, day: str, key: str, members: dict[str, Member], config: EngineConfig = DEFAULT, rounds: dict[str, list[int]] | None = None, fits: Fits | None = None) -> DataFrame:
    """``key, label, fold`` and one score column per member, for validation rows of every fold.

    ``rounds``, if given, gathers the boosting rounds of each member and fold. ``fits``, if given, keeps the models: those of the same
    rows that it holds are not learnt again.
    """
    fits = {} if fits is None else fits
    placed = stage(fold_ops.positions(df.select(key, day, label, *features), day, key), "placed")
    placed = placed.coalesce(tasks_for(placed.count()))  # all passes below, and those of the fits, read it
    table = fold_ops.fold_table(placed, day, config).orderBy("fold").collect()  # one row per fold
    if not table:
        raise ContractError("no fold has enough training rows")
    parts: dict[int, tuple[DataFrame, DataFrame, list[str]]] = {}
    at = F.col("position")
    bounds = {f["fold"]: {"training": (at < f["lo"]) & (F.col(day) <= f["cutoff"]), "validation": (at >= f["lo"]) & (at < f["hi"])} for f in table}
    facts = [F.expr(f"{end}(`{label}`)").alias(end) for end in ("min", "max")] + [F.count(c).alias(f"n_{i}") for i, c in enumerate(features)]
    # every row once for each part that holds it: one pass gives the classes and observed features of all parts
    marks = F.array(*[F.when(on, F.lit(f"{part} {fold}")) for fold, both in bounds.items() for part, on in both.items()])
    held = placed.select(label, *features, F.explode(F.array_compact(marks)).alias("_part")).groupBy("_part").agg(*facts)
    seen = {r["_part"]: r for r in held.collect()}
    for fold, both in bounds.items():
        for part in both:
            row = seen.get(f"{part} {fold}")
            if row is None or row["min"] == row["max"]:
                raise ContractError(f"fold {fold}: its {part} rows have one class only")
        names = [c for i, c in enumerate(features) if seen[f"training {fold}"][f"n_{i}"]]
        parts[fold] = placed.where(both["training"]), placed.where(both["validation"]), names
    new = [(fold, name) for name in members for fold in reversed(parts) if (fold, name) not in fits]  # the longest first: large folds, and members that boost

    def fit(task: tuple[int, str]) -> PipelineModel:
        train, check, names = parts[task[0]]
        member = members[task[1]](names, label)
        if getattr(member, "stops_on_held", False):  # the fold's validation slice decides when to stop
            train = train.withColumn("_held", F.lit(False)).unionByName(check.withColumn("_held", F.lit(True)))
        return member.fit(train)

    fits.update(zip(new, at_once(df.sparkSession, fit, new)))  # fits of small folds wait on job latency more than on cores
    out = None
    for fold, (_, check, _) in parts.items():
        for name in members:
            if rounds is not None and rounds_of(fits[fold, name]):
                rounds.setdefault(name, []).append(rounds_of(fits[fold, name]))
        scored = chained({name: fits[fold, name] for name in members}, check, [key, label]).withColumn("fold", F.lit(fold))
        scored = scored.select(key, label, "fold", *members)
        out = scored if out is None else out.unionByName(scored)
    return out


def stack(oof: DataFrame, label: str, members: Sequence[str], least: int = 50) -> PipelineModel:
    """Logistic meta-model on member scores."""
    n = oof.count()
    if n < least:
        raise ContractError(f"{n} out-of-fold rows, {least} needed")
    meta = LogisticRegression(labelCol=label, featuresCol="_s", regParam=1.0 / n, elasticNetParam=0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=list(members), outputCol="_s"), meta]).fit(oof)


def report(scores: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """``member, log_loss, brier, n`` for every score column and the constant."""
    y = F.col(label).cast("double")
    long = scores.select(y.alias("y"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))).alias("member", "p"))
    rows = long.where("p IS NOT NULL").groupBy("member").agg(F.avg(log_loss(F.col("p"), F.col("y"))).alias("log_loss"), F.avg(brier(F.col("p"), F.col("y"))).alias("brier"), F.count(F.lit(1)).alias("n"))
    constant = baseline(scores.select(y.alias("y")), "y").select(F.lit("constant").alias("member"), "log_loss", "brier", "n")
    return rows.unionByName(constant)


def refit(df: DataFrame, features: Sequence[str], label: str, name: str, member: Member, rounds: dict[str, list[int]], fits: Fits | None = None) -> PipelineModel:
    """A member on all rows; one that boosts gets the median of the folds' best rounds."""
    fits = {} if fits is None else fits
    if (0, name) not in fits:
        more = {"rounds": best_rounds(rounds[name])} if name in rounds else {}
        fits[0, name] = member(features, label, **more).fit(df)
    return fits[0, name]


def evaluate(
    df: DataFrame, features: Sequence[str], label: str, day: str, key: str, members: dict[str, Member] | None = None, candidates: dict[str, Member] | None = None, config: EngineConfig = DEFAULT, fits: Fits | None = None
) -> dict:
    """The stack over the folds, without members on all rows: out-of-fold scores, meta-model, report, kept members and the gate."""
    members = dict(members or MEMBERS)
    everyone = members | (candidates or {})
    rounds: dict[str, list[int]] = {}
    df = stage(df.select(key, day, label, *features), "training-matrix")
    oof = stage(out_of_fold(df, features, label, day, key, everyone, config, rounds, fits), "out-of-fold")
    kept = list(members)

    metas: dict[tuple[str, ...], PipelineModel] = {}

    def loss(names: Sequence[str]) -> float:
        metas[tuple(names)] = stack(oof, label, names)
        scored = _scored(metas[tuple(names)], oof, [label], "p")
        return scored.agg(F.avg(log_loss(F.col("p"), F.col(label).cast("double")))).first()[0]

    ablation = {}
    best = loss(kept) if candidates else None
    for name in candidates or {}:
        ablation[name] = best - (new := loss([*kept, name]))
        if ablation[name] >= config.member_gain:
            kept, best = [*kept, name], new
    meta = metas.get(tuple(kept)) or stack(oof, label, kept)
    scores = meta.transform(oof).withColumn("stack", vector_to_array("probability")[1]).select(*oof.columns, "stack")
    rows = report(scores, label, [*everyone, "stack"]).collect()
    figures = {r["member"]: r.asDict() for r in rows}
    gate = figures["stack"]["log_loss"] < figures["constant"]["log_loss"]
    return {"meta": meta, "oof": scores, "report": figures, "kept": kept, "ablation": ablation, "gate": gate, "features": observed(df, features), "rounds": rounds, "matrix": df}


def complete(known: dict, label: str, everyone: dict[str, Member], fits: Fits) -> dict:
    """What ``evaluate`` gave, with the kept members on all rows."""
    matrix = known["matrix"]
    models = at_once(matrix.sparkSession, lambda m: refit(matrix, known["features"], label, m, everyone[m], known["rounds"], fits), known["kept"])
    return known | {"members": dict(zip(known["kept"], models)), "fits": fits}


def train(df: DataFrame, features: Sequence[str], label: str, day: str, key: str, members: dict[str, Member] | None = None, candidates: dict[str, Member] | None = None, config: EngineConfig = DEFAULT) -> dict:
    """Fit the stack; returns models, out-of-fold scores, report, kept members and the gate."""
    fits: Fits = {}
    known = evaluate(df, features, label, day, key, members, candidates, config, fits)
    return complete(known, label, dict(members or MEMBERS) | (candidates or {}), fits)


def training_rows(df: DataFrame, features: Sequence[str], label: str, day: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows of the training period that are covered well enough, past the target gate."""
    rows = df.where(F.col(day).between(F.lit(config.train_start), F.lit(config.train_end)))
    require_target(rows, label, day, config.train_start, config.train_end, config.holdout_start)
    return rows.where(coverage(features) >= config.min_coverage)


def train_candidate(
    df: DataFrame, features: Sequence[str], label: str, day: str, key: str, group: str, registry: DataFrame, path: str, version: str, stamp: str,
    members: dict[str, Member] | None = None, candidates: dict[str, Member] | None = None, config: EngineConfig = DEFAULT, fits: Fits | None = None, known: dict | None = None,
) -> tuple[DataFrame, dict]:
    """A training run from end to end: rows of the training period, target gate, coverage gate, stack, calibration
    table, group rates, save, registration. Returns the registry with the new row, and the bundle.

    A model whose gate fails is registered as rejected and not saved. ``known`` is what ``evaluate`` gave for the same rows, with
    the models in ``fits``.
    """
    covered = training_rows(df, features, label, day, config)
    if known is None:
        bundle = train(covered, features, label, day, key, members, candidates, config)
    else:
        bundle = complete(known, label, dict(members or MEMBERS) | (candidates or {}), {} if fits is None else fits)
    ends = covered.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")).first()
    frozen = baseline(covered.select(F.col(label).cast("double").alias("y")), "y").first()
    pairs = bundle["oof"].withColumn("model", F.lit(version))
    bundle |= {
        "training_end": ends["last"], "baseline_rate": frozen["rate"], "n": ends["n"],
        "intervals": stage(vennabers.calibrate(pairs, "model", "stack", label), "intervals"), "rates": stage(group_rates(covered, group, label, config.min_group_rows), "rates"),
    }
    if bundle["gate"]:
        save(bundle, path, version, df.sparkSession)
    report = {"members": bundle["report"], "kept": bundle["kept"], "ablation": bundle["ablation"], "gates_passed": bool(bundle["gate"]), "training_end": str(ends["last"]), "n": ends["n"]}
    figures = bundle["report"]["stack"]
    new = (version, stamp, f"{ends['first']}..{ends['last']}", float(figures["log_loss"]), float(figures["brier"]), bool(bundle["gate"]), json.dumps(report, default=float))
    schema = "model_version string, trained_at string, train_range string, cv_log_loss double, cv_brier double, gates_passed boolean, gate_report string"
    return register(registry, df.sparkSession.createDataFrame([new], schema)), bundle


def best_rounds(counts: Sequence[int], default: int = 200) -> int:
    """Rounds of the full refit: the median of the folds' best."""
    return int(median(counts)) if counts else default


def score(bundle: dict, df: DataFrame, key: str) -> DataFrame:
    """``key, raw``: the stack's probability."""
    scored = chained(bundle["members"], df.select(*dict.fromkeys([key, *bundle["features"]])), [key])
    return _scored(bundle["meta"], scored, [key], "raw")


def score_slate(
    bundle: dict, features: DataFrame, key: str, group: str, entities: Sequence[str], counts: tuple[str, str], market: DataFrame, market_keys: Sequence[str], confirmed: Column,
    predictions: str, version: str, stamp: str, config: EngineConfig = DEFAULT,
) -> DataFrame:
    """A slate from its feature rows to stored predictions: members and stack, calibration, shrinkage to the group's rate, market,
    status and tier, appended to ``predictions``; returns the rows that were appended.

    Every row of ``features`` (with ``coverage``) gets one: a game without an entity, with too little coverage or without a valid
    probability is stored as blocked.
    """
    spark = features.sparkSession
    raw = stage(score(bundle, features, key), "raw").withColumn("_model", F.lit(version))  # calibration reads the scores several times
    calibrated = vennabers.apply(raw, bundle["intervals"], "_model", "raw").select(F.col(key).alias("_key"), "raw", "p_cal")
    rows = features.join(calibrated, F.col(key) == F.col("_key"), "left").drop("_key")
    rates = bundle["rates"].withColumnRenamed(group, "_group").withColumn("_group", F.col("_group").cast("string"))
    rows = rows.withColumn("_group", F.col(group).cast("string"))
    scored = grading.score_slate(rows, market, market_keys, rates, "_group", entities, "p_cal", counts, confirmed, F.lit(None).cast("string"), config)
    known = lambda c: F.when(F.col("status") != "BLOCKED", F.col(c))
    out = scored.select(
        key, F.lit(version).alias("model_version"), F.lit(stamp).alias("predicted_at"), known("raw").alias("raw"), known("p_cal").alias("p_cal"), "p_final",
        F.when(F.col("market_reason").isNull() & (F.col("status") == "OK"), F.col("p_market")).alias("p_market"), "edge", F.coalesce("books_n", F.lit(0)).cast("long").alias("books_n"), "age_s", "coverage", "status", "reason", "tier",
    )
    append(out, predictions)
    return spark.read.schema(out.schema).parquet(predictions).where((F.col("model_version") == version) & (F.col("predicted_at") == stamp))


def save(bundle: dict, path: str, version: str, spark) -> None:
    """Models, calibration and rate tables and their contract under ``path``; a model that failed its gate is refused."""
    if not bundle["gate"]:
        raise ContractError(f"{version} failed its gate and is not saved")
    for name, model in bundle["members"].items():
        model.write().overwrite().save(f"{path}/member-{name}")
    bundle["meta"].write().overwrite().save(f"{path}/meta")
    tables = [n for n in ("intervals", "rates") if n in bundle]
    for n in tables:
        bundle[n].write.mode("overwrite").parquet(f"{path}/{n}")
    contract = {"version": version, "features": bundle["features"], "kept": bundle["kept"], "gate": bool(bundle["gate"]), "tables": tables}
    contract |= {"training_end": str(bundle.get("training_end")), "baseline_rate": bundle.get("baseline_rate")}
    spark.createDataFrame([(json.dumps(contract),)], "contract string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load(path: str, version: str, features: Sequence[str], spark) -> dict:
    """A saved bundle; refused if version or features differ or its gate failed."""
    contract = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if contract["version"] != version or contract["features"] != list(features) or not contract["gate"]:
        raise ContractError(f"model {contract['version']} does not fit the contract of {version}")
    members = {m: PipelineModel.load(f"{path}/member-{m}") for m in contract["kept"]}
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in contract["tables"]}
    return {"members": members, "meta": PipelineModel.load(f"{path}/meta"), **tables, **contract}
