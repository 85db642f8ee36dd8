"""Model registry as a table: candidates, promotion, the locked holdout."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.exprs import json_put
from tidemark.operators.metrics import roc_auc, skill
from tidemark.sources.io import ContractError, merged
from tidemark.sources.tables import KeyedTable


def register(registry: DataFrame, row: DataFrame) -> DataFrame:
    """Registry with a candidate (gates passed) or rejected row."""
    status = F.when(F.col("gates_passed"), "candidate").otherwise("rejected")
    return merged(registry, row.withColumn("status", status), ["model_version"])


def approved(registry: DataFrame) -> DataFrame:
    """Production models that passed gates and holdout and whose holdout was not burned."""
    burned = F.coalesce("holdout_burned_rerun", F.lit(False))
    return registry.where((F.col("status") == "production") & F.col("gates_passed") & F.col("holdout_passed") & ~burned)


def current(registry: DataFrame) -> DataFrame:
    """The newest approved model, as at most one row."""
    return approved(registry).orderBy(F.desc("trained_at"), F.desc("model_version")).limit(1)


def require_current(registry: DataFrame) -> str:
    row = current(registry).first()
    if row is None:
        raise ContractError("no approved production model")
    return row["model_version"]


def promotable(version: str) -> Column:
    """Whether a row is the candidate ``version`` and meets every precondition."""
    burned = F.coalesce("holdout_burned_rerun", F.lit(False))
    return (F.col("model_version") == version) & (F.col("status") == "candidate") & F.col("gates_passed") & F.col("holdout_passed") & ~burned


def promote(registry: DataFrame, version: str, stamp: str) -> DataFrame:
    """Registry in which ``version`` is production and others are retired, in one projection; raises
    unless exactly one row may be promoted."""
    n = registry.where(promotable(version)).count()
    if n != 1:
        raise ContractError(f"{version}: {n} rows can be promoted")
    mine = F.col("model_version") == version
    status = F.when(mine, "production").when(F.col("status") == "production", "retired").otherwise(F.col("status"))
    return registry.withColumns({"status": status, "gate_report": F.when(mine, json_put(F.col("gate_report"), "promoted_at", F.lit(stamp))).otherwise(F.col("gate_report"))})


def promote_table(table: KeyedTable, version: str, stamp: str) -> DataFrame:
    """Promote ``version`` in a stored registry: the rows that change (it and those in production) are upserted in one
    commit. The registry is then read again and verified to have ``version`` alone in production; returns it."""
    before = table.read()
    changed = promote(before, version, stamp).where((F.col("model_version") == version) | (F.col("status") == "retired"))
    table.upsert(changed)
    after = table.read()
    live = [r["model_version"] for r in after.where("status = 'production'").select("model_version").limit(2).collect()]
    if live != [version]:
        raise ContractError(f"after the promotion of {version}, production is {live}")
    return after


def record_holdout(registry: DataFrame, version: str, passed: bool) -> DataFrame:
    """Registry with a holdout outcome found elsewhere; a second one is refused, and one without passed gates."""
    row = registry.where(F.col("model_version") == version).first()
    if row is None or not row["gates_passed"]:
        raise ContractError(f"{version} has not passed its gates")
    if row["holdout_passed"] is not None:
        raise ContractError(f"the holdout of {version} is spent")
    return registry.withColumn("holdout_passed", F.when(F.col("model_version") == version, passed).otherwise(F.col("holdout_passed")))


HOLDOUT = {
    "holdout_log_loss": "double", "holdout_brier": "double", "holdout_baseline_log_loss": "double", "holdout_baseline_brier": "double",
    "holdout_n": "long", "holdout_passed": "boolean", "holdout_evaluated_at": "string", "holdout_burned_rerun": "boolean", "gate_report": "string",
}


def evaluate_holdout(
    registry: DataFrame, version, contract: dict, scored: DataFrame, p: str, y: str, stamp: str, acknowledge_burn: bool = False, config: EngineConfig = DEFAULT
) -> DataFrame:
    """Registry after the one look at the locked holdout that a candidate gets.

    ``contract`` is what was saved with the model: ``training_end`` (a date) and ``baseline_rate``. Refused: an
    unknown version, failed gates, a second look that is not acknowledged (then it is recorded as burned), a
    training end within the holdout, a baseline rate that is not strictly between 0 and 1, and one outcome only.
    """
    rows = registry.withColumns({c: F.lit(None).cast(kind) for c, kind in HOLDOUT.items() if c not in registry.columns})
    row = rows.where(F.col("model_version") == version).first()
    if row is None:
        raise ContractError(f"{version} is not registered")
    if not row["gates_passed"]:
        raise ContractError(f"{version} has not passed its gates")
    before = row["holdout_evaluated_at"] is not None
    if before and not acknowledge_burn:
        raise ContractError(f"the holdout of {version} is spent")
    end, rate = contract.get("training_end"), contract.get("baseline_rate")
    if end is None or end >= config.holdout_start:
        raise ContractError(f"training end {end} is unknown or overlaps the holdout from {config.holdout_start}")
    if rate is None or not 0.0 < float(rate) < 1.0:
        raise ContractError(f"baseline rate {rate} is not between 0 and 1")
    figures = skill(scored, p, y, float(rate), config).first().asDict() | roc_auc(scored, p, y).first().asDict()
    if not figures["n"] or figures["auc"] is None:
        raise ContractError("the holdout needs rows of both outcomes")
    mine = F.col("model_version") == version
    passed, burned = bool(figures["passed"]), before and acknowledge_burn
    report = {"log_loss": figures["log_loss"], "brier": figures["brier"], "roc_auc": figures["auc"], "n": figures["n"], "baseline_rate": float(rate), "baseline_log_loss": figures["base_log_loss"],
              "baseline_brier": figures["base_brier"], "log_loss_gain": figures["log_loss_gain"], "brier_gain": figures["brier_gain"], "passed": passed, "burned_rerun": burned, "evaluated_at": stamp}
    new = {
        "holdout_log_loss": F.lit(figures["log_loss"]), "holdout_brier": F.lit(figures["brier"]), "holdout_baseline_log_loss": F.lit(figures["base_log_loss"]),
        "holdout_baseline_brier": F.lit(figures["base_brier"]), "holdout_n": F.lit(figures["n"]), "holdout_passed": F.lit(passed), "holdout_evaluated_at": F.lit(stamp),
        "holdout_burned_rerun": F.lit(burned), "gate_report": json_put(F.col("gate_report"), "locked_holdout", F.parse_json(F.lit(json.dumps(report)))),
        "status": F.lit("candidate" if passed else "rejected"),
    }
    return rows.withColumns({c: F.when(mine, value).otherwise(F.col(c)) for c, value in new.items()})
