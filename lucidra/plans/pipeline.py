"""A run from selection to report: plan, generate, score, calibrate, decide. Tables between the stages, frozen artifacts beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidra.functions.text import exact_match, is_abstention, token_f1
from lucidra.operators import isotonic, lineage, policy, select
from lucidra.sources.io import content_hash, freeze_json


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run; ``identity`` names what a calibrator must share with the runs it is applied to."""

    run_id: str
    model_snapshot_id: str
    prompt: str
    split: str
    levels: tuple[str, ...] = ("one_hop", "two_hop", "three_hop", "four_plus_hop")
    limit_per_level: int | None = None
    seed: int = 7
    max_requests: int | None = None
    usd_per_million: float = 0.0
    score_source: str = "mock"
    decoding: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k in ("run_id", "model_snapshot_id", "prompt", "split"):
            if not str(getattr(self, k)).strip():
                raise ValueError(f"{k} must not be blank")
        if "{question}" not in self.prompt:
            raise ValueError("the prompt must contain {question}")

    @property
    def identity(self) -> str:
        """Digest of model, prompt, decoding and score source."""
        return content_hash({"model": self.model_snapshot_id, "prompt": self.prompt, "decoding": self.decoding, "score_source": self.score_source})


class Provider(Protocol):
    """What answers a prompt; instances are sent to the executors."""

    def generate(self, prompt: str, example_id: str) -> tuple[str, float]:
        """Text and score in [0, 1]."""


@dataclass(frozen=True)
class MockProvider:
    """Deterministic answers without a model: a digest decides between a fixed text and abstaining, and the score."""

    text: str = "mock answer"

    def generate(self, prompt: str, example_id: str) -> tuple[str, float]:
        """The same for the same prompt and example."""
        h = hashlib.sha256(f"{example_id}\n{prompt}".encode()).digest()
        return ("ABSTAIN" if h[0] < 25 else f"{self.text} {h[1] % 3}"), int.from_bytes(h[2:4], "big") / 65535


def plan(examples: DataFrame, config: RunConfig) -> DataFrame:
    """The selected examples of the split with ``prompt`` and ``est_tokens``; per level the first in hash order.

    ``examples``: example_id, dataset_id, level, split, question. More requests than allowed are an error.
    """
    rows = examples.where((F.col("split") == config.split) & F.col("level").isin(list(config.levels)))
    if config.limit_per_level is not None:
        key = F.concat_ws(":", "dataset_id", "example_id")
        rows = select.top_per_level(rows.withColumn("_k", key), ["dataset_id", "level"], "_k", config.limit_per_level, config.seed).drop("_k", "rank")
    rows = rows.withColumn("prompt", F.replace(F.lit(config.prompt), F.lit("{question}"), F.col("question")))
    rows = rows.withColumn("est_tokens", F.greatest(F.lit(1), F.floor((F.length("prompt") + 3) / 4).cast("int")))
    if config.max_requests is not None and (n := rows.count()) > config.max_requests:
        raise ValueError(f"{n} requests exceed the budget of {config.max_requests}")
    return rows


def plan_cost(planned: DataFrame, config: RunConfig) -> DataFrame:
    """One row: requests, tokens, estimated USD."""
    return planned.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("est_tokens") * config.usd_per_million / 1e6, F.lit(0.0)).alias("usd"))


def generate(planned: DataFrame, done: DataFrame | None, config: RunConfig, provider: Provider) -> DataFrame:
    """Generation records of the planned examples that are not in ``done`` yet; one task per partition calls the provider."""
    todo = planned if done is None else planned.join(done.select("example_id"), "example_id", "left_anti")
    run_id, model, source = config.run_id, config.model_snapshot_id, config.score_source

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [provider.generate(p, i) for p, i in zip(pdf["prompt"], pdf["example_id"])]
            ids = [hashlib.sha256(f"{run_id}:{i}".encode()).hexdigest()[:32] for i in pdf["example_id"]]
            yield pd.DataFrame({"generation_id": ids, "run_id": run_id, "example_id": pdf["example_id"], "model_snapshot_id": model, "raw_text": [t for t, _ in said], "score": [s for _, s in said], "score_kind": "raw", "score_source": source})

    return todo.mapInPandas(work, "generation_id string, run_id string, example_id string, model_snapshot_id string, raw_text string, score double, score_kind string, score_source string")


def completeness(planned: DataFrame, log: DataFrame) -> DataFrame:
    """``example_id, problem``: planned examples without a generation, generations nobody planned, examples generated twice."""
    diff = lineage.id_difference(planned.select("example_id"), log.select("example_id"), "example_id").withColumnRenamed("side", "problem")
    twice = lineage.duplicate_keys(log, "example_id").select("example_id", F.lit("duplicate").alias("problem"))
    return diff.unionByName(twice)


def score(log: DataFrame, examples: DataFrame) -> DataFrame:
    """Scored rows: correct, token_f1 and abstained beside the generation; unknown or repeated examples are errors."""
    if not lineage.duplicate_keys(examples, "example_id").isEmpty():
        raise ValueError("example ids must be unique")
    if not log.join(examples, "example_id", "left_anti").isEmpty():
        raise KeyError("a generation belongs to no example")
    j = log.join(examples.select("example_id", "dataset_id", "level", "split", "accepted_answers"), "example_id")
    return j.withColumn("correct", exact_match("raw_text", "accepted_answers").cast("int")).withColumn("token_f1", token_f1("raw_text", "accepted_answers")).withColumn("abstained", is_abstention(F.col("raw_text")))


def score_differences(scored: DataFrame, log: DataFrame, examples: DataFrame) -> DataFrame:
    """``example_id`` of scored rows that a fresh scoring does not confirm."""
    fresh = score(log, examples).select("example_id", F.col("correct").alias("_c"), F.col("token_f1").alias("_f"))
    j = scored.join(fresh, "example_id", "full")
    same = F.col("correct").eqNullSafe(F.col("_c")) & (F.abs(F.col("token_f1") - F.col("_f")) < 1e-12)
    return j.where(~F.coalesce(same, F.lit(False))).select("example_id")


def fit_calibrator(scored: DataFrame, config: RunConfig, path: str | None = None) -> dict:
    """A frozen global calibrator with level-balanced weights; only for the calibration split, with both outcomes."""
    if config.split != "calibration":
        raise ValueError("a calibrator is fitted on the calibration split only")
    support = scored.groupBy("dataset_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right")).orderBy("dataset_id", "level").collect()
    n, right = sum(r.n for r in support), sum(r.right for r in support)
    if n < 2 or right in (0, n):
        raise ValueError("calibration needs at least two rows and both outcomes")
    blocks = isotonic.fit(isotonic.level_balanced_weights(scored, "level"), "score", "correct", "weight").orderBy("block").collect()
    base = {"method": "weighted_isotonic_pava", "identity": config.identity, "run": asdict(config), "blocks": [r.asDict() for r in blocks], "groups": [{"dataset_id": r.dataset_id, "level": r.level, "n": r.n} for r in support]}
    model = base | {"calibrator_id": f"isotonic-{content_hash(base)[:20]}"}
    if path:
        freeze_json(path, model)
    return model


def calibrate(scored: DataFrame, model: dict, config: RunConfig, least_support: int = 1) -> DataFrame:
    """Scored rows with ``confidence``; groups the calibrator has not seen often enough get null and are unsupported."""
    if model["identity"] != config.identity:
        raise ValueError("model, prompt, decoding or score source differ from those of the calibrator")
    spark = scored.sparkSession
    table = spark.createDataFrame([(g["dataset_id"], g["level"], g["n"]) for g in model["groups"]], "dataset_id string, level string, support long")
    blocks = F.array(*[F.struct(F.lit(float(b["lower"])).alias("lower"), F.lit(float(b["upper"])).alias("upper"), F.lit(float(b["value"])).alias("value")) for b in model["blocks"]])
    j = scored.join(F.broadcast(table), ["dataset_id", "level"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    ok = F.col("support") >= least_support
    return j.withColumn("calibration_supported", ok).withColumn("confidence", F.when(ok, isotonic.predict(F.col("score"), blocks))).withColumn("calibrator_id", F.lit(model["calibrator_id"]))


def decisions(calibrated: DataFrame) -> DataFrame:
    """Every calibrated row at every policy threshold: action and reason."""
    return policy.decide_r7(calibrated, "raw_text", "confidence")


def run_report(scored: DataFrame) -> DataFrame:
    """Count, accuracy, mean F1, abstention and mean score by source and level, with totals."""
    return scored.rollup("dataset_id", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("token_f1").alias("mean_f1"), F.avg(F.col("abstained").cast("double")).alias("abstention"), F.avg("score").alias("mean_score")
    )


def refine(adapted: object, keys: dict[str, str], fractions: tuple[float, ...] = (0.2, 0.3, 0.5), seed: int = 0) -> DataFrame:
    """Adapted examples with a leakage-free split: lineage components, hash assignment, and the check that nothing crosses."""
    examples = adapted.examples
    tokens = lineage.lineage_tokens(examples, "example_id", keys)
    splits = lineage.assign_splits(examples, "example_id", tokens, fractions, seed)
    lineage.require_no_leakage(tokens, splits.select("row", "split"))
    return examples.drop("split").join(splits.select(F.col("row").alias("example_id"), "component", "split"), "example_id")


def readiness(examples: DataFrame, seeds: DataFrame) -> DataFrame:
    """``source_id, examples, seeds, with_proxy, with_dates, ready``: how far the condition seeds of each source are filled in."""
    s = seeds.groupBy("source_id").agg(F.count(F.lit(1)).alias("seeds"), F.count("proxy").alias("with_proxy"), F.count("event_date").alias("with_dates"))
    e = examples.join(seeds.select("example_id", "source_id"), "example_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("examples"))
    return e.join(s, "source_id", "left").withColumn("ready", F.coalesce((F.col("seeds") == F.col("examples")) & (F.col("with_proxy") == F.col("seeds")), F.lit(False)))


def certificate(result: dict, workload: dict, manifest: dict, assumptions: dict[str, bool], scope: str | None = None) -> dict:
    """The certificate of one read with its derived guarantee; parts that contradict each other are errors."""
    if result["example_id"] != workload["example_id"]:
        raise ValueError("result and workload are about different examples")
    if result["run_id"] != manifest["run_id"]:
        raise ValueError("the result belongs to another run than the manifest")
    if result["threshold"] not in manifest["policy_grid"]:
        raise ValueError("the threshold is not in the policy grid")
    open_ended = workload["track"] == "open_ended_stress"
    if scope and open_ended:
        raise ValueError("an open-ended track cannot claim coverage")
    supported = bool(result.get("calibration_supported"))
    if not supported and result["action"] != "abstain":
        raise ValueError("without calibration support a read must abstain")
    status = (
        "none_open_ended_generated_candidates" if open_ended
        else "none_unsupported_calibration" if not supported
        else "none_assumptions_not_satisfied" if not all(assumptions.values())
        else "none_not_claimed" if scope is None
        else f"finite_label_{'marginal' if scope == 'marginal' else 'group_marginal'}_under_recorded_assumptions"
    )
    body = {
        "schema_version": 1, "example_id": result["example_id"], "run_id": result["run_id"], "generation_id": result["generation_id"], "threshold": result["threshold"], "action": result["action"], "answer": result.get("answer"),
        "track": workload["track"], "assumption_status": assumptions, "coverage_scope": scope, "guarantee_status": status, "calibration_supported": supported,
        "evidence_hashes": {"result": content_hash(result), "workload": content_hash(workload), "manifest": content_hash(manifest)},
    }
    return body | {"content_hash": content_hash(body)}


def validate_certificate(cert: dict, result: dict, workload: dict, manifest: dict) -> None:
    """Rebuild the certificate from its sources and compare every field."""
    fresh = certificate(result, workload, manifest, cert.get("assumption_status", {}), cert.get("coverage_scope"))
    off = sorted(k for k in fresh.keys() | cert.keys() if fresh.get(k) != cert.get(k))
    if off:
        raise ValueError(f"the certificate does not match its sources in {off}")
