"""Batched inference of the window network: a model's folder, its contract, and windows through its weights.

A model is a folder that Spark can read: ``manifest`` (one JSON document, the contract) and
``weights`` (Parquet: name, shape, values). Loading refuses a contract of another major or an older
version, other features or window lengths, weights that don't fit, and weights beyond
``MOST_WEIGHTS``; there is no way round it. The weights are broadcast once; windows go through in Arrow
batches, normalised by the manifest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.kernels import network
from kinelake.operators.features import FEATURES
from kinelake.schema import RATE_HZ, WINDOW_ROWS

LEAST_VERSION = "1.0.0"
#: Weights that are broadcast; the contract's model has under 17,000, a mobile one under 50,000.
MOST_WEIGHTS = 4_000_000
#: Windows that go through the layers at once.
AT_ONCE = 2048


class ContractRefused(ValueError):
    """A model that mustn't be run; callers fall back to the filter without a model."""


@dataclass(frozen=True)
class Contract:
    contract_version: str = LEAST_VERSION
    window_size_samples: int = WINDOW_ROWS
    sample_rate_hz: int = RATE_HZ
    feature_order: tuple[str, ...] = FEATURES
    mean: tuple[float, ...] = (0.0,) * len(FEATURES)
    std: tuple[float, ...] = (1.0,) * len(FEATURES)
    output_mean_name: str = "velocity_mean_mps"
    output_logvar_name: str = "velocity_log_variance"

    @staticmethod
    def from_manifest(document: dict) -> Contract:
        """From the nested manifest beside a model."""
        scale, outputs = document["normalization"], set(document["outputs"])
        missing = {Contract.output_mean_name, Contract.output_logvar_name} - outputs
        if missing:
            raise ContractRefused(f"the manifest has no output {sorted(missing)}")
        return Contract(document["contract_version"], int(document["window_size_samples"]), int(document["sample_rate_hz"]), tuple(document["feature_order"]), tuple(map(float, scale["mean"])), tuple(map(float, scale["std"])))

    @staticmethod
    def from_metadata(properties: dict[str, str]) -> Contract:
        """From a model file's own properties, all strings, lists joined by commas."""
        numbers = lambda name: tuple(map(float, properties[name].split(",")))
        try:
            return Contract(properties["contract_version"], int(properties["window_size_samples"]), int(properties["sample_rate_hz"]), tuple(properties["feature_order"].split(",")), numbers("norm_mean"), numbers("norm_std"), properties["output_mean_name"], properties["output_logvar_name"])
        except KeyError as missing:
            raise ContractRefused(f"the model's properties lack {missing}") from None

    def manifest(self) -> dict:
        outputs = {self.output_mean_name: {"shape": [1, 1]}, self.output_logvar_name: {"shape": [1, 1]}}
        flat = asdict(self)
        return {k: flat[k] for k in ("contract_version", "window_size_samples", "sample_rate_hz", "feature_order")} | {"normalization": {"mean": self.mean, "std": self.std}, "outputs": outputs}


def compatible(version: str, least: str) -> bool:
    """The same major, and not older; anything that isn't three numbers is incompatible."""
    try:
        (major, *rest), (least_major, *least_rest) = ([int(p) for p in v.split(".")] for v in (version, least))
    except ValueError:
        return False
    return major == least_major and len(rest) == len(least_rest) == 2 and rest >= least_rest


def refuse(contract: Contract, weights: dict[str, np.ndarray], least: str = LEAST_VERSION, features: tuple[str, ...] = FEATURES, size: int = WINDOW_ROWS, rate: int = RATE_HZ) -> None:
    """Raises ``ContractRefused`` with every reason why the model mustn't be run on such windows."""
    n = len(contract.feature_order)
    reasons = [
        (not compatible(contract.contract_version, least), f"contract {contract.contract_version} is not compatible with {least}"),
        (contract.feature_order != tuple(features), f"features {contract.feature_order}, not {tuple(features)}"),
        (contract.window_size_samples != size, f"windows of {contract.window_size_samples} rows, not {size}"),
        (contract.sample_rate_hz != rate, f"{contract.sample_rate_hz} rows a second, not {rate}"),
        (not len(contract.mean) == len(contract.std) == n, "a mean and a deviation are needed for each feature"),
        (not all(np.isfinite(contract.mean)) or not all(s > 0 and np.isfinite(s) for s in contract.std), "means must be finite, deviations positive"),
    ]
    said = [text for bad, text in reasons if bad] + network.problems(weights, n)
    if said:
        raise ContractRefused("; ".join(said))


@dataclass(frozen=True)
class Model:
    contract: Contract
    weights: dict[str, np.ndarray]


def save_model(spark: SparkSession, model: Model, folder: str) -> None:
    """Write a model's folder; an existing one is an error."""
    spark.createDataFrame([(json.dumps(model.contract.manifest()),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    rows = [(name, list(w.shape), w.ravel().tolist()) for name, w in model.weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<float>").coalesce(1).write.parquet(f"{folder}/weights")


def load_model(spark: SparkSession, folder: str, least: str = LEAST_VERSION, features: tuple[str, ...] = FEATURES, size: int = WINDOW_ROWS, rate: int = RATE_HZ) -> Model:
    """The one way to a model: read, checked, and refused if its contract or its weights don't fit."""
    contract = Contract.from_manifest(json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifest", wholetext=True).collect())))
    table = spark.read.parquet(f"{folder}/weights")
    numbers = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if numbers > MOST_WEIGHTS:
        raise ContractRefused(f"{numbers} weights; at most {MOST_WEIGHTS} are broadcast")
    weights = {r["name"]: np.array(r["values"], dtype=np.float32).reshape(r["shape"]) for r in table.collect()}
    refuse(contract, weights, least, features, size, rate)
    return Model(contract, weights)


OUTPUTS = {"mean": "velocity_mean_mps double, velocity_variance double", "context": "context_logits array<double>", "yaw": "yaw_increment_rad double, yaw_variance double"}


def infer(windows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """(keys, refused, velocity_mean_mps, velocity_variance, ...) for windows x (rows x features, raw or as the manifest's means and deviations expect).

    The variance is the exponential of the network's output, here and nowhere else. Outputs of heads that the
    weights have follow. A window that is null, of another shape, or holds null or non-finite values has
    ``refused`` say why and null outputs, and so has one whose outputs aren't finite, so that callers fall back.
    """
    refuse(model.contract, model.weights, features=model.contract.feature_order, size=model.contract.window_size_samples, rate=model.contract.sample_rate_hz)
    spark, size, n = windows.sparkSession, model.contract.window_size_samples, len(model.contract.feature_order)
    heads = network.heads_of(model.weights)
    sent = spark.sparkContext.broadcast({k: w.astype(np.float64) for k, w in model.weights.items()})
    mean, std = np.array(model.contract.mean), np.array(model.contract.std)
    x = F.col("x")
    odd = F.exists(x, lambda row: row.isNull() | (F.size(row) != n))
    bad = F.exists(x, lambda row: F.exists(row, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    refused = F.when(x.isNull(), "null").when((F.size(x) != size) | odd, "shape").when(bad, "not finite")
    flat = F.flatten(x).cast("array<double>")
    rows = windows.select(*keys, refused.alias("refused"), F.when(refused.isNull(), flat).alias("x"))
    added = T.StructType.fromDDL(", ".join(OUTPUTS[h] for h in heads if h in OUTPUTS))
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])

    def columns(out: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        yield from (out["mean"][:, 0], np.exp(np.minimum(out["logvar"][:, 0], 700.0)))
        if "context" in out:
            yield out["context"]
        if "yaw" in out:
            yield from (out["yaw"][:, 0], np.exp(np.minimum(out["yaw"][:, 1], 700.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), AT_ONCE):
                batch = whole.slice(a, AT_ONCE)
                good = np.flatnonzero(batch.column(len(keys) + 1).is_valid().to_numpy(zero_copy_only=False))
                values = batch.column(len(keys) + 1).take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, n)
                said = np.array(batch.column(len(keys)).to_pylist(), dtype=object)
                with np.errstate(over="ignore", invalid="ignore"):
                    made = list(columns(network.forward(sent.value, (values - mean) / std)))
                fine = np.all([np.isfinite(c).reshape(len(good), -1).all(axis=1) for c in made], axis=0)
                said[good[~fine]] = "outputs not finite"
                out = []
                for c in made:
                    spread = np.full((len(batch), *c.shape[1:]), np.nan)
                    spread[good] = c
                    there = np.isin(np.arange(len(batch)), good[fine])
                    out.append(pa.array([v if t else None for v, t in zip(spread.tolist(), there, strict=True)], pa.list_(pa.float64()) if c.ndim == 2 else pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(said, pa.string()), *out], names=schema.names)

    return rows.mapInArrow(run, schema)
