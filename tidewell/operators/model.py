"""A small causal transformer: configuration, initial weights, forward pass, checkpoints and generation.

Sequences are rows; each task holds the weights, whose size the configuration alone sets, and computes whole
sequences with numpy.  Nothing is trained here.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.storage import filesystem, qualified


@dataclass(frozen=True)
class Config:
    vocab_size: int = 32768
    block_size: int = 256
    layers: int = 14
    heads: int = 16
    width: int = 1024

    def __post_init__(self) -> None:
        if self.width % self.heads:
            raise ValueError(f"{self.width} numbers cannot be shared evenly among {self.heads} heads")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Every parameter; the table of tokens is the output table too."""
        d = self.width
        out: dict[str, tuple[int, ...]] = {"tokens": (self.vocab_size, d), "positions": (self.block_size, d)}
        for k in range(self.layers):
            for norm in ("norm1", "norm2"):
                out |= {f"{k}.{norm}.scale": (d,), f"{k}.{norm}.shift": (d,)}
            for name, rows, columns in (("qkv", d, 3 * d), ("attended", d, d), ("wide", d, 4 * d), ("narrow", 4 * d, d)):
                out |= {f"{k}.{name}.weight": (rows, columns), f"{k}.{name}.bias": (columns,)}
        return out | {"norm.scale": (d,), "norm.shift": (d,)}


Weights = dict[str, np.ndarray]


def initial(config: Config, seed: int = 0) -> Weights:
    """Normal weights of deviation 0.02, less by the root of twice the layers where a block adds to its input; biases
    are zero, scales one."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in config.shapes().items():
        if name.endswith("scale"):
            out[name] = np.ones(shape)
        elif len(shape) == 1:
            out[name] = np.zeros(shape)
        else:
            last = name.endswith(("attended.weight", "narrow.weight"))
            out[name] = rng.normal(0.0, 0.02 / math.sqrt(2 * config.layers) if last else 0.02, shape)
    return out


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + 1e-5) * scale + shift


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def attention(x: np.ndarray, w: Weights, k: int, heads: int) -> np.ndarray:
    """Each place sees itself and those before it, in every head by itself."""
    n, d = x.shape
    q, key, v = ((x @ w[f"{k}.qkv.weight"] + w[f"{k}.qkv.bias"]).reshape(n, 3, heads, d // heads)).transpose(1, 2, 0, 3)
    scores = q @ key.transpose(0, 2, 1) / math.sqrt(d // heads)
    scores = np.where(np.tril(np.ones((n, n), bool)), scores, -np.inf)
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    mixed = (e / e.sum(axis=-1, keepdims=True)) @ v
    return mixed.transpose(1, 0, 2).reshape(n, d) @ w[f"{k}.attended.weight"] + w[f"{k}.attended.bias"]


def forward(ids: list[int], w: Weights, config: Config) -> np.ndarray:
    """(places, vocabulary): the logits after each id of one sequence."""
    if not 0 < len(ids) <= config.block_size:
        raise ValueError(f"{len(ids)} ids do not fit into a block of {config.block_size}")
    x = w["tokens"][ids] + w["positions"][: len(ids)]
    for k in range(config.layers):
        x = x + attention(_norm(x, w[f"{k}.norm1.scale"], w[f"{k}.norm1.shift"]), w, k, config.heads)
        wide = _gelu(_norm(x, w[f"{k}.norm2.scale"], w[f"{k}.norm2.shift"]) @ w[f"{k}.wide.weight"] + w[f"{k}.wide.bias"])
        x = x + wide @ w[f"{k}.narrow.weight"] + w[f"{k}.narrow.bias"]
    return _norm(x, w["norm.scale"], w["norm.shift"]) @ w["tokens"].T


def loss(logits: np.ndarray, targets: list[int]) -> float:
    """Mean cross-entropy."""
    top = logits.max(axis=-1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=-1)) + top[:, 0] - logits[np.arange(len(targets)), targets]).mean())


def logits(sequences: DataFrame, w: Weights, config: Config) -> DataFrame:
    """(seq, pos, logits) of sequences (seq, ids)."""
    shared = sequences.sparkSession.sparkContext.broadcast(w)  # of the configuration's size

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for seq, ids in zip(p["seq"], p["ids"], strict=True):
                found = forward(list(ids), shared.value, config)
                yield pd.DataFrame({"seq": seq, "pos": np.arange(len(found)), "logits": list(found)})

    return sequences.select(F.col("seq").cast("long").alias("seq"), "ids").mapInPandas(run, "seq long, pos int, logits array<double>")


def uniform(seed: str, seq: int, step: int) -> float:
    return int(hashlib.md5(f"{seed}:{seq}:{step}".encode()).hexdigest()[:8], 16) / 4294967296.0


def drawn(scores: np.ndarray, u: float, temperature: float, top_k: int | None) -> int:
    """The first id, by number, at which the running sum of probabilities reaches u; ties at the last place stay."""
    scores = scores / temperature
    if top_k and top_k < len(scores):
        scores = np.where(scores >= np.sort(scores)[-top_k], scores, -np.inf)
    e = np.exp(scores - scores.max())
    reached = np.cumsum(e / e.sum()) >= u
    return int(reached.argmax()) if reached.any() else int(np.flatnonzero(e)[-1])


def generate(prompts: DataFrame, w: Weights, config: Config, n: int, temperature: float = 1.0, top_k: int | None = None, seed: str = "0", end_id: int = 0) -> DataFrame:
    """(seq, ids): n ids appended to each prompt (seq, ids); an empty or null one starts from the end-of-text id."""
    shared = prompts.sparkSession.sparkContext.broadcast(w)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for seq, ids in zip(p["seq"], p["ids"], strict=True):
                ids = [end_id] if ids is None or not len(ids) else list(ids)
                for step in range(n):
                    ids.append(drawn(forward(ids[-config.block_size :], shared.value, config)[-1], uniform(seed, seq, step), temperature, top_k))
                out.append(ids)
            yield pd.DataFrame({"seq": p["seq"], "ids": out})

    return prompts.select(F.col("seq").cast("long").alias("seq"), "ids").mapInPandas(run, "seq long, ids array<int>")


def save(spark: SparkSession, path: str, w: Weights, config: Config, step: int = 0) -> None:
    """One file with the weights, the configuration and the step; it gets its name when it is whole."""
    fs, name = filesystem(qualified(spark, path))
    held = io.BytesIO()
    np.savez(held, __about__=np.array(json.dumps({"config": asdict(config), "step": step})), **w)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{name}.part") as out:
        out.write(held.getvalue())
    fs.move(f"{name}.part", name)


def load(spark: SparkSession, path: str) -> tuple[Weights, Config, int]:
    fs, name = filesystem(qualified(spark, path))
    with fs.open_input_file(name) as file:
        found = np.load(io.BytesIO(file.read()))
    about = json.loads(str(found["__about__"]))
    config = Config(**about["config"])
    w = {k: found[k] for k in found.files if k != "__about__"}
    if {k: v.shape for k, v in w.items()} != config.shapes():
        raise ValueError(f"{path} does not hold the weights of its configuration")
    return w, config, about["step"]
