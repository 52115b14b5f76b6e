"""Graph networks in numpy over subgraphs: vertex classification, link prediction, metrics.

A subgraph is a row (root, label, features flattened, edge sources, edge targets). Gradients are summed where the
subgraphs are and meet on the driver, where one step of Adam is made for each epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Training:
    epochs: int = 10
    rate: float = 0.01
    decay: float = 5e-4
    hidden: int = 16
    seed: int = 1
    history: list[tuple[float, float]] = field(default_factory=list)


def initial(inputs: int, hidden: int, outputs: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    return {"w1": draw(inputs, hidden), "b1": np.zeros(hidden), "w2": draw(hidden, outputs), "b2": np.zeros(outputs)}


def gather(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Sum over incoming edges, without normalisation or added loops."""
    out = np.zeros_like(x)
    np.add.at(out, dst, x[src])
    return out


def forward(w, x, src, dst):
    z1 = gather(x @ w["w1"], src, dst) + w["b1"]
    h = np.maximum(z1, 0)
    z2 = gather(h @ w["w2"], src, dst) + w["b2"]
    z2 = z2 - z2.max(axis=1, keepdims=True)
    return z1, h, z2 - np.log(np.exp(z2).sum(axis=1, keepdims=True))


def gradients(w, x, src, dst, node: int, label: int):
    """Loss, whether the root is labelled rightly, and the gradients of one subgraph."""
    z1, h, logp = forward(w, x, src, dst)
    d2 = np.zeros_like(logp)
    d2[node] = np.exp(logp[node])
    d2[node, label] -= 1
    back2 = gather(d2, dst, src)
    d1 = (back2 @ w["w2"].T) * (z1 > 0)
    back1 = gather(d1, dst, src)
    return -logp[node, label], logp[node].argmax() == label, {"w1": x.T @ back1, "b1": d1.sum(axis=0), "w2": h.T @ back2, "b2": d2.sum(axis=0)}


def subgraphs(ego: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, label, node, x, src, dst) from edges (root, src, dst), features (id, features) and labels (id, label)."""
    nodes = ego.select("root", F.col("src").alias("id")).union(ego.select("root", "dst")).distinct().join(features, "id")
    local = nodes.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("id", "features"))).alias("n"))
    edges = ego.groupBy("root").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("e"))
    at = lambda c: f"transform(e, x -> CAST(array_position(transform(n, y -> y.id), x.{c}) - 1 AS int))"
    rows = local.join(edges, "root").join(labels.withColumnRenamed("id", "root"), "root")
    return rows.select("root", "label", F.expr("CAST(array_position(transform(n, y -> y.id), root) - 1 AS int)").alias("node"), F.expr("flatten(transform(n, y -> y.features))").alias("x"), F.expr(at("src")).alias("src"), F.expr(at("dst")).alias("dst"))


def _arrays(row, width: int):
    return np.asarray(row.x, float).reshape(-1, width), np.asarray(row.src, int), np.asarray(row.dst, int)


def train(graphs: DataFrame, inputs: int, outputs: int, how: Training | None = None) -> tuple[dict, Training]:
    how = how or Training()
    w = initial(inputs, how.hidden, outputs, how.seed)
    names, shapes = list(w), {k: v.shape for k, v in w.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for epoch in range(1, how.epochs + 1):
        shared = graphs.sparkSession.sparkContext.broadcast(w)

        def run(batches, shared=shared):
            total, loss, right, n = None, 0.0, 0, 0
            for df in batches:
                for row in df.itertuples():
                    one, ok, g = gradients(shared.value, *_arrays(row, inputs), row.node, row.label)
                    flat = np.concatenate([g[k].reshape(-1) for k in names])
                    total = flat if total is None else total + flat
                    loss, right, n = loss + one, right + int(ok), n + 1
            if n:
                yield pd.DataFrame({"g": [total.tolist()], "loss": [loss], "right": [right], "n": [n]})

        got = graphs.mapInPandas(run, "g array<double>, loss double, right long, n long").collect()
        n = sum(r["n"] for r in got) or 1
        flat = sum((np.array(r["g"]) for r in sorted(got, key=lambda r: (r["n"], r["loss"]))), np.zeros(sum(v.size for v in w.values()))) / n
        how.history.append((sum(r["loss"] for r in got) / n, sum(r["right"] for r in got) / n))
        at = 0
        for k in names:
            size = int(np.prod(shapes[k]))
            g = flat[at : at + size].reshape(shapes[k]) + how.decay * w[k]
            at += size
            m, s = moment[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w[k] = w[k] - how.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8)
    return w, how


def classify(graphs: DataFrame, w: dict, inputs: int) -> DataFrame:
    """(root, label, predicted)."""
    shared = graphs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for df in batches:
            yield pd.DataFrame([(r.root, r.label, int(forward(shared.value, *_arrays(r, inputs))[2][r.node].argmax())) for r in df.itertuples()], columns=["root", "label", "predicted"])

    return graphs.mapInPandas(run, "root long, label int, predicted int")


def walk_profile(src: np.ndarray, dst: np.ndarray, n: int, a: int, b: int, steps: int = 4) -> np.ndarray:
    """Probabilities of returning to and of moving between a link's ends in 2 .. steps steps, with and without the link."""
    out = []
    for with_link in (True, False):
        m = np.zeros((n, n))
        np.add.at(m, (src, dst), 1.0)
        m[a, b] = m[b, a] = float(with_link)
        m = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        power = m
        for _ in range(2, steps + 1):
            power = power @ m
            out += [power[a, a] + power[b, b], power[a, b] + power[b, a], np.trace(power)]
    return np.array(out)


def auc(scored: DataFrame) -> DataFrame:
    """(auc) of (score, label): the part of pairs in the right order, ties counting half; scores are summed per value."""
    from .graph import running

    per = scored.groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("q"))
    below = running(per, "score", F.col("q"), "below")
    return below.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))
