"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

A text is folded to lower case; every byte n-gram (2 to 4 bytes) inside a letter run, with one space on either side as
its border, is a subword. Subwords hash to rows of an embedding table; a text is the average of its rows; a linear
softmax over the average gives the languages. Table and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows. A held-out part of that sample sets a temperature and the confidence below
which a prediction is rejected.

As average and softmax are linear up to the last step, a trained model is used as one small table of logits for each
subword, so a text costs a lookup for each subword and language.

Cases: a null text or one without a letter is `und` with score 0 and is rejected. Repeated rows are predicted alike.
An empty table, or one without labelled rows, gives a model without languages, which calls everything `und`. Extra
columns are ignored. The whole text is used, whatever its length, in pieces of bounded size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, strings, tidy

SAMPLE_ROWS = 1500  # most labelled rows that the classifier is fitted on
ROWS = 1 << 15  # hashed subwords
WIDTH = 16  # numbers in an embedding
ORDERS = (2, 3, 4)
PIECE = 1 << 19  # characters folded at a time
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Model:
    """Logits of each hashed subword, the languages, the temperature and the least accepted confidence."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed row of the subword at each place, and whether there is one there."""
    buf = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    space = buf == 32
    wide = buf.astype(np.uint32)
    out = []
    grams = wide
    for order in range(2, max(ORDERS) + 1):
        n = len(buf) - order + 1
        if n <= 0:
            break
        grams = (grams[:n] << np.uint32(8)) | wide[order - 1 :]
        if order in ORDERS:
            inner = np.ones(n, bool)
            for k in range(1, order - 1):
                inner &= ~space[k : k + n]
            inner &= ~(space[:n] & space[order - 1 :])
            h = (grams ^ np.uint32(order * 0x01000193)) * np.uint32(0x9E3779B1)
            out.append(((h >> np.uint32(32 - 15)).astype(np.int32) & np.int32(ROWS - 1), inner))
    return out


def pieces(text: str):
    """Lower-cased UTF-8 in pieces cut at white space where there is any."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        if to < len(text):
            cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to))
            to = cut if cut > at else to
        yield text[at:to].lower().encode("utf-8", "replace")
        at = to


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subword rows of a text and their counts."""
    got = [h[ok] for piece in pieces(text) for h, ok in subwords(piece)]
    return np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)


def fit(rows: list[tuple[str, str]], epochs: int = 4, batch: int = 16, rate: float = 4.0, seed: int = 7, lose: float = 0.001) -> Model:
    """Train on (text, language) rows; every fifth row only calibrates."""
    rows = [(t, y) for t, y in rows if t and y and LETTER.search(t)]
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    index = {y: i for i, y in enumerate(labels)}
    bags = [counted(t) for t, _ in rows]
    y = np.array([index[x] for _, x in rows])
    rng = np.random.default_rng(seed)
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    embed = (rng.random((ROWS, WIDTH), np.float32) - 0.5) / WIDTH
    out = np.zeros((WIDTH, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = max(1, epochs * -(-len(train) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            lr = rate * (1 - done / steps)
            done += 1
            pick = order[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in pick])
            sizes = np.array([len(bags[i][0]) for i in pick])
            share = np.concatenate([bags[i][1] / max(1, bags[i][1].sum()) for i in pick]).astype(np.float32)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(embed[ids] * share[:, None], starts)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = p @ out.T
            out -= lr * (mean.T @ p)
            bias -= lr * p.sum(axis=0)
            for i, g in zip(pick, back * np.float32(lr * len(pick)), strict=True):  # rows are distinct within a text
                embed[bags[i][0]] -= (bags[i][1] / max(1, bags[i][1].sum())).astype(np.float32)[:, None] * g
    table = (embed @ out).astype(np.float32)
    model = Model(labels, table, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    logits = model.logits(np.array([(table[bags[i][0]] * bags[i][1][:, None]).sum(axis=0) for i in check]), np.array([bags[i][1].sum() for i in check]))
    best = (np.inf, 1.0)
    hope = np.full((len(check), len(labels)), 1 / (len(check) + 2) / len(labels))  # a sample without errors proves no certainty
    hope[np.arange(len(check)), y[check]] += 1 - 1 / (len(check) + 2)
    for t in np.geomspace(0.02, 5, 60):
        model.temperature = float(t)
        p = model.probabilities(logits)
        best = min(best, (float(-(hope * np.log(np.maximum(p, 1e-30))).sum(axis=1).mean()), float(t)))
    model.temperature = best[1]
    p = model.probabilities(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    # reject below what all but a share of the rightly named held-out rows reach, and never above an even chance
    model.accept = float(min(0.5, np.quantile(right, lose))) if len(right) else 0.0
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated confidence and whether it is accepted, for each text."""
    n, langs = len(texts), len(model.labels)
    sums, counts = np.zeros((n, langs), np.float64), np.zeros(n, np.int64)
    known = np.zeros(n, bool)
    if langs:
        columns = [np.ascontiguousarray(model.table[:, k]) for k in range(langs)]
        held: list[tuple[int, bytes]] = []

        def flush() -> None:
            if not held:
                return
            sizes = np.array([len(b) + 1 for _, b in held])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            who = np.array([i for i, _ in held])
            for rows, ok in subwords(b" ".join(b for _, b in held)):
                cuts = np.minimum(starts, len(rows) - 1)
                np.add.at(counts, who, np.add.reduceat(ok.astype(np.int64), cuts))
                for k in range(langs):
                    np.add.at(sums[:, k], who, np.add.reduceat(columns[k][rows] * ok, cuts, dtype=np.float64))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            if text and LETTER.search(text):
                known[i] = True
                for piece in pieces(text):
                    held.append((i, piece))
                    size += len(piece)
                    if size >= PIECE:
                        flush()
                        size = 0
        flush()
    known &= counts > 0
    names, score = np.array([UNKNOWN] * n, object), np.zeros(n)
    if known.any():
        p = model.probabilities(model.logits(sums[known], counts[known]))
        names[known] = np.array(model.labels, object)[p.argmax(axis=1)]
        score[known] = p.max(axis=1)
    return list(names), score, known & (score >= model.accept)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows, those whose number's digest comes first; fold 2 of 4 is left out."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 4) != 2))
    ids = [r[0] for r in labelled.select("doc_id").distinct().orderBy(F.crc32(F.reverse(F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(sample_rows).collect()]
    # one row of each number, so that repeated ones don't add to what is collected
    rows = labelled.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang").collect() if ids else []
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows)
    return fit([(t, y) for _, t, y in rows])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict every row: the columns named in keep as one struct, then lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or docs.columns[:1]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), *([] if "text" in kept else ["text"]))
    where = kept.index("text") if "text" in kept else None  # a text that is kept is sent once

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1) if where is None else batch.column(0).field(where)
                names, score, ok = predict(shared.value, strings(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ok)], names=["kept", "lang_pred", "score", "accepted"])
            tidy()

    return held.mapInArrow(run, f"kept {held.schema['kept'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs), ("doc_id",))
    return found.select("kept.doc_id", "lang_pred", "score", "accepted").select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go. Returns the columns of docs."""
    return identify(docs, train(docs), tuple(docs.columns)).where("accepted").select("kept.*")
