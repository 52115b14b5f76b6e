"""Language-model scores: a causal self-attention model over subword ids, in numpy, beside a word unigram.

Tokens are words `[^\\x20\\x09-\\x0D]+`, lower-cased over A-Z, and one end for each text. Words are cut in the pieces of a public
byte-pair vocabulary (its path is a parameter; it is read by the driver and sent along). A piece and whether it ends its
word make a unit. One head of causal self-attention, with a learned bias for each distance, predicts the class of the next
unit; a unit's share of its class comes from counts, within a word from the counts after the unit before it. Texts are scored in overlapping windows: the first CONTEXT inputs of
a window are there to be attended to, the others are scored, so that each unit is scored once.

Classes of units follow the sketches of the documents that the units occur in, so that predicting the class takes in what kind of
text the window shows. The model's probability of a word is a mixture: a share times the predicted probability of its first
unit's class times its part of that class's training words, which is 0 for unknown words, and the rest times the
probability of its units. An end is predicted as a class of its own.

Everything is learned from all training documents. All texts are cut in words and units once, and kept in parts. One pass
counts words in buckets of their hashes, units, words by first unit, sketches of units' documents and pairs of units within
words; each part is told its words' counts. From a few documents come the weights to start from; then every task takes them
through all windows of its training documents, and the tasks' weights are averaged. Sums for all shares of the mixture are
kept for each text; the share taken is the one under which all training words, each occurrence left out of its own counts,
are likeliest. The pairs go to the driver and to all tasks, 20 bytes for each distinct one.

Cases: a null or empty text is its end alone. Rows that share a doc_id give one row with the sums over them. Rows with a
null doc_id are left out. Without training documents every word is unknown and the base is the same for all tokens. An
empty table gives an empty result. Extra columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
import functools
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, bounded_batches, bucket_count, by_bucket, checkpointed, chunks, corpus_size, crc, crc_remainder, expanded, mix, pack, ranges, squeezed, steady, tidy, unpack

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAMPLE_DOCS, CHECK_DOCS = 320, 40  # about so many documents together give the weights that all training documents then start from
WINDOW, CONTEXT = 16, 4  # inputs of a window, and those of them that are only attended to
WIDTH, CLASSES, OWN = 8, 49, 1024
GROUPS = 6  # groups of units by the documents that they occur in
SKETCH = 8  # numbers that a document is told by, for these groups
RATE = 0.005  # of the steps over all training documents
BATCH = 384  # windows of a step
SHARES = np.linspace(0.05, 0.95, 19)  # of the mixture; each is summed, the best one is taken
PRIOR = 5.0  # occurrences that a unit's share of its class counts for, beside those after the unit before it
BOUND = np.float32(60)  # of attention scores and of classes' logits
CACHE = 200_000
HELD = 1 << 19  # distinct pairs that a task holds at most before it sends them
CUT_BYTES, PART_BYTES = (1 << 20) - 64, 4 << 20  # of text whose distinct words are held once, and of text whose words are counted as one


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, first all lowest ones: the high ones are mostly zeros, so that they compress to less."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).reshape(-1)


def unplaned(a: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(a.reshape(size, len(a) // size).T).reshape(-1).view(kind)


@dataclass
class Seen:
    """What is counted over texts."""

    units: np.ndarray  # occurrences of each unit
    heads: np.ndarray  # words by their first unit
    near: np.ndarray  # (unit, SKETCH): the sketches of the documents of a unit's occurrences, added up
    pairs: tuple[np.ndarray, np.ndarray]  # sorted keys and counts of units that follow each other in a word


@dataclass
class Cut:
    """Documents cut in words and units: distinct words with their hashes and units, and which of them each word is."""

    ids: np.ndarray
    held: np.ndarray  # documents that are not learned from
    words: np.ndarray  # words of each document
    which: np.ndarray  # the place of each word among the distinct ones
    hashes: np.ndarray
    lengths: np.ndarray  # units of each distinct word
    flat: np.ndarray  # these units, end to end

    KINDS = (np.int64, np.bool_, np.int64, np.uint32, np.uint64, np.int32, np.int32)

    def packed(self) -> bytes:
        """Hashes, which are sorted, are sent as the steps between them."""
        fields = (self.ids, self.held, self.words, self.which, np.diff(self.hashes, prepend=np.uint64(0)), self.lengths, self.flat)
        return squeezed(pack(*(planes(a.astype(t, copy=False)) for a, t in zip(fields, self.KINDS, strict=True))))

    @classmethod
    def read(cls, blob) -> Cut:
        fields = unpack(expanded(blob.as_buffer()), *[np.uint8] * len(cls.KINDS))
        ids, held, words, which, steps, lengths, flat = (unplaned(a, t) for a, t in zip(fields, cls.KINDS, strict=True))
        return cls(ids, held, words, which, np.cumsum(steps, dtype=np.uint64), lengths, flat)

    def training(self) -> Cut:
        kept = ~self.held
        return Cut(self.ids[kept], self.held[kept], self.words[kept], self.which[np.repeat(kept, self.words)], self.hashes, self.lengths, self.flat)

    def inner(self) -> np.ndarray:
        """Places of flat that aren't their word's first."""
        inside = np.ones(len(self.flat), bool)
        inside[np.cumsum(self.lengths) - self.lengths] = False
        return np.flatnonzero(inside)


@dataclass
class Model:
    ranks: dict[bytes, int]
    cls: np.ndarray  # class of each unit; the last unit is the end of a text
    inside: np.ndarray  # log10 of a unit's share of its class
    row: np.ndarray  # row of the embedding of each unit; the last row stands for the beginning
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    totals: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # training words by the class of their first unit
    # sorted keys and their logs: pairs of units that follow each other in a word, and (unit, class of the next)
    pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))
    after: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))
    # what leaving one occurrence out of the counts adds to the logs of units and of pairs
    unit_less: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pair_less: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def ready(self, cutting: bool = True) -> None:
        if cutting:
            import tiktoken

            # every word, a space before it, is one piece of the pattern, so merges never look beyond it
            self.bpe = tiktoken.Encoding("units", pat_str=r" [^ ]*", mergeable_ranks=self.ranks, special_tokens={})
            self.opens = np.zeros(max(self.ranks.values(), default=0) + 1, bool)
            self.opens[[k for b, k in self.ranks.items() if b[:1] == b" "]] = True
        self.end, self.begin = len(self.cls) - 1, len(self.weights["embed"]) - 1
        # words cut before: their sorted hashes, where each one's units begin in the store, and how many they are
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store = np.zeros(0, np.int32)
        w = self.weights
        # the last row is that of places outside of a document: its key's score counts for nothing, as the column of ones is 0 there
        table = np.concatenate([w["embed"], np.zeros((1, WIDTH), np.float32)]).astype(np.float32)
        one = np.append(np.ones(len(table) - 1), 0).astype(np.float32)[:, None]
        self.q = np.concatenate([table @ w["wq"] * np.float32(1 / math.sqrt(WIDTH)), table], axis=1).astype(np.float32)
        self.k = (table @ w["wk"]).astype(np.float32)
        self.v = np.concatenate([one, table @ w["wv"]], axis=1).astype(np.float32)
        self.bias = distance_bias(w["bias"])
        most = lambda a: float(np.linalg.norm(a, axis=1).max(initial=0))
        self.low_scores = most(self.q[:, :WIDTH]) * most(self.k) + float(np.abs(w["bias"]).max()) < BOUND
        self.low_logits = "out" in w and (most(self.v[:, 1:]) + most(table)) * most(w["out"].T) + float(w["out_bias"].max()) < BOUND

    def rest(self) -> None:
        """Forgets what ready() made, before the model is sent."""
        for name in ("bpe", "opens", "known", "store", "q", "k", "v", "bias", "low_scores", "low_logits"):
            self.__dict__.pop(name, None)

    def units_of(self, words: list[bytes]) -> list[np.ndarray]:
        """The units of each word; words have no spaces, so that only a word's first piece begins with one."""
        if not words:
            return []
        got, lengths = self.flat_units(b" ".join(words))
        return np.split(got, np.cumsum(lengths)[:-1])

    def flat_units(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The units of words with a space between them, end to end, and how many each has."""
        got = np.array(self.bpe.encode_ordinary(" " + words.decode("utf-8", "replace")), np.int32)
        first = np.flatnonzero(self.opens[got])
        got *= 2
        ends = np.append(first[1:], len(got))
        got[ends - 1] += 1
        return got, (ends - first).astype(np.int32)

    def inner_logs(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """What knowing the unit before, in the same word, adds to log10 of a unit's share of its class."""
        return self.inner_both(before, units)[0]

    def inner_both(self, before: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """inner_logs, and what leaving one occurrence of the pair out adds to them."""
        before = before.astype(np.int64)
        unseen = looked_up(*self.after, before * CLASSES + self.cls[units])
        keys, values = self.pairs
        if not len(keys):
            return unseen, np.zeros(len(unseen))
        asked = before * len(self.cls) + units
        at = placed(keys, asked)
        there = keys[at] == asked
        return np.where(there, values[at], unseen), np.where(there, self.pair_less[at], 0)

    def learn(self, seen: Seen) -> None:
        """Learns each unit's share of its class, and inner_logs: share * PRIOR and the count, over PRIOR and the class's count."""
        smooth = seen.units + 0.05
        mass = np.bincount(self.cls, smooth, CLASSES)[self.cls]
        self.inside = np.log10(smooth / mass).astype(np.float32)
        self.unit_less = np.where(seen.units > 0, np.log10(np.maximum(smooth - 1, 0.05) / np.maximum(mass - 1, 0.05)) - self.inside, 0).astype(np.float32)
        pairs, c = seen.pairs
        a, b = pairs // len(self.cls), pairs % len(self.cls)
        classes, at = np.unique(a * CLASSES + self.cls[b], return_inverse=True)
        total = np.bincount(at, c, len(classes))
        self.after = classes, np.log10(PRIOR / (total + PRIOR))
        share = 10.0 ** self.inside[b].astype(np.float64)
        self.pairs = pairs, np.log10((c / share + PRIOR) / (total[at] + PRIOR))
        self.pair_less = (np.log10(((c - 1) / share + PRIOR) / (total[at] - 1 + PRIOR)) - self.pairs[1]).astype(np.float32)


AHEAD = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :]  # of a query over a key


def distance_bias(bias: np.ndarray) -> np.ndarray:
    """(queries, keys): the bias of each distance, and a large negative number where a key comes after its query."""
    return np.append(bias, -1e9).astype(np.float32)[np.where(AHEAD >= 0, AHEAD, WINDOW)]


def windows_of(rows: np.ndarray, sizes: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For streams laid end to end: (rows at all places, windows, places). Every document gets CONTEXT places outside of it
    before its first unit and as many more after its last one as fill its windows, so that window k is places
    k * (WINDOW - CONTEXT) and on, of which the last WINDOW - CONTEXT are scored; places tells where each unit is."""
    new = WINDOW - CONTEXT
    counts = -(-(sizes + CONTEXT) // new)
    start = (np.cumsum(counts) - counts) * new
    places = ranges(start + CONTEXT, sizes)
    laid = np.full(int(counts.sum()) * new + CONTEXT, outside, np.int16)
    laid[places] = rows
    return laid, np.lib.stride_tricks.sliding_window_view(laid, WINDOW)[::new], places


def inputs_of(model: Model, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The row that each unit of streams laid end to end is predicted from: that of the unit before it, or the beginning's."""
    rows = np.empty(len(units), np.int16)
    rows[1:] = model.row[units[:-1]]
    rows[np.cumsum(sizes) - sizes] = model.begin
    return rows


def unit_logs(model: Model, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each unit of streams laid end to end, each closed by the end unit."""
    laid, windows, places = windows_of(inputs_of(model, units, sizes), sizes, model.begin + 1)
    w, new, many = model.weights, WINDOW - CONTEXT, 512
    target = np.zeros(len(laid), np.int64)
    target[places] = model.cls[units]
    out = np.empty(len(laid), np.float32)
    z, ones, first = np.empty((many * new, CLASSES), np.float32), np.ones(CLASSES, np.float32), np.arange(many * new) * CLASSES
    for at in range(0, len(windows), many):
        some = windows[at : at + many]
        some = some.astype(np.intp)
        part = slice(at * new + CONTEXT, (at + len(some)) * new + CONTEXT)
        q = model.q.take(laid[part], axis=0).reshape(len(some), new, -1)
        s = np.matmul(q[:, :, :WIDTH], np.ascontiguousarray(model.k.take(some, axis=0).transpose(0, 2, 1)))
        if not model.low_scores:
            np.clip(s, -BOUND, BOUND, out=s)
        s += model.bias
        np.exp(s, out=s)
        h = np.matmul(s, model.v.take(some, axis=0))
        # every query of a document sees itself, so that only those outside of it have no sum
        h = h[:, :, 1:] / np.maximum(h[:, :, :1], np.float32(1e-30))
        h += q[:, :, WIDTH:]
        n = len(some) * new
        np.matmul(h.reshape(n, WIDTH), w["out"], out=z[:n])
        z[:n] += w["out_bias"]
        if not model.low_logits:
            np.clip(z[:n], -BOUND, BOUND, out=z[:n])
        picked = z.ravel().take(first[:n] + target[part])
        np.exp(z[:n], out=z[:n])
        out[part] = (picked - np.log(z[:n] @ ones)) * np.float32(1 / math.log(10))
    return out[places] + model.inside[units]


class Descent:
    """Adam on the attention model's weights."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        self.steps = 0

    def step(self, windows: np.ndarray, goal: np.ndarray, rate: float) -> None:
        """One step on (window, WINDOW) rows and the (window, WINDOW - CONTEXT) classes to predict, -1 where there is none."""
        w, many, new = self.w, len(windows), WINDOW - CONTEXT
        scale = np.float32(1 / math.sqrt(WIDTH))
        e = np.concatenate([w["embed"], np.zeros((1, WIDTH), np.float32)])
        asks, keys = e @ w["wq"] * scale, e @ w["wk"]
        values = np.ones((len(e), 1 + WIDTH), np.float32)  # the first column adds up the weights of attention
        values[:, 1:] = e @ w["wv"]
        windows = windows.astype(np.intp)
        asking = np.ascontiguousarray(windows[:, CONTEXT:])
        met, q, k, v = e.take(windows, axis=0), asks.take(asking, axis=0), keys.take(windows, axis=0), values.take(windows, axis=0)
        s = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        most = lambda a: math.sqrt(float(np.einsum("ij,ij->i", a, a).max()))
        if most(asks) * most(keys) > BOUND:
            np.clip(s, -BOUND, BOUND, out=s)
        s += distance_bias(w["bias"])
        np.exp(s, out=s)
        gone = windows == len(e) - 1
        edge = np.flatnonzero(gone.any(axis=1))
        s[edge] *= ~gone[edge][:, None, :]
        seen = np.matmul(s, v)
        part = 1 / np.maximum(seen[:, :, :1], np.float32(1e-30))  # weights of attention are s * part
        seen = seen[:, :, 1:] * part
        h = np.ones((many * new, WIDTH + 1), np.float32)  # the last column stands for the bias
        np.add(seen, met[:, CONTEXT:], out=h.reshape(many, new, -1)[:, :, :WIDTH])
        p = h @ np.concatenate([w["out"], w["out_bias"][None, :]])
        if (most(values[:, 1:]) + most(e)) * most(w["out"].T) + float(w["out_bias"].max()) > BOUND:
            np.minimum(p, BOUND, out=p)
        np.exp(p, out=p)
        goal = goal.reshape(-1)
        real = np.flatnonzero(goal >= 0)
        total = p @ np.ones(CLASSES, np.float32)
        weight = np.zeros(len(goal), np.float32)  # p * weight is the gradient at the logits
        weight[real] = 1 / max(1, len(real)) / total[real]
        p.reshape(-1)[real * CLASSES + goal[real]] -= total[real]
        h *= weight[:, None]
        dh = (p @ w["out"].T * weight[:, None]).reshape(many, new, WIDTH)
        out = (p.T @ h).T
        back = dh * part
        ds = np.matmul(back, np.ascontiguousarray(v[:, :, 1:].transpose(0, 2, 1)))
        ds -= (back * seen).reshape(-1, WIDTH).dot(np.ones(WIDTH, np.float32)).reshape(many, new, 1)
        ds *= s
        flat = lambda a: a.reshape(-1, WIDTH)
        dq, dk, dv = flat(np.matmul(ds, k)) * scale, flat(np.matmul(ds.transpose(0, 2, 1), q)), flat(np.matmul(s.transpose(0, 2, 1), back))
        de = (dk @ w["wk"].T + dv @ w["wv"].T).reshape(many, WINDOW, WIDTH)
        de[:, CONTEXT:] += dh + (dq @ w["wq"].T).reshape(dh.shape)
        grads = {
            "embed": added(windows.reshape(-1), de, len(e))[:-1], "wq": flat(met[:, CONTEXT:]).T @ dq, "wk": flat(met).T @ dk, "wv": flat(met).T @ dv,
            "bias": np.bincount(np.maximum(AHEAD, 0).reshape(-1), (ds.sum(axis=0) * (AHEAD >= 0)).reshape(-1), WINDOW), "out": out[:-1], "out_bias": out[-1],
        }
        self.steps += 1
        for name, g in grads.items():
            a, b = self.moment[name]
            a += (g - a) * np.float32(0.1)
            b += (g * g - b) * np.float32(0.01)
            w[name] -= (rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)


def added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of values for each place at[i] of n."""
    columns = np.ascontiguousarray(values.reshape(-1, values.shape[-1]).T, np.float64)
    return np.stack([np.bincount(at, c, n) for c in columns], axis=1).astype(np.float32)


@functools.lru_cache(1)
def signs(n: int) -> np.ndarray:
    return (np.random.default_rng(5).integers(0, 2, (n, SKETCH)) * 2 - 1).astype(np.int8)


def sketched(n: int, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(unit, 1 + SKETCH): for streams laid end to end each unit's occurrences, and the sketches of their documents, added up.

    A document's sketch is the direction, in whole numbers, of the sum of fixed random signs of its units: documents of
    the same kind of text have much the same one. Whole numbers add up to the same in any order."""
    if not len(sizes):
        return np.zeros((n, 1 + SKETCH), np.int64)
    x = np.add.reduceat(signs(n).take(units, axis=0), np.cumsum(sizes) - sizes, axis=0, dtype=np.int64).T  # every document has its end
    x = np.rint(127 * x / np.maximum(1e-9, np.linalg.norm(x, axis=0)))
    return np.stack([np.bincount(units, minlength=n), *(np.bincount(units, np.repeat(row, sizes), n) for row in x)], axis=1).astype(np.int64)


def unit_groups(seen: Seen) -> np.ndarray:
    """The group of each unit: clusters of units by the mean sketch of the documents that they occur in."""
    n = len(seen.units)
    total = seen.units.sum()
    if not total:
        return np.zeros(n, np.int64)
    x = (seen.near + 5 * seen.near.sum(axis=0) / total) / (seen.units[:, None] + 5)
    frequent = np.argsort(-seen.units, kind="stable")[:OWN]
    frequent = frequent[seen.units[frequent] > 0]
    away = lambda a, centres: np.stack([((a - c) ** 2).sum(axis=1) for c in centres], axis=1)
    centres = x[frequent[:1]]
    for _ in range(GROUPS - 1):  # the frequent unit farthest from all centres is the next one
        centres = np.concatenate([centres, x[frequent[[away(x[frequent], centres).min(axis=1).argmax()]]]])
    for _ in range(12):
        near = away(x, centres).argmin(axis=1)
        mass = np.bincount(near, seen.units, GROUPS)
        sums = np.stack([np.bincount(near, seen.units * x[:, k], GROUPS) for k in range(x.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(1, mass)[:, None], centres)
    return away(x, centres).argmin(axis=1)


def seen_in(n: int, streams: list[np.ndarray]) -> Seen:
    """What is counted over the streams of a few texts."""
    units = np.concatenate(streams).astype(np.int64) if streams else np.zeros(0, np.int64)
    within = (units[:-1] % 2 == 0) & (units[:-1] != n - 1)
    opens = np.append(True, ~within)[: len(units)] & (units != n - 1)
    inner = np.flatnonzero(within)
    sizes = np.array([len(s) for s in streams], np.int64)
    return Seen(np.bincount(units, minlength=n), np.bincount(units[opens], minlength=n), sketched(n, units, sizes)[:, 1:], np.unique(units[inner] * n + units[inner + 1], return_counts=True))


def blank(ranks: dict[bytes, int]) -> Model:
    """A model that only cuts words in units."""
    n = 2 * (max(ranks.values(), default=0) + 1) + 1
    return Model(ranks, np.zeros(n, np.int64), np.zeros(n, np.float32), np.zeros(n, np.int32), {"embed": np.zeros((1, WIDTH), np.float32), **{k: np.zeros((WIDTH, WIDTH), np.float32) for k in ("wq", "wk", "wv")}, "bias": np.zeros(WINDOW, np.float32)})


def streams_of(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate([*model.units_of(text.split()), np.array([model.end], np.int32)]) for text in texts]


def fit(ranks: dict[bytes, int], texts: list[bytes], steps: int = 500, batch: int = BATCH, rate: float = 0.01, seed: int = 11, seen: Seen | None = None) -> Model:
    """Unit classes and shares from what is counted (over the texts, unless given), then the attention model by Adam on random windows of the texts."""
    rng = np.random.default_rng(seed)
    model = blank(ranks)
    n = len(model.cls)
    model.ready()
    streams = streams_of(model, texts)
    if seen is None:
        seen = seen_in(n, streams)
    counts = seen.units
    order = np.argsort(-counts, kind="stable")
    # the end has its own class; each group of units that occur in the same documents is cut in classes of equal mass
    model.cls[:] = 0
    group = unit_groups(seen)
    each = (CLASSES - 1) // GROUPS
    for g in range(GROUPS):
        mine = order[(group[order] == g) & (order != n - 1)]
        mass = np.cumsum(counts[mine] + 1e-3)
        if len(mine):
            model.cls[mine] = 1 + g * each + np.minimum(each - 1, ((mass - counts[mine] / 2) / mass[-1] * each).astype(np.int64))
    mass = np.bincount(model.cls, counts + 0.05, CLASSES)  # a class without units is never predicted
    model.learn(seen)
    model.totals = np.bincount(model.cls, seen.heads, CLASSES)
    own = order[:OWN]
    model.row = (OWN + model.cls).astype(np.int32)
    model.row[own] = np.arange(len(own))
    rows = OWN + CLASSES + 1
    w = {"embed": rng.normal(0, 0.3, (rows, WIDTH)), **{k: rng.normal(0, 0.3, (WIDTH, WIDTH)) for k in ("wq", "wk", "wv")}, "bias": np.zeros(WINDOW), "out": rng.normal(0, 0.1, (WIDTH, CLASSES)), "out_bias": np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -1e4)}
    model.weights = {k: v.astype(np.float32) for k, v in w.items()}
    model.ready()
    if not streams:
        return model
    units, sizes = np.concatenate(streams), np.array([len(s) for s in streams])
    windows, goals = lessons(model, units, sizes)
    descent = Descent(model.weights)
    for step in range(1, steps + 1):
        some = rng.integers(0, len(windows), batch)
        descent.step(windows[some], goals[some], rate * (1 - 0.9 * step / steps))
    model.weights = descent.w
    model.ready()
    return model


def lessons(model: Model, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, goals) of streams laid end to end, for Descent."""
    laid, windows, places = windows_of(inputs_of(model, units, sizes), sizes, model.begin + 1)
    goals = np.full(len(laid) - CONTEXT, -1, np.int64)
    goals[places - CONTEXT] = model.cls[units]
    return windows, goals.reshape(len(windows), -1)


def cut(model: Model, chunk, fold: int) -> Cut:
    """A chunk's documents in words and units."""
    hashes, lo, hi, first, last = chunk.words(fold=True)
    distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    if len(model.known[0]) > CACHE:
        model.known, model.store = tuple(a[:0] for a in model.known), model.store[:0]
    hashes = model.known[0]
    at = np.searchsorted(hashes, distinct)
    new = distinct != hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else np.ones(len(distinct), bool)
    if new.any():
        a, many = first[where[new]], last[where[new]] - first[where[new]] + 1
        text = chunk.buf[ranges(a, many)]  # each word with what follows it, a space or the like
        text[np.cumsum(many) - 1] = 32
        units, lengths = model.flat_units(np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)[:-1].tobytes())
        begin = len(model.store) + np.cumsum(lengths, dtype=np.int64) - lengths
        model.store = np.concatenate([model.store, units])
        model.known = tuple(np.insert(a, at[new], b) for a, b in zip(model.known, (distinct[new], begin, lengths), strict=True))
    at = np.searchsorted(model.known[0], distinct)
    begin, lengths = model.known[1][at], model.known[2][at]
    held = np.fromiter((crc(i) % fold == 0 for i in chunk.ids.tolist()), bool, len(chunk.ids))
    return Cut(chunk.ids, held, hi - lo, which.astype(np.uint32), distinct, lengths, model.store[ranges(begin, lengths.astype(np.int64))].astype(np.int32, copy=False))


def cut_table(docs: DataFrame, fold: int, shared) -> DataFrame:
    """(part, payload): all documents as packed Cuts, some in each part, so that words are cut in units once. shared has a blank model."""

    def run(batches):
        steady()
        model = shared.value
        model.ready()
        first, parts, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def send():
            return pa.RecordBatch.from_arrays([pa.array([first + parts], pa.int64()), pa.array([held], pa.list_(pa.binary()))], names=["part", "payload"])

        for chunk in chunks(batches, CUT_BYTES):
            held.append(cut(model, chunk, fold).packed())
            size += len(chunk.buf)
            if size >= PART_BYTES:
                yield send()
                parts, held, size = parts + 1, [], 0
        if held:
            yield send()
        held = []
        model.rest()  # the words known so far would stay with the worker
        tidy()

    return docs.mapInArrow(run, "part long, payload array<binary>")


def cuts(batches):
    """The Cuts of each part of a cut_table, with its number."""
    steady()
    for batch in batches:
        for part, blobs in zip(batch.column(0), batch.column(1), strict=True):
            yield part.as_py(), (Cut.read(blob) for blob in blobs.values)
    tidy()


def laid(end: int, docs: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of documents end to end, each closed by the end unit; the documents' sizes; which units are words'; the
    place of each word's units among all words' units, and the place past the last."""
    per_word = docs.lengths[docs.which]
    sums = np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))
    hi = np.cumsum(docs.words)
    sizes = sums[hi] - sums[hi - docs.words] + 1
    ends = np.cumsum(sizes) - 1
    stream = np.empty(int(sizes.sum()), np.int64)
    body = np.ones(len(stream), bool)
    body[ends] = False
    stream[ends] = end
    begin = np.cumsum(docs.lengths, dtype=np.int64) - docs.lengths
    stream[body] = docs.flat[ranges(begin[docs.which], per_word)]
    return stream, sizes, body, sums


def word_logs(model: Model, docs: Cut):
    """Of each word log10 of its units' probability; log10 of what one of its occurrences in training is worth (the
    probability of its first unit's class over that class's training words) over that probability; and what leaving one
    occurrence of its units out of the counts adds to log10 of their probability. Of each document log10 of its end's
    probability."""
    stream, sizes, body, sums = laid(model.end, docs)
    logs = unit_logs(model, stream, sizes)
    ends = logs[np.cumsum(sizes) - 1].astype(np.float64)
    if not len(docs.which):
        return np.zeros(0), np.zeros(0), np.zeros(0), ends
    own = np.add.reduceat(logs[body], sums[:-1]).astype(np.float64)
    opening = np.flatnonzero(body)[sums[:-1]]
    heads = stream[opening]
    worth = logs[opening] - model.inside[heads] - np.log10(np.maximum(1, model.totals[model.cls[heads]]))
    inner = docs.inner()
    word = np.repeat(np.arange(len(docs.lengths)), docs.lengths)
    more, pair_less = model.inner_both(docs.flat[inner - 1], docs.flat[inner])
    less = np.bincount(word, model.unit_less[docs.flat], len(docs.lengths)) + np.bincount(word[inner], pair_less, len(docs.lengths))
    own += np.bincount(word[inner], more, len(docs.lengths))[docs.which]
    return own, worth - own, less[docs.which], ends


def counts_table(table: DataFrame, buckets: int, n: int, end: int) -> DataFrame:
    """(bucket, part, payload, n, v) over a cut_table: for each part and bucket of word hashes how often the part's words of
    that bucket, in the order of their hashes, occur in all training documents. A bucket's row of part -1 has their total
    and number.

    Of n units, the last buckets have what Seen holds: from `buckets` on keys and counts of pairs, and from 2 * buckets on
    units with their row of words by first unit, occurrences and added sketches.
    """
    wide = 2 + SKETCH

    def partial(batches):
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen = np.zeros((n, wide), np.int64)

        def send(rows, part=-1):
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "part", "payload"])

        def dealt():
            u, total = held
            return [(buckets + b, pack(u[at], total[at].astype(np.uint32))) for b, at in by_bucket((mix(u.copy()) % np.uint64(buckets)).astype(np.int64))]

        for part, blobs in cuts(batches):
            words, pairs = [], [held]
            for docs in blobs:
                docs = docs.training()
                c = np.bincount(docs.which, minlength=len(docs.hashes))
                words.append((docs.hashes, c))
                if not len(docs.ids):
                    continue
                begin = np.cumsum(docs.lengths, dtype=np.int64) - docs.lengths
                stream, sizes, _, _ = laid(end, docs)
                seen[:, 0] += np.bincount(docs.flat[begin], c, n).astype(np.int64)
                seen[:, 1:] += sketched(n, stream, sizes)
                inner = docs.inner()
                often = np.repeat(c, docs.lengths)[inner]
                inner, often = inner[often > 0], often[often > 0]
                pairs.append((docs.flat[inner - 1].astype(np.uint64) * np.uint64(n) + docs.flat[inner].astype(np.uint64), often))
            u, inv = np.unique(np.concatenate([a for a, _ in pairs]), return_inverse=True)
            held = u, np.bincount(inv, np.concatenate([b for _, b in pairs]), len(u)).astype(np.int64)
            u, inv = np.unique(np.concatenate([h for h, _ in words]), return_inverse=True)
            total = np.bincount(inv, np.concatenate([c for _, c in words]), len(u)).astype(np.uint32)
            yield send([(b, pack(u[at], total[at])) for b, at in by_bucket((u % np.uint64(buckets)).astype(np.int64))], part)
            if len(held[0]) >= HELD:
                yield send(dealt())
                held = held[0][:0], held[1][:0]
        if len(held[0]):
            yield send(dealt())
        some = np.flatnonzero(seen[:, 1])
        if len(some):
            yield send([(2 * buckets + b, pack(some[at], seen[some[at]])) for b, at in by_bucket(some % buckets)])

    def merge(rows: pa.Table) -> pa.Table:
        bucket, asked = rows["bucket"][0].as_py(), []
        if bucket >= 2 * buckets:
            got = [unpack(b.as_buffer(), np.int64, np.int64) for b in rows["payload"]]
            u, inv = np.unique(np.concatenate([p[0] for p in got]), return_inverse=True)
            total = np.zeros((len(u), wide), np.int64)
            np.add.at(total, inv, np.concatenate([p[1].reshape(-1, wide) for p in got]))
            whole, c = pack(u, total), total[:, 1]
        else:
            got = [unpack(b.as_buffer(), np.uint64, np.uint32) for b in rows["payload"]]
            u, inv = np.unique(np.concatenate([p[0] for p in got]), return_inverse=True)
            c = np.bincount(inv, np.concatenate([p[1] for p in got])).astype(np.int64)
            whole = pack(u, c) if bucket >= buckets else b""
            if bucket < buckets:
                cuts_at = np.cumsum([len(p[0]) for p in got])[:-1]
                asked = [squeezed(pack(x)) for x in np.split(c[inv], cuts_at)]
        parts = [-1, *(rows["part"].to_pylist() if asked else [])]
        zeros = [0] * len(asked)
        return pa.table({"bucket": pa.array([bucket] * len(parts), pa.int32()), "part": pa.array(parts, pa.int64()), "payload": pa.array([whole, *asked], pa.binary()), "n": pa.array([int(c.sum()), *zeros], pa.int64()), "v": pa.array([int((c > 0).sum()), *zeros], pa.int64())})

    return table.mapInArrow(partial, "bucket int, part long, payload binary").groupBy("bucket").applyInArrow(merge, "bucket int, part long, payload binary, n long, v long")


def taught(table: DataFrame, model: Model) -> None:
    """Takes the attention model's weights through all windows of all training documents of a cut_table.

    Every task goes once through its documents, from the same weights, and the tasks' weights are averaged by windows."""
    model.rest()
    shared = table.sparkSession.sparkContext.broadcast(replace(model, ranks={}))

    def run(batches):
        model = shared.value
        model.ready(cutting=False)
        descent, met, rng = Descent(model.weights), 0, np.random.default_rng(3)
        for docs in (docs.training() for _, some in cuts(batches) for docs in some):
            if not len(docs.ids):
                continue
            stream, sizes, _, _ = laid(model.end, docs)
            windows, goals = lessons(model, stream, sizes)
            for some in np.array_split(rng.permutation(len(windows)), -(-len(windows) // BATCH)):
                descent.step(windows[some], goals[some], RATE)
            met += len(windows)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64()), pa.array([pack(*descent.w.values())], pa.binary())], names=["n", "payload"])

    total, sums = 0, {k: np.zeros(w.shape) for k, w in model.weights.items()}
    # as many tasks as cut the texts, though row groups could be dealt to more: the more tasks, the shorter each one's way
    tasks = table.select(F.shiftright("part", 32)).distinct().count()
    for row in table.coalesce(max(1, tasks)).mapInArrow(run, "n long, payload binary").collect():
        total += row[0]
        for a, got in zip(sums.values(), unpack(bytes(row[1]), *[np.float32] * len(sums)), strict=True):
            a += row[0] * got.reshape(a.shape)
    if total:
        model.weights = {k: (a / total).astype(np.float32) for k, a in sums.items()}


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """values by sorted keys, 0 where a key isn't there."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = placed(keys, asked)
    return np.where(keys[at] == asked, values[at], 0)


def placed(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place in sorted keys of each one asked for, or of one beside; in order, which spares the memory."""
    order = np.argsort(asked)
    at = np.empty(len(asked), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, asked[order]), len(keys) - 1)
    return at


def gains(c: np.ndarray, gap: np.ndarray):
    """For each of SHARES log10 of what the mixture makes of units' probability, by words' counts and what one is worth over it."""
    x = np.where(c > 0, 10.0 ** np.minimum(30, gap + np.log10(np.maximum(c, 1))), 0).astype(np.float32)
    for share in SHARES.astype(np.float32):
        yield np.log(1 - share + share * x) * np.float32(1 / math.log(10))


def whole_seen(stats: DataFrame, n: int, buckets: int) -> Seen:
    """What counts_table counted of units, brought to the driver bucket by bucket."""
    keys, counts, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros((n, 2 + SKETCH), np.int64)
    for row in stats.select("bucket", "payload").toLocalIterator():
        k, c = unpack(bytes(row[1]), np.int64, np.int64)
        if row[0] >= 2 * buckets:
            seen[k] = c.reshape(len(k), -1)
            continue
        keys.append(k)
        counts.append(c)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return Seen(seen[:, 1], seen[:, 0], seen[:, 2:], (keys[order], counts[order]))


def score(docs: DataFrame, tokenizer: str = TOKENIZER, fold: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); fold 0 of `fold` is not learned from."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, total = corpus_size(docs)
    training = docs.where(crc_remainder("doc_id", fold) != 0)
    buckets = bucket_count(total // 2, 8 << 20)
    ranks = read_ranks(tokenizer)
    plain = blank(ranks)
    table = checkpointed(cut_table(docs, fold, spark.sparkContext.broadcast(plain)), options=LARGE_ROWS)
    counted = checkpointed(counts_table(table, buckets, len(plain.cls), len(plain.cls) - 1))
    words = counted.where(F.col("bucket") < buckets)
    seen = whole_seen(counted.where(F.col("bucket") >= buckets), len(plain.cls), buckets)
    drawn = SAMPLE_DOCS + CHECK_DOCS
    start = training.where(F.crc32(F.concat(F.lit("lm"), F.col("doc_id").cast("string")).cast("binary")) % max(1, rows // drawn) == 0)
    texts = [(r[1] or "").encode() for r in sorted(start.collect(), key=lambda r: crc(r[0]))][: 2 * drawn]
    fold_case = lambda b: b.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    model = fit(ranks, [fold_case(t) for t in texts], seen=seen)
    taught(table, model)
    found = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = training.count()
    n, v = int(found[0]) + ends, int(found[1]) + (ends > 0)
    bottom = math.log10(n + 0.1 * (v + 1)) if n or v else math.log10(0.1)
    model.rest()
    shared = spark.sparkContext.broadcast(replace(model, ranks={}))
    end_base = math.log10(ends + 0.1) - bottom

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        model.ready(cutting=False)
        ids, sums, left_out = [], [np.zeros((0, 3 + len(SHARES)))], np.zeros(len(SHARES))
        for _, some in cuts(mine.select(["part", "payload"]).to_batches()):
            some = list(some)
            u = np.unique(np.concatenate([docs.hashes for docs in some]))
            counts = np.zeros(len(u), np.int64)
            got = dict(zip(known["bucket"].to_pylist(), known["payload"], strict=True))
            for b, at in by_bucket((u % np.uint64(buckets)).astype(np.int64)):
                counts[at] = unpack(expanded(got[b].as_buffer()), np.int64)[0]
            for docs in some:
                logs, gap, less, end = word_logs(model, docs)
                distinct = counts[np.searchsorted(u, docs.hashes)]
                c, doc = distinct[docs.which], np.repeat(np.arange(len(docs.words)), docs.words)
                learned = ~docs.held[doc]
                left_out += [x.sum(dtype=np.float64) for x in gains(c[learned] - 1, gap[learned] - less[learned])]
                add = lambda x: np.bincount(doc, x, len(docs.words))  # noqa: E731, B023
                plain = add(logs) + end
                base = add((np.log10(distinct + 0.1) - bottom)[docs.which]) + end_base
                ids.append(docs.ids)
                sums.append(np.stack([docs.words + 1.0, add(c > 0) + (ends > 0), base, *(plain + add(x) for x in gains(c, gap))], axis=1))
        # the last row is no document's: what the training words come to
        sums = np.concatenate([*sums, np.concatenate([np.zeros(3), left_out])[None, :]])
        whole = lambda k: pa.array(np.rint(sums[:, k]).astype(np.int64))
        doc_ids = pa.concat_arrays([*map(pa.array, ids), pa.array([None], pa.int64())])
        return pa.table({"doc_id": doc_ids, "n_tokens": whole(0), "n_known": whole(1), "base_score": sums[:, 2], "scores": pa.array(list(sums[:, 3:]), pa.list_(pa.float64()))})

    scored = table.groupBy("part").cogroup(words.where("part >= 0").select("part", "bucket", "payload").groupBy("part"))
    scored = checkpointed(scored.applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, scores array<double>"))
    # the share under which the training words, each left out of its own counts, are likeliest
    share = int(np.argmax(np.sum([np.zeros(len(SHARES)), *(r[0] for r in scored.where("doc_id is null").select("scores").collect())], axis=0)))
    sums = [F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum(F.col("scores")[share]).alias("score")]
    closed = scored.where("doc_id is not null").groupBy("doc_id").agg(*sums)
    return closed.select("doc_id", (crc_remainder("doc_id", fold) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: scores of all whole texts of documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
