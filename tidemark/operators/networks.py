"""Click models over one-hot categories trained by distributed stochastic gradient descent.

``linear`` is logistic regression by averaged gradient steps; ``wide_deep`` adds embeddings of
all categories and a perceptron over them and the dense inputs; ``deepfm`` adds the pairwise
products of the embeddings to that. Unknown categories have position 0, whose weights stay zero.

Rows are dealt into shards by a hash of their id, once, and sorted by another. In an epoch every
shard starts from the same weights and takes mini-batch steps through its rows, batch after batch
in an order drawn from the epoch; weights are then averaged, those of a category over the shards
that met it. So a shard that runs again on another executor gives the same weights. After each epoch the log loss of the
validation rows is taken; the best epoch's weights are kept, and training stops when ``patience``
epochs bring nothing better. Weights travel to the driver and back once an epoch: their number,
bounded by the vocabularies, is checked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.encode import scaled, scaler
from tidemark.operators.metrics import log_loss_term
from tidemark.schemas import FIRST_INDEX
from tidemark.sources.scratch import keep

#: Shards at least, and rows of a shard, about.
SHARDS, SHARD_ROWS = 8, 1_000_000
#: Numbers of a model that are sent to every task, at most (8 bytes each).
MOST_NUMBERS = 200_000_000
KINDS = ("linear", "wide_deep", "deepfm")


@dataclass
class Settings:
    kind: str = "linear"
    epochs: int = 3
    patience: int = 1
    rate: float = 0.005
    penalty: float = 1e-7
    batch: int = 128
    factors: int = 8
    hidden: tuple[int, ...] = (128, 64)
    shards: int | None = None
    seed: int = 42


@dataclass
class Net:
    """Weights of one model: ``table`` has a row for each position, the linear weight first."""

    settings: Settings
    table: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, settings: Settings, positions: int, categories: int, inputs: int) -> Net:
        rng = np.random.default_rng(settings.seed)
        deep = settings.kind != "linear"
        table = np.zeros((positions, 1 + settings.factors * deep))
        dense = {"bias": np.zeros(1), "linear": np.zeros(inputs)}
        if deep:
            table[1:, 1:] = rng.normal(scale=0.05, size=(positions - 1, settings.factors))
            sizes = [categories * settings.factors + inputs, *settings.hidden, 1]
            for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
                dense[f"weight{i}"], dense[f"shift{i}"] = rng.normal(scale=np.sqrt(2 / a), size=(a, b)), np.zeros(b)
        return cls(settings, table, dense)

    def copy(self) -> Net:
        return Net(self.settings, self.table.copy(), {k: v.copy() for k, v in self.dense.items()})

    @property
    def layers(self) -> int:
        return sum(k.startswith("weight") for k in self.dense)

    def forward(self, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Logits, and what the way back needs."""
        z = self.dense["bias"][0] + self.table[at, 0].sum(1) + x @ self.dense["linear"]
        if self.settings.kind == "linear":
            return z, []
        e = self.table[at, 1:]
        held = [np.hstack([e.reshape(len(at), -1), x])]
        for i in range(self.layers):
            y = held[-1] @ self.dense[f"weight{i}"] + self.dense[f"shift{i}"]
            held.append(np.maximum(y, 0) if i < self.layers - 1 else y)
        z = z + held[-1][:, 0]
        if self.settings.kind == "deepfm":
            z = z + ((e.sum(1) ** 2).sum(1) - (e**2).sum((1, 2))) / 2
        return z, [e, *held]

    def slopes(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Slopes of the mean log loss: of the table's rows at ``at``, and of the dense weights."""
        z, held = self.forward(at, x)
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        rows = np.zeros((*at.shape, self.table.shape[1]))
        rows[:, :, 0] = g[:, None]
        dense = {"bias": np.array([g.sum()]), "linear": g @ x}
        if held:
            e, *held = held
            back = g[:, None]
            for i in reversed(range(self.layers)):
                dense[f"weight{i}"], dense[f"shift{i}"] = held[i].T @ back, back.sum(0)
                back = back @ self.dense[f"weight{i}"].T
                if i:
                    back = back * (held[i] > 0)
            rows[:, :, 1:] = back[:, : e.shape[1] * e.shape[2]].reshape(e.shape)
            if self.settings.kind == "deepfm":
                rows[:, :, 1:] += g[:, None, None] * (e.sum(1)[:, None, :] - e)
        rows[at == 0] = 0.0
        return rows, dense

    def walk(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[Net, np.ndarray]:
        """The net after one pass through parts of rows in their order, and the positions met:
        for ``linear`` the mean of the weights after each step, for the others the last, with
        steps scaled by past slopes."""
        net, s = self.copy(), self.settings
        late, seen, past = np.zeros_like(net.table), None, {k: np.full_like(v, 1e-8) for k, v in net.dense.items()}
        mean = {k: np.zeros_like(v) for k, v in net.dense.items()}
        steps = 0
        if s.kind != "linear":
            seen = np.full_like(net.table, 1e-8)
        met = np.zeros(len(net.table), dtype=bool)
        for at, x, y in (tuple(c[i : i + s.batch] for c in part) for part in parts for i in range(0, len(part[2]), s.batch)):
            rows, dense = net.slopes(at, x, y)
            n = len(y)
            ids, where = np.unique(at, return_inverse=True)
            met[ids] = True
            total = np.zeros((len(ids), net.table.shape[1]))
            np.add.at(total, where.ravel(), rows.reshape(-1, net.table.shape[1]))
            if s.kind == "linear":  # a step for each row of the batch, taken together
                move = -s.rate * (n * total + n * s.penalty * net.table[ids])
                move[ids == 0] = 0.0
                net.table[ids] += move
                late[ids] += steps * move  # the mean is the last value less the moves it came too late for
                for k, v in dense.items():
                    net.dense[k] -= s.rate * n * v
                    mean[k] += net.dense[k]
            else:
                total += s.penalty * net.table[ids] * (ids != 0)[:, None]
                seen[ids] += total**2
                net.table[ids] -= s.rate * total / np.sqrt(seen[ids])
                for k, v in dense.items():
                    past[k] += v**2
                    net.dense[k] -= s.rate * v / np.sqrt(past[k])
            steps += 1
        if s.kind == "linear" and steps:
            net.table -= late / steps
            net.dense = {k: v / steps for k, v in mean.items()}
        met[0] = False
        return net, np.flatnonzero(met)


def positions_of(sizes: dict[str, int]) -> tuple[dict[str, int], int]:
    """Offset of each category's known values among the positions, and the number of these."""
    offsets, at = {}, 1
    for f, n in sizes.items():
        offsets[f] = at
        at += n - FIRST_INDEX
    return offsets, at


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    matrix = lambda c, t: c.flatten().to_numpy(zero_copy_only=False).astype(t).reshape(len(c), -1)
    for b in batches:
        if b.num_rows:
            yield b, matrix(b.column("at"), np.int64), matrix(b.column("x"), np.float64)


def _epoch(dealt: DataFrame, net: Net, epoch: int) -> Net:
    """Weights after every shard's walk, averaged."""
    s = net.settings
    sent = dealt.sparkSession.sparkContext.broadcast(net)  # MOST_NUMBERS at most

    def parts(batches):
        rng = np.random.default_rng((s.seed, epoch))
        for b, at, x in _batches(batches):
            turn = rng.permutation(len(at))
            yield at[turn], x[turn], b.column("clk").to_numpy().astype(np.float64)[turn]

    def walk(batches):
        before = sent.value
        after, met = before.walk(parts(batches))
        moved = (after.table - before.table)[met]
        values = [*moved, *[v.ravel() for v in after.dense.values()]]
        names = [""] * len(met) + list(after.dense)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(np.r_[met, np.full(len(after.dense), -1)], pa.int64()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], names=["name", "at", "v"]
        )

    walked = dealt.mapInArrow(walk, "name string, at long, v array<double>")
    listed = walked.groupBy("name", "at").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # as many as shards
    first = F.col("vs")[0]
    mean = F.transform(first, lambda _, i: F.aggregate("vs", F.lit(0.0), lambda a, v: a + v[i]) / F.size("vs"))
    found = listed.select("name", "at", mean.alias("v")).toArrow()
    out = net.copy()
    for name, at, v in zip(*(found.column(c).to_pylist() for c in ("name", "at", "v"))):
        if at >= 0:
            out.table[at] += v
        else:
            out.dense[name] = np.array(v).reshape(out.dense[name].shape)
    sent.unpersist()
    return out


def _scored(rows: DataFrame, net: Net) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        for b, at, x in _batches(batches):
            z, _ = sent.value.forward(at, x)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("impression_id"), b.column("clk"), b.column("split"), pa.array(p.astype(np.float32))], names=["impression_id", "clk", "split", "prediction"])

    return rows.mapInArrow(score, "impression_id long, clk int, split string, prediction float")


def train_network(train: DataFrame, validation: DataFrame, columns: dict[str, list[str]], sizes: dict[str, int], settings: Settings) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``prediction`` to model inputs, from the best epoch on ``validation``.

    ``sizes`` are vocabulary sizes with the two reserved indices, of every category to be used;
    numerics are scaled by what ``train`` holds; a null index is unknown and a null number zero.
    The function has ``history``, the validation log loss of each epoch, their ``seconds``, and ``net``.
    """
    if settings.kind not in KINDS:
        raise ValueError(f"no model {settings.kind}")
    names = [c for c in columns["categorical"] if c in sizes]
    dense = [*columns["binary"], *columns["numeric"]]
    offsets, many = positions_of({c: sizes[c] for c in names})
    if many * (1 + settings.factors * (settings.kind != "linear")) > MOST_NUMBERS:
        raise ValueError(f"{many} positions are more than tasks are sent; leave categories out")
    stats = scaler(train, columns["numeric"])

    def ready(t: DataFrame) -> DataFrame:
        known = lambda c: (F.col(c) >= FIRST_INDEX) & (F.col(c) < sizes[c])
        at = F.array(*[F.when(known(c), F.col(c) - FIRST_INDEX + offsets[c]).otherwise(F.lit(0)).cast("long") for c in names])
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in dense])
        return scaled(t, stats).select("impression_id", F.col("clk").cast("int").alias("clk"), "split", at.alias("at"), x.alias("x"))

    rows, held = keep(ready(train), "train"), keep(ready(validation), "validation")
    net = Net.start(settings, many, len(names), len(dense))
    shards = settings.shards or max(SHARDS, -(-rows.count() // SHARD_ROWS))
    dealt = rows.repartition(shards, "impression_id").sortWithinPartitions(F.xxhash64("impression_id", F.lit(settings.seed)), "impression_id").persist()
    best, history, seconds = None, [], []
    for epoch in range(settings.epochs):
        begin = time.perf_counter()
        net = _epoch(dealt, net, epoch)
        seconds.append(time.perf_counter() - begin)
        loss = _scored(held, net).agg(F.avg(log_loss_term(F.col("clk"), F.col("prediction")))).first()[0]
        history.append(loss)
        if best is None or loss is not None and loss < min(x for x in history[:-1] if x is not None):
            best = net
        elif epoch - int(np.argmin(history)) >= settings.patience:
            break
    dealt.unpersist()

    def apply(t: DataFrame) -> DataFrame:
        return _scored(ready(t), best)

    apply.net, apply.history, apply.seconds = best, history, seconds
    return apply
