"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows of a fixed number of bytes, both ways, and labels
every position; a document's probabilities are the mean over all its positions, windows end to
end.  It is trained in numpy by backpropagation through time, on windows of a bounded sample of
labelled documents (`train_docs` per language, those first by a hash of their id); weights are
kept in fewer bytes than one batch and go to every task.  Prediction labels the whole of every
text, many windows at a time.

Defined results: null texts and texts without letters get `und` with score 0; rows without label
are not learned from; texts of any length are read whole; with no labelled document at all every
text gets `und`; repeated rows get the same answer each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.textbytes import flat, slices

#: Bytes of a window; the last window of a text is shorter and padded with byte 0.
WINDOW = 64
SYMBOLS = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class ByteNetwork:
    """Two gated recurrent layers, one for each way, and a linear label at every position.

    Gates are update z and reset r; the new state is z * h + (1 - z) * tanh(x + r * (h U)).  The
    input weights are a table with a row for each byte."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        rng, h, k = np.random.default_rng(seed), hidden, len(labels)
        self.labels, self.hidden = labels, hidden
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p["x" + way] = rng.normal(0, 0.3, (SYMBOLS, 3 * h)).astype(np.float32)
            self.p["u" + way] = np.concatenate([np.linalg.qr(rng.normal(size=(h, h)))[0] for _ in range(3)], 1).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["c"] = np.zeros(k, np.float32)

    def states(self, windows: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden state at every position: (time, windows, hidden)."""
        h, table, u = self.hidden, self.p["x" + way], self.p["u" + way]
        n, steps = windows.shape
        out, state, kept = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32), []
        # The halves of z and r make their sigmoids one tanh.
        table, u = table.copy(), u.copy()
        table[:, : 2 * h] *= 0.5
        u[:, : 2 * h] *= 0.5
        column = np.ascontiguousarray(windows.T)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, s = table[column[t]], state @ u
            gates = np.tanh(x[:, : 2 * h] + s[:, : 2 * h])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            before, state = state, new + z * (state - new)
            out[t] = state
            if keep:
                kept.append((t, before, z, r, new, s[:, 2 * h :]))
        return out, kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities at every position: (time, windows, labels)."""
        h = self.hidden
        score = self.states(windows, "f")[0] @ self.p["o"][:h] + self.states(windows, "b")[0] @ self.p["o"][h:] + self.p["c"]
        score -= score.max(-1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(-1, keepdims=True)
        return score

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions that hold a byte, and its gradients through time."""
        h, out, kept = self.hidden, {}, {}
        for way in "fb":
            out[way], kept[way] = self.states(windows, way, True)
        score = out["f"] @ self.p["o"][:h] + out["b"] @ self.p["o"][h:] + self.p["c"]
        score -= score.max(-1, keepdims=True)
        score -= np.log(np.exp(score).sum(-1, keepdims=True))
        real = (windows.T > 0).astype(np.float32)
        weight = real / max(1.0, float(real.sum()))
        rows = np.arange(len(target))
        loss = -float((score[:, rows, target] * weight).sum())
        d = np.exp(score)
        d[:, rows, target] -= 1
        d *= weight[:, :, None]
        g = {"c": d.sum((0, 1)), "o": np.concatenate([np.einsum("tnh,tnk->hk", out[w], d) for w in "fb"])}
        for way in "fb":
            back = d @ (self.p["o"][:h] if way == "f" else self.p["o"][h:]).T
            table, u = np.zeros_like(self.p["x" + way]), np.zeros_like(self.p["u" + way])
            carry = np.zeros((len(target), h), np.float32)
            for t, before, z, r, new, s in reversed(kept[way]):
                ds = back[t] + carry
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (before - new) * z * (1 - z)
                dr = dn * s * r * (1 - r)
                into = np.concatenate([dz, dr, dn], 1)
                np.add.at(table, windows[:, t], into)
                hidden = np.concatenate([dz, dr, dn * r], 1)
                u += before.T @ hidden
                carry = ds * z + hidden @ self.p["u" + way].T
            g["x" + way], g["u" + way] = table, u
        return loss, g

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> float:
        """Adam over random batches; languages count alike."""
        rng, loss = np.random.default_rng(seed), 0.0
        by_label = [np.flatnonzero(target == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(by_label))) for x in by_label if len(x)])
            loss, g = self.gradients(windows[pick], target[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x / max(1.0, size)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                now = rate * (0.1 if step > 0.8 * steps else 1.0)
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of WINDOW bytes, and the text of each row.  Byte 0 within a text reads as
    a space, since 0 stands for padding."""
    size = np.diff(at)
    per = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), per)
    out = np.zeros(len(owner) * WINDOW, np.uint8)
    place = np.repeat(WINDOW * (np.cumsum(per) - per) - at[:-1], size) + np.arange(at[-1])
    out[place] = np.where(data == 0, 32, data)
    return out.reshape(-1, WINDOW), owner


def learned(docs: DataFrame, usable: Column, train_docs: int, hidden: int, steps: int, seed: int) -> ByteNetwork | None:
    """The network, trained on at most `train_docs` documents of each language, of which at most
    the first 4,000 bytes are read."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= train_docs)
    sample = rows.select("lang", F.substring("text", 1, 4000).alias("text"), "nth").orderBy("lang", "nth").toArrow()
    if not len(sample):
        return None
    lang = sample["lang"].to_pylist()
    network = ByteNetwork(sorted(set(lang)), hidden, seed)
    data, at = flat(sample["text"])
    windows, owner = windows_of(data, at)
    target = np.array([network.labels.index(x) for x in lang])[owner]
    full = (windows > 0).sum(1) >= 8
    network.fit(windows[full], target[full], steps, 128, 0.01, seed)
    return network


def identify(
    docs: DataFrame,
    learn_from: Column,
    train_docs: int = 400,
    hidden: int = 12,
    steps: int = 500,
    seed: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; `learn_from` is a condition over doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    network = learned(rows, learn_from, train_docs, hidden, steps, seed)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*network.labels, "und"] if network else ["und"]
        for batch in batches:
            data, at = flat(batch.column("text"))
            total = np.zeros((len(batch), len(names) - 1 or 1))
            for low, high in slices(at, 1_000_000):
                windows, owner = windows_of(data[at[low] : at[high]], at[low : high + 1] - at[low])
                for first in range(0, len(windows) if network else 0, 2048):
                    part = windows[first : first + 2048]
                    found = network.probabilities(part)
                    found *= (part.T > 0)[:, :, None]
                    np.add.at(total, low + owner[first : first + 2048], found.sum(0))
            share = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
            letters = np.array(batch.column("letters").to_pylist(), bool) & (total.sum(1) > 0)
            best = np.where(letters, share.argmax(1), len(names) - 1)
            score = np.where(letters, share.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([names[i] for i in best], pa.string()), pa.array(np.clip(score, 0, 1))],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return rows.select("doc_id", "text", letters).mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")
