"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

Every byte of a text is a position; the network reads windows of bytes from both ends, gives each position a probability
for each language, and a document's probabilities are the mean over all its positions. Windows start from an empty
state, so memory and time per byte don't depend on the length of a text, and all bytes of a text count.

Training is backpropagation through time with Adam on windows of a bounded sample: ``docs_per_label`` documents of each
label (different rows, the first by a hash), ``windows_per_doc`` windows of each. Labels are few by nature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, over_batches

UNKNOWN = "und"
#: Bound of the training sample.
DOCS_PER_LABEL, WINDOWS_PER_DOC = 400, 4
#: Bytes of a window in training and in prediction.
TRAIN_BYTES, BYTES = 64, 128
HIDDEN, STEPS, BATCH, RATE = 8, 400, 128, 0.03
_LETTER = regex.compile(r"\p{L}")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the bounded activation of this network, a fraction of the cost of tanh in numpy."""
    x /= np.abs(x) + 1
    return x


@dataclass
class Network:
    """Weights by direction: xg (256, 2H) and xn (256, H) for the byte, with the biases; ug (H, 2H) and un (H, H) for the
    state; v (H, labels); and c (labels, 1).

    The gates are update and reset, each (1 + squash) / 2; the reset gate acts on the recurrent part of the candidate,
    whose activation is squash.
    """

    labels: list[str]
    hidden: int = HIDDEN
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        w, small = {"c": np.zeros((len(labels), 1))}, hidden**-0.5
        for d in "fb":
            w |= {
                f"xg{d}": rng.normal(0, 0.5, (256, 2 * hidden)),
                f"xn{d}": rng.normal(0, 0.5, (256, hidden)),
                f"ug{d}": rng.normal(0, small, (hidden, 2 * hidden)),
                f"un{d}": rng.normal(0, small, (hidden, hidden)),
                f"v{d}": rng.normal(0, small, (hidden, len(labels))),
            }
        return cls(labels, hidden, {k: a.astype(np.float32) for k, a in w.items()})

    def _direction(self, data: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Contributions to the logits of every position (time, labels, batch), and what backpropagation needs.

        ``data`` is (time, batch); where ``live`` is 0 (padding at the end) the state stays empty.
        """
        H, (xg, xn, ug, un, v) = self.hidden, (self.w[k + d] for k in ("xg", "xn", "ug", "un", "v"))
        T, B = data.shape
        vt = np.ascontiguousarray(v.T)
        h = np.zeros((B, H), xg.dtype)
        out, trace = np.empty((T, v.shape[1], B), xg.dtype), []
        full = live.all(axis=1)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            gates = h @ ug
            gates += np.take(xg, data[t], axis=0)
            squash(gates)
            gates *= 0.5
            gates += 0.5
            past = h @ un
            n = past * gates[:, H:]
            n += np.take(xn, data[t], axis=0)
            squash(n)
            new = h - n
            new *= gates[:, :H]
            new += n
            if not full[t]:
                new *= live[t][:, None]
            np.matmul(vt, new.T, out=out[t])
            if keep:
                trace.append((t, h, gates, n, past, new))
            h = new
        return out, trace

    def _softmax(self, data: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, dict[str, list]]:
        (z, tf), (zb, tb) = (self._direction(data, live, d, keep) for d in "fb")
        z += zb
        z += self.w["c"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z, {"f": tf, "b": tb}

    def positions(self, data: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (time, labels, batch) of every position."""
        return self._softmax(data, live, False)[0]

    def gradients(self, data: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over live positions and its gradients, by backpropagation through time."""
        H = self.hidden
        dz, traces = self._softmax(data, live, True)
        scale = live / live.sum()
        rows = np.arange(len(y))
        loss = float(-(np.log(dz[:, y, rows] + 1e-9) * scale).sum())
        dz[:, y, rows] -= 1
        dz *= scale[:, None]
        grads = {k: np.zeros_like(a) for k, a in self.w.items()}
        grads["c"] = dz.sum(axis=(0, 2))[:, None]
        for d in "fb":
            ug, un, v = (self.w[k + d] for k in ("ug", "un", "v"))
            dh = np.zeros((data.shape[1], H), ug.dtype)
            to_gates, to_n, seen = [], [], []
            for t, h, gates, n, past, new in reversed(traces[d]):
                grads["v" + d] += (dz[t] @ new).T
                dh = (dh + dz[t].T @ v.T) * live[t][:, None]
                update, reset = gates[:, :H], gates[:, H:]
                dn = dh * (1 - update) * (1 - np.abs(n)) ** 2
                dg = np.concatenate([dh * (h - n), dn * past], axis=1) * 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
                grads["ug" + d] += h.T @ dg
                grads["un" + d] += h.T @ (dn * reset)
                to_gates.append(dg)
                to_n.append(dn)
                seen.append(data[t])
                dh = dh * update + dg @ ug.T + (dn * reset) @ un.T
            hot = np.concatenate(seen)
            order = np.argsort(hot, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(hot[order].astype(int)) != 0])
            for k, parts in (("xg", to_gates), ("xn", to_n)):
                grads[k + d][hot[order][first]] += np.add.reduceat(np.concatenate(parts)[order], first)
        return loss, grads


def train(
    windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE,
    seed: int = 0,
) -> Network:
    """Fit a network to labelled windows of bytes; every label is drawn equally often."""
    known = sorted(set(labels))
    net, rng = Network.fresh(known, hidden, seed), np.random.default_rng(seed)
    data, live = padded(windows, TRAIN_BYTES)
    y = np.array([known.index(x) for x in labels])
    of = [np.flatnonzero(y == k) for k in range(len(known))]
    m = {k: np.zeros_like(a) for k, a in net.w.items()}
    s = {k: np.zeros_like(a) for k, a in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(len(known), size=batch)])
        _, grads = net.gradients(np.ascontiguousarray(data[:, pick]), live[:, pick], y[pick])
        norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            net.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
            net.w[k] = net.w[k].astype(np.float32)
    return net


def padded(windows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of at most ``size`` bytes as (time, batch), and 1 where there is a byte."""
    flat = np.frombuffer(b"".join(w[:size].ljust(size, b"\0") for w in windows), np.uint8).reshape(len(windows), size)
    n = np.array([min(len(w), size) for w in windows])
    return np.ascontiguousarray(flat.T), (np.arange(size)[:, None] < n).astype(np.float32)


def document_probabilities(net: Network, texts: list[bytes], size: int = BYTES, batch: int = 1024) -> np.ndarray:
    """Mean of the position probabilities of each text (documents, labels); all windows of all texts go in batches."""
    windows = [t[at : at + size] for t in texts for at in range(0, len(t), size)]
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // size) for t in texts])
    total = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(windows), batch):
        data, live = padded(windows[at : at + batch], size)
        p = (net.positions(data, live) * live[:, None]).sum(axis=0).T
        np.add.at(total, owner[at : at + batch], p)
    return total / np.maximum([[len(t)] for t in texts], 1)


def sampled_rows(docs: DataFrame, label_col: str, id_col: str, text_col: str, docs_per_label: int) -> DataFrame:
    """(label, text): at most ``docs_per_label`` different rows a label, those with the smallest hashes of id and text.

    Equal rows count once. The distinct rows of a label are counted by a sketch; a threshold on the hash then leaves a few
    times the wanted rows, so that no task orders all rows of a label and texts are never shuffled to be chosen.
    """
    ws = Workspace(docs.sparkSession, "sample")
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.col(label_col).cast("string")).alias("h"),
        F.col(text_col).alias("text"),
    )
    slim = ws.table(rows.select("label", "h"), "rows")
    many = slim.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * docs_per_label) / F.col("n"))
    place = (F.col("h") / F.lit(2.0**64)) + 0.5
    few = slim.join(F.broadcast(many), "label").where(place <= share).select("label", "h").distinct()
    own = Window.partitionBy("label").orderBy("h")
    chosen = few.withColumn("k", F.row_number().over(own)).where(F.col("k") <= docs_per_label).select("h")
    # at most ``docs_per_label`` hashes a label
    return rows.join(F.broadcast(chosen), "h").groupBy("h", "label").agg(F.min("text").alias("text")).select("label", "text")


def training_windows(docs: DataFrame, label_col: str, id_col: str, text_col: str, docs_per_label: int, windows_per_doc: int) -> DataFrame:
    """(label, bytes) of the sample: windows spread evenly over whole texts."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        out: dict[str, list] = {"label": [], "data": []}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode()
            last = max(0, len(data) - TRAIN_BYTES)
            for at in sorted({last * k // max(1, windows_per_doc - 1) for k in range(windows_per_doc)}):
                if data:
                    out["label"].append(label)
                    out["data"].append(data[at : at + TRAIN_BYTES])
        yield out

    chosen = sampled_rows(docs, label_col, id_col, text_col, docs_per_label)
    return over_batches(chosen, run, "label string, data binary")


def fit(
    docs: DataFrame,
    label_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_label: int = DOCS_PER_LABEL,
    windows_per_doc: int = WINDOWS_PER_DOC,
    **training,
) -> Network | None:
    """Train on a bounded sample of ``docs``; None where no row has both text and label."""
    found = training_windows(docs, label_col, id_col, text_col, docs_per_label, windows_per_doc).collect()
    rows = sorted((r["label"], bytes(r["data"])) for r in found)
    return train([w for _, w in rows], [x for x, _ in rows], **training) if rows else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (the pooled probability of the prediction).

    A null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing could be learned.
    Whole texts count; rows that share an id are predicted one by one, a null id stays null, an empty table gives no rows.
    Only the two named columns are read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t if t and _LETTER.search(t) else "" for t in part.column(1).to_pylist()]
            label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if net is not None:
                p = document_probabilities(net, [t.encode() for t in texts])
                for k, t in enumerate(texts):
                    if t:
                        best = int(p[k].argmax())
                        label[k], score[k] = net.labels[best], min(1.0, float(p[k, best]))
            yield {"id": part.column(0), "lang_pred": label, "score": score}

    out = over_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "id long, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, net: Network | None, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language: neither ``und`` nor below ``least_score``; columns as they were."""
    fields = list(docs.schema.fields)
    names = [f"c{k}" for k in range(len(fields))]
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [t if t and _LETTER.search(t) else "" for t in part.column(at).to_pylist()]
            keep = np.zeros(len(texts), bool)
            if net is not None:
                p = document_probabilities(net, [t.encode() for t in texts])
                keep = (p.max(axis=1) >= least_score) & np.array([bool(t) for t in texts])
            part = part.filter(pa.array(keep))
            yield dict(zip(names, part.columns, strict=True))

    return over_batches(docs, run, docs.schema)
