"""Quality classifier: a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of the lines
before and after it; transition weights tie neighbours together. Training lines
carry their document's label. The quality of a document is the mean of its lines'
forward-backward marginals, weighted by line length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import least_hashes, staged
from loamline.llm.minhash_dedup import word_hashes

#: Classes of bytes whose shares are features: upper case, lower case, digits,
#: sentence marks, other ASCII marks, bytes beyond ASCII, spaces, exclamation marks, bars.
_SETS = [range(65, 91), range(97, 123), range(48, 58), b".,;:'?", set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,;:'?!|"), range(128, 256), b" \t", b"!", b"|"]
_CLASS = np.full(256, len(_SETS), dtype=np.uint8)
for _k, _set in enumerate(_SETS):
    _CLASS[list(_set)] = _k
_SPACE, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[list(b'.!?:"')] = True
OWN = len(_SETS) + 6
#: Bytes of a text whose features are made at a time, up to the line's end.
PART = 1 << 19
FEATURES = 3 * OWN + 1


def _own_features(data: bytes, before: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line by itself (lines x OWN) and its length in bytes; ``before`` is the length of the line before the first."""
    raw = np.frombuffer(data + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    lengths = ends - starts
    n = np.maximum(lengths, 1).astype(np.float32)
    line_of = np.repeat(np.arange(len(starts), dtype=np.int32), lengths + 1)
    own = np.zeros((len(starts), OWN), dtype=np.float32)
    kinds = len(_SETS)
    own[:, :kinds] = np.bincount(line_of * np.int32(16) + _CLASS[raw], minlength=16 * len(starts)).reshape(-1, 16)[:, :kinds] / n[:, None]
    # words, and words equal to the one before
    space = _SPACE[raw]
    of_line = line_of[np.flatnonzero(~space & np.r_[True, space[:-1]])]
    count = np.bincount(of_line, minlength=len(starts)).astype(np.float32)
    hashes = word_hashes(data)
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])] if len(hashes) else np.zeros(0, dtype=bool)
    own[:, kinds] = np.bincount(of_line[again], minlength=len(starts)) / np.maximum(count, 1)
    own[:, kinds + 1] = np.minimum((n - own[:, 6] * n) / np.maximum(count, 1), 40) / 10
    own[:, kinds + 2] = np.log1p(count) / 4
    own[:, kinds + 3] = lengths == 0
    own[:, kinds + 4] = _STOP[raw[np.maximum(ends - 1, 0)]] & (lengths > 0)
    own[:, kinds + 5] = (lengths == np.r_[before, lengths[:-1]]) & (lengths > 0)
    return own, lengths


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and lengths in bytes of the text's lines; an empty text is one empty line."""
    own, lengths = _own_features((text or "").encode("utf-8", "surrogatepass"))
    blank = np.zeros((1, OWN), dtype=np.float32)
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank]), np.ones((len(own), 1), dtype=np.float32)]), lengths


@dataclass
class LineCrf:
    """Weights of 'good' over 'bad' per feature, and of staying over changing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """The probability of 'good' of each line, by forward-backward."""
        weights = self.weights / self.scale
        return self._smoothed((features @ weights - self.mean @ weights).tolist())

    def _smoothed(self, emit: list[float]) -> np.ndarray:
        (bb, bg), (gb, gg) = np.exp(self.trans).tolist()
        fwd, bwd = emit[:1], [0.0] * len(emit)
        for e in emit[1:]:
            x = math.exp(max(-500.0, min(500.0, fwd[-1])))
            fwd.append(e + math.log((bg + gg * x) / (bb + gb * x)))
        for t in range(len(emit) - 2, -1, -1):
            x = math.exp(max(-500.0, min(500.0, bwd[t + 1] + emit[t + 1])))
            bwd[t] = math.log((gb + gg * x) / (bb + bg * x))
        return 1 / (1 + np.exp(-np.clip(np.add(fwd, bwd), -50, 50)))

    def score(self, text: str | None) -> float:
        """The mean marginal of the text's lines by length. Features are made for parts of a long text; a line leaves its share in the scores of itself and its neighbours only."""
        weights = self.weights / self.scale
        data = (text or "").encode("utf-8", "surrogatepass")
        shares, lengths, at, before = [], [], 0, -1
        while at <= len(data):
            stop = data.find(b"\n", at + PART)
            stop = len(data) if stop < 0 else stop
            own, n = _own_features(data[at:stop], before)
            shares.append(own @ weights[:-1].reshape(3, OWN).T)
            lengths.append(n)
            at, before = stop + 1, int(n[-1])
        own, after, ahead = np.vstack(shares).T
        emit = own + np.r_[0, after[:-1]] + np.r_[ahead[1:], 0] + weights[-1] - self.mean @ weights
        return float(np.average(self._smoothed(emit.tolist()), weights=np.maximum(np.concatenate(lengths), 1)))


def _chain(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (docs x lines) of 'good' and pair marginals summed over lines (2 x 2) of padded chains.

    ``emit`` is the log weight of good over bad; log weights of bad are 0. Messages
    are kept as log odds, so two states need one number a line.
    """
    docs, lines = emit.shape
    lengths = np.full(docs, lines) if lengths is None else lengths
    (bb, bg), (gb, gg) = trans
    fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0]
    for t in range(1, lines):
        o = fwd[:, t - 1]
        fwd[:, t] = emit[:, t] + np.logaddexp(bg, gg + o) - np.logaddexp(bb, gb + o)
    for t in range(lines - 2, -1, -1):
        o = bwd[:, t + 1] + emit[:, t + 1]
        bwd[:, t] = np.where(t + 1 < lengths, np.logaddexp(gb, gg + o) - np.logaddexp(bb, bg + o), 0.0)
    good = 1 / (1 + np.exp(-np.clip(fwd + bwd, -50, 50)))
    pairs = np.zeros((2, 2))
    if lines > 1:
        left, right = fwd[:, :-1], emit[:, 1:] + bwd[:, 1:]
        logs = np.stack([np.full_like(left, bb), bg + right, gb + left, gg + left + right])
        p = np.exp(logs - logs.max(axis=0))
        p = p / p.sum(axis=0) * (np.arange(1, lines) < lengths[:, None])
        pairs = p.sum(axis=(1, 2)).reshape(2, 2)
    return good, pairs


def fit(docs: list[tuple[np.ndarray, int]], *, rounds: int = 150, ridge: float = 1e-4, rate: float = 0.08) -> LineCrf:
    """Maximum likelihood by Adam; every document counts alike. docs: (features, label)."""
    if not docs or len({y for _, y in docs}) < 2:  # nothing to tell apart: the prior
        prior = 3.0 * (2 * np.mean([y for _, y in docs]) - 1) if docs else 0.0
        return LineCrf(np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES - 1), prior], np.zeros((2, 2)))
    every = np.vstack([x for x, _ in docs])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale < 1e-6, 1.0, scale)
    docs = sorted(docs, key=lambda d: len(d[0]))
    blocks = []
    for at in range(0, len(docs), 256):
        part = docs[at : at + 256]
        lengths = np.array([len(x) for x, _ in part])
        x = np.zeros((len(part), lengths.max(), FEATURES), dtype=np.float32)
        for i, (rows, _) in enumerate(part):
            x[i, : len(rows)] = (rows - mean) / scale
        blocks.append((x, lengths, np.array([y for _, y in part], dtype=float)))
    theta = np.zeros(FEATURES + 4)
    theta[FEATURES:] = [1.0, -1.0, -1.0, 1.0]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = ridge * np.r_[theta[: FEATURES - 1], np.zeros(5)]
        for x, lengths, y in blocks:
            good, pairs = _chain(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), lengths)
            inside = np.arange(x.shape[1]) < lengths[:, None]
            diff = (good - y[:, None]) * inside / lengths[:, None]
            grad[:FEATURES] += np.tensordot(diff, x, axes=([0, 1], [0, 1])) / len(docs)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = ((lengths - 1) * (1 - y)).sum(), ((lengths - 1) * y).sum()
            grad[FEATURES:] += (pairs - seen).ravel() / (len(every) or 1)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[FEATURES:] = np.clip(theta[FEATURES:], -2.0, 2.0)  # lines of one document always agree: keep the chain from freezing
    return LineCrf(mean, scale, theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(line_features(t)[0], y) for t, y in zip(batch["text"], batch["quality"], strict=True)]
        yield pd.DataFrame({"x": [x.astype(np.float32).tobytes() for x, _ in rows], "y": [y for _, y in rows]})


def held_out(doc_id) -> object:
    """Column: crc32 of doc_id as text is divisible by 5 (null: of the empty text, held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 4000, max_bytes: int = 60000, max_lines: int = 200_000) -> LineCrf:
    """Fit on at most ``max_docs`` labelled documents with ``max_lines`` lines in all, those with the least hashes of doc_id.

    Held-out documents, null labels and texts of over ``max_bytes`` bytes are not
    trained on; of several labels of one document the least counts, of several texts
    too. The features of the sample, and nothing else, come to the driver: 184 bytes a
    line, 37 MB at most.
    """
    ids = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    ids = ids.join(docs.filter(F.octet_length("text") <= max_bytes).select("doc_id"), "doc_id", "left_semi")
    ids = least_hashes(staged(ids, "labelled"), max_docs, "doc_id")
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("int").alias("quality"))
    rows = staged(rows.withColumn("lines", F.regexp_count("text", F.lit("\n")) + 1), "training-texts")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = rows.select("doc_id", F.sum("lines").over(upto).alias("so_far")).filter(F.col("so_far") <= max_lines)
    rows = rows.join(few, "doc_id", "left_semi").select("text", "quality")
    got = rows.mapInPandas(_featured, "x binary, y int").toPandas()
    got = got.sort_values(["y", "x"], ignore_index=True)
    return fit([(np.frombuffer(x, dtype=np.float32).reshape(-1, FEATURES), int(y)) for x, y in zip(got["x"], got["y"], strict=True)])


def _scored(model: LineCrf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(scores, pa.float64())], names=[*rest, "score"])

    return run


def score_documents(docs: DataFrame, model: LineCrf, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (1 from ``threshold`` on), one row per input row.

    Whole texts are scored, in parts of bounded memory; null texts score as empty ones, a single empty line.
    A score at the threshold is 1. Other columns are ignored, labels are no input. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def only_good(docs: DataFrame, model: LineCrf, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""

    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= threshold for t in batch.column(text)], pa.bool_()))

    # by place, as names with dots can't be passed on
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def crc_held_out(doc_id: int) -> bool:
    """The same rule in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
