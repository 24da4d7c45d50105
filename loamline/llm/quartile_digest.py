"""Document fingerprints: quartile bucket digests.

Every triplet of consecutive UTF-8 bytes is hashed into one of 256 buckets. The
digest writes two bits for each bucket, the quartile of its count among the counts of
all buckets, after a byte for the length on a logarithmic scale. Digests of
different documents compare by the quartile steps between them, bounded so that
unrelated texts come near 0 and equal ones to 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import staged

BUCKETS = 256
#: Cost of a bucket by quartile steps; the mean over independent quartiles is 1.625.
STEP = np.array([0, 1, 2, 6], dtype=np.int64)
WORST = 1.625 * BUCKETS
#: A step of the length byte beyond the first costs this much.
LENGTH_STEP = 12


def digest(text: str) -> np.ndarray:
    """The length byte and the quartile of each bucket, as BUCKETS + 1 small integers."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(raw) - 2), 1 << 20):  # bounded memory for long texts
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        triplet = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        counts += np.bincount((triplet * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)
    ordered = np.sort(counts)
    out = np.empty(BUCKETS + 1, dtype=np.uint8)
    out[0] = min(255, int(math.log(len(raw) + 1) / math.log(1.2)))
    out[1:] = sum((counts > ordered[BUCKETS * q // 4 - 1]).astype(np.uint8) for q in (1, 2, 3))
    return out


def encode(d: np.ndarray) -> str:
    """Hexadecimal: the length byte, then four buckets a byte."""
    quads = d[1:].reshape(-1, 4)
    return (bytes([d[0]]) + (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes()).hex()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), dtype=np.uint8)
    return np.concatenate([raw[:1], np.stack([raw[1:] >> k & 3 for k in (6, 4, 2, 0)], axis=1).ravel()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    length = abs(int(a[0]) - int(b[0]))
    cost = int(STEP[np.abs(a[1:].astype(np.int64) - b[1:])].sum()) + (length if length <= 1 else LENGTH_STEP * (length - 1))
    return max(0.0, 1.0 - cost / WORST)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Row:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.digest = digest(self.text)

    def against(self, following: _Row) -> tuple:
        new = edited(self.text, following.text)
        own = digest(new)
        return self.doc_id, len(self.text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(self.digest), encode(own), likeness(self.digest, own), likeness(self.digest, following.digest)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition; its first and last come with their texts, the last without a result."""
    names, before, first, part, kind = [*_NAMES, "part", "first", "last", "text", "last_text"], None, True, TaskContext.get().partitionId(), None
    for batch in batches:
        kind, out = batch.schema.field("doc_id").type, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            row = _Row(doc_id, text.as_py())
            if before is not None:
                out.append((*before.against(row), part, first, False, before.text if first else None, None))
                first = False
            before = row
        yield _batch(out, kind, names)
    if before is not None:
        yield _batch([(before.doc_id, None, None, None, None, None, None, part, first, True, before.text if first else None, before.text)], kind, names)


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("last_text").to_pylist(), batch.column("next_text").to_pylist(), strict=True)
        yield _batch([_Row(i, t).against(_Row(None, n)) for i, t, n in rows], batch.schema.field("doc_id").type, _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text.

    ``docs`` needs doc_id and text; other columns are ignored. Each text's last
    floor(n / 2) code points are replaced by the first as many of the next
    document in descending order of doc_id (nulls last, equal ids by text; the first
    follows the last). Returns, per row, doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.

    Null texts are empty; empty ones, and those of under three bytes, have empty
    buckets. A single document follows itself; an empty table gives no rows. Rows
    are dealt by ranges of doc_id; only the first and last of each range meet in
    a join afterwards. Rows of one doc_id fall into one range, so an id should not
    repeat millions of times; repeated rows follow each other. Long texts are
    digested in parts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    result = _RESULT.format(kind=kind)
    dealt = staged(sorted_docs.mapInArrow(_in_order, result + ", part int, first boolean, last boolean, text string, last_text string"), "fingerprints")
    # which range comes after each; the last is followed by the first
    heads = dealt.filter("first").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = dealt.filter("first").select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(whole)).alias("next")).join(heads, "next").drop("next")
    ends = dealt.filter("last").select("doc_id", "last_text", "part").join(after, "part").mapInArrow(_at_ends, result)
    return dealt.filter("not last").select(*_NAMES).unionByName(ends)
