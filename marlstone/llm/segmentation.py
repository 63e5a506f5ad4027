"""SentencePiece encoding by Gumbel top-k: k distinct sampled segmentations of each text, and back.

The search is in lattice.py. Rows are independent, so this is one pass without a shuffle; the
model's bytes go to the executors with the task, which need no file of their own. Noise is seeded
by the row's id, so reruns, other batches and other machines give the same samples.

Defined cases: a null or empty text has one segmentation without pieces, of log probability 0 and
inclusion 1; a text with fewer than k segmentations gives all of them; repeated rows are sampled
alike; null ids share one seed; a text's own U+2581 decodes as a space, so its round_trip
is false, and all else round-trips; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, values
from .lattice import ALPHA, Vocabulary, sample_without_replacement

#: Segmentations of each text.
SAMPLES = 2
#: Characters that are searched together; a longer text is searched alone.
CHUNK_CHARS = 500_000
COLUMNS = ("id", "sample", "n_pieces", "log_prob", "value", "inclusion", "round_trip")
_vocabularies: dict[tuple, Vocabulary] = {}


def default_model() -> str:
    """Where the public tokenizers' package keeps its SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model: bytes, alpha: float = ALPHA) -> Vocabulary:
    """Built once a process."""
    key = (hashlib.sha256(model).digest(), alpha)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(model, alpha)
    return _vocabularies[key]


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += len(row[2])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def sample_segmentations(
    docs: DataFrame, model_path: str | None = None, k: int = SAMPLES, seed: int = 0, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_sha256: bool = False
) -> DataFrame:
    """Up to k rows per input row: id, sample (from 1), n_pieces, log_prob, value (with its noise),
    inclusion, round_trip (whether decoding gives the text back), ids if with_ids, and ids_sha256 (of
    little-endian 32-bit ids) if with_sha256 or not with_ids."""
    with_sha256 = with_sha256 or not with_ids
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    names = [*COLUMNS, *["ids"] * with_ids, *["ids_sha256"] * with_sha256]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        rows = (x for b in it for x in zip(*map(values, b.columns)))
        for chunk in _chunks(rows):
            keys = np.array([x[1] for x in chunk], dtype=np.int64).view(np.uint64)
            out: list[tuple] = []
            encoded: list[np.ndarray] = []
            for (id_, _, text), samples in zip(chunk, sample_without_replacement(vocab, [x[2] for x in chunk], keys, k)):
                whole = text.encode()
                for n, s in enumerate(samples):
                    ids = s.ids.astype("<i4", copy=False)
                    same = vocab.decode(ids) == whole
                    out.append((id_, n + 1, len(ids), s.log_prob, s.value, s.inclusion, same, hashlib.sha256(ids).hexdigest() if with_sha256 else None))
                    if with_ids:
                        encoded.append(ids)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
            made = dict(zip((*COLUMNS, "ids_sha256"), (pa.array(list(c), t) for c, t in zip(zip(*out), kinds))))
            if with_ids:
                ends = np.cumsum([0] + [len(x) for x in encoded], dtype=np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(encoded)))
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names)
        give_back()

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = "id long, sample int, n_pieces long, log_prob double, value double, inclusion double, round_trip boolean"
    schema += ", ids array<int>" * with_ids + ", ids_sha256 string" * with_sha256
    return rows.mapInArrow(batches, schema).toDF(id_col, *names[1:])
