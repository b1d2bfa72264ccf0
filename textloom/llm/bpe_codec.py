"""BPE encoding and decoding of whole documents (the encoder itself is in ``bpe``)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.bpe import OffsetDecoder, vocabulary, word_tools
from textloom.llm.common import arrow_map, over_slices


def encode(text: str, path: str) -> list[int]:
    split, _, texts = word_tools(path)
    return [int(i) for w in split(text) for i in texts[w][0].split(" ")]


def decode(ids: list[int], path: str) -> str:
    """Token texts joined by spaces, as the library does for a vocabulary without a decoder."""
    return " ".join(OffsetDecoder(vocabulary(path))(ids))


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids (array of int) of every row; a null text has none."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [encode(t or "", path) for t in batch.column(1).to_pylist()]]

    return arrow_map(docs.select(key, text), over_slices(run, schema, text), f"`{key}` long, ids array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of their decoded text for every row, read whole.

    Words repeat far more than texts do, so ids and decoded text are kept by word; both
    join by single spaces, and joining the words' parts gives the document's.  Null and
    empty texts have no ids and decode to the empty text.  Repeated rows stay repeated, an
    empty table gives an empty one, other columns are not read.
    """
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batch: pa.RecordBatch) -> list:
        split, _, texts = word_tools(path)
        n, ids, decoded = [], [], []
        for t in batch.column(1).to_pylist():
            found = list(map(texts.__getitem__, split(t or "")))
            a, b, c = zip(*found) if found else ((), (), ())
            n.append(sum(c))
            ids.append(hashlib.sha256(" ".join(a).encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join(b).encode()).hexdigest())
        return [batch.column(0), n, ids, decoded]

    out = f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(key, text), over_slices(run, schema, text), out)
