"""Token ids of a whole corpus by a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the rank file is, on the driver and on every executor.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_SLICE = 1 << 20  # tokens of one Arrow batch that goes back, about


def id_lists(texts: pa.Array, path: str) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end, lists of ids) of consecutive slices of the texts, each of about a million tokens at most."""
    from gaugewell.llm.bpe import vocabulary

    packed = vocabulary(path).packed
    first, sizes, parts, total = 0, [0], [], 0
    for k in range(len(texts)):
        text = texts[k].as_py()
        got = packed(text) if text else b""
        parts.append(got)
        total += len(got) // 4
        sizes.append(total)
        if total >= _SLICE:
            yield first, k + 1, _lists(sizes, parts)
            first, sizes, parts, total = k + 1, [0], [], 0
    if first < len(texts):
        yield first, len(texts), _lists(sizes, parts)


def _lists(sizes: list[int], parts: list[bytes]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.array(sizes, "<i4")), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids) of every row: the ids of the text, without special tokens.

    Null and empty texts give an empty list; what looks like a special token is ordinary text.  Repeated rows and null
    ids stay as they are, one row out for each row in; other columns are not read, whatever their names.  Texts of any
    length are encoded whole.  The plan is a scan and one Arrow pass, without a shuffle.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lists in id_lists(batch.column(1), path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K, parts: int = 2) -> DataFrame:
    """(id, same, n): whether a text that is put together by appends and edits has the ids of the whole, and their number.

    A text is appended in ``parts`` parts to one ``Encoding``; then a stretch in its middle is replaced by its reverse and
    put back.  Null and empty texts have no ids.  Texts are handled whole; the work is about that of encoding them twice.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("same", T.BooleanType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gaugewell.llm.bpe import Encoding, vocabulary

        v = vocabulary(path)
        for batch in batches:
            same, n = [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                e, step = Encoding(v), max(1, -(-len(text) // parts))
                for at in range(0, len(text), step):
                    e.append(text[at : at + step])
                middle, few = len(text) // 2, min(20, len(text) // 4)
                if few:
                    e.edit(middle, few, text[middle : middle + few][::-1])
                    e.edit(middle, few, text[middle : middle + few])
                ids = e.ids()
                same.append(ids == v.encode(text).tolist())
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_()), pa.array(n, pa.int64())], names=schema.fieldNames())

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
