"""Substring deduplication.

`by_suffixes` works on bytes: suffixes at anchors are range-partitioned by their leading
bytes, sorted, and compared with their neighbours, also across boundaries (see `windows`, `suffixes`); what a
string of `BYTES.window` bytes covers that also starts anywhere else goes.

`by_parsing` works on words: what documents have around an anchor is factored against what documents of
smaller id have there (see `parsing`); words inside windows that one of these has go.

Null texts are empty. In by_suffixes rows that share an id, or have none, are copies of each other like any
others. In by_parsing an id of any type that can be ordered will do; rows that share an id are not before each other,
and a row without an id is neither before nor after any other: it loses nothing and is no witness.
Other columns stay as they are, but for one of the name `out`, which is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import arrays as A
from . import parsing, suffixes, windows


def _spans(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    x = column[row].values
    if x is None or not len(x):
        z = np.zeros(0, np.int64)
        return z, z
    return x.field("start").to_numpy().astype(np.int64), x.field("end").to_numpy().astype(np.int64)


def kept_bytes():
    @arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, removed, n_spans, kept = [], [], [], []
        data, offsets = A.flat(text)
        for r in range(len(text)):
            own = data[offsets[r] : offsets[r + 1]]
            s, e = _spans(spans, r)
            gone = A.covered(len(own), np.minimum(s, len(own)), np.minimum(e, len(own))) if len(s) else np.zeros(len(own), bool)
            sizes.append(len(own))
            removed.append(int(gone.sum()))
            n_spans.append(len(A.runs(gone)[0]))
            kept.append(own[~gone].tobytes())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def by_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "cut") -> DataFrame:
    """docs with the column `out`: n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    found = windows.repeated(docs, windows.BYTES, id_col, text_col, suffixes.shared, any_other=True)
    joined = windows.with_spans(docs, found, id_col, text_col)
    return joined.withColumn(out, kept_bytes()(F.col(text_col), F.col(windows.SPANS))).drop(windows.SPANS)


def kept_words():
    @arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        n_words, removed, kept = [], [], []
        for lo, hi in A.slices(text):
            data, offsets = A.flat(text.slice(lo, hi - lo))
            starts, ends, first = A.words(data, offsets)
            for r in range(hi - lo):
                a, b = first[r], first[r + 1]
                s, e = _spans(spans, lo + r)
                stay = ~A.covered(b - a, np.minimum(s, b - a), np.minimum(e, b - a)) if len(s) else np.ones(b - a, bool)
                own = data[offsets[r] : offsets[r + 1]].tobytes()
                at = offsets[r]
                n_words.append(int(b - a))
                removed.append(int((~stay).sum()))
                kept.append(b" ".join([own[x:y] for x, y in zip((starts[a:b][stay] - at).tolist(), (ends[a:b][stay] - at).tolist(), strict=True)]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    return cut


def by_parsing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "cut") -> DataFrame:
    """docs with the column `out`: n_words, n_removed and kept (words joined by one space)."""
    found = windows.repeated(docs, windows.WORDS, id_col, text_col, parsing.factored, any_other=False)
    joined = windows.with_spans(docs, found, id_col, text_col)
    return joined.withColumn(out, kept_words()(F.col(text_col), F.col(windows.SPANS))).drop(windows.SPANS)
