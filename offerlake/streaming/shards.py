"""Keyed state that is kept and worked on by shard.

A Python call per key and micro-batch costs about a millisecond, whatever it does. Here keys are dealt to a
fixed number of shards by hash; a shard is one group of ``applyInPandasWithState``, its state the columns of
all keys that are waited for, packed as Arrow, and its rows are worked on as arrays. A shard without keys has
no state. The number of shards belongs to a checkpoint: it may not change between restarts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 512
STATE = "held BINARY"
NONE = -(1 << 63)  # an integer that is not there


def shard_of(key: str, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def pack(columns: dict[str, np.ndarray]) -> bytes:
    return packed(pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if v.dtype == object else None, from_pandas=True) for n, v in columns.items()}))


def packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    return {n: table.column(n).to_numpy(zero_copy_only=False).copy() for n in table.column_names}


def rows_of(pdfs, columns: list[str]) -> pd.DataFrame:
    """The given columns of all frames of a group."""
    frames = [pdf[columns] for pdf in pdfs]
    return pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0] if frames else pd.DataFrame(columns=columns)


def whole(values: pd.Series) -> np.ndarray:
    """Integers that are all there."""
    return values.to_numpy().astype(np.int64) if not values.isna().any() else values.astype("int64").to_numpy()


def numbered(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys, those of the state first and in its order, and the place of each of ``keys`` among them."""
    code, every = pd.factorize(np.concatenate([held, keys]), use_na_sentinel=False)
    every = np.where(pd.isna(every), None, every) if len(every) else np.empty(0, object)
    return every.astype(object), code[len(held):]


def extended(values: np.ndarray, n: int, fill) -> np.ndarray:
    return np.concatenate([values, np.full(n - len(values), fill, values.dtype)])


def firsts(code: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted codes."""
    return np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
