"""Ordered evidence in keyed state: open cells of time per key, closed by timers, reopened by late rows.

The evidence of a key is cut into cells of time. A (key, cell) is one state key: it keeps its rows in event order until
the watermark has passed the end of the cell; then a timer folds them for the last time and the state is gone. So state
holds the open cells only, and a key with very many rows is as many state keys as it has cells. The rows of a cell are kept
as Arrow tables of up to 65,536 rows a state value and are sorted and composed as columns: no row passes the state by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

LEVELS = 5
PIECE_ROWS = 65_536
COLUMNS = ["at", "id", "effect"]
PIECE = "piece binary"


def coded(effect: str) -> Column:
    """An effect on the levels, an array of their new places, as one number."""
    return sum((F.get(effect, F.lit(i)) * LEVELS**i for i in range(LEVELS)), F.lit(0)).cast("int")


def composed(codes: np.ndarray) -> list[int]:
    """The effects of the codes in order, as one effect on the levels: neighbours are composed, then pairs of them, and so on."""
    effects = codes[:, None].astype(np.int64) // LEVELS ** np.arange(LEVELS) % LEVELS
    while len(effects) > 1:
        if len(effects) % 2:
            effects = np.concatenate([effects, [np.arange(LEVELS)]])
        effects = np.take_along_axis(effects[1::2], effects[::2], axis=1)
    return effects[0].tolist() if len(effects) else list(range(LEVELS))


def packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    out = []
    for i in range(0, len(rows), PIECE_ROWS):
        part, sink = pa.Table.from_pandas(rows[i : i + PIECE_ROWS], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_table(part)
        out.append((sink.getvalue().to_pybytes(),))
    return out


class Cell(StatefulProcessor):
    """Rows of one (key, cell). A row that was seen comes again without effect; ``reopen`` rows are the whole cell as it is stored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", PIECE)
        self.due = handle.getValueState("due", "due bigint")

    def held(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(bytes(p[0])).read_pandas() for p in self.pieces.get()] if self.pieces.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.held()
        before, due = sum(map(len, held)), 0
        for frame in rows:
            if len(frame):
                held.append(frame[COLUMNS])
                due = max(due, int(frame["due_ms"].max()))
        ordered = pd.concat(held, ignore_index=True).drop_duplicates(["at", "id"], keep="last").sort_values(["at", "id"])
        self.pieces.put(packed(ordered))
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or due > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))
        if len(ordered) != before:
            yield self.result(key, ordered, "open")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.held()
        ordered = pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in COLUMNS})
        self.pieces.clear()
        self.due.clear()
        yield self.result(key, ordered, "closed")

    def result(self, key: tuple, ordered: pd.DataFrame, state: str) -> pd.DataFrame:
        effect = composed(ordered["effect"].to_numpy())
        return pd.DataFrame({**{f"k{i}": [k] for i, k in enumerate(key)}, "effect": [effect], "n": [len(ordered)], "state": [state]})

    def close(self) -> None:
        pass


def cell_effects(rows: DataFrame, keys: Sequence[str], cell: str, due: str, delay: str) -> DataFrame:
    """(keys, cell, effect, n, state) of every cell that changes, from a stream of (keys, cell, at, id, effect, due_ms, due).

    ``due`` is the end of the cell as timestamp, and the event time; rows of closed cells must not be among the input.
    """
    by = [*keys, cell]
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType()
    for i, k in enumerate(by):
        out = out.add(f"k{i}", types[k])
    out = out.add("effect", ArrayType(IntegerType())).add("n", LongType()).add("state", StringType())
    held = rows.withColumn("effect", coded("effect")).withWatermark(due, delay).groupBy(*by).transformWithStateInPandas(Cell(), out, "Update", "EventTime")
    return held.toDF(*by, "effect", "n", "state")
