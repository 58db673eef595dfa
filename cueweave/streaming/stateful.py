"""Stateful variants on Structured Streaming: islands of a track and decoding of packets.

Rows of a key must arrive in order, as a stream's packets do; what arrives
after its island closed opens another one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeline import ISLAND_GAP_PTS
from ..sources.sup import DISPLAY_SETS, END, StreamDecoder


def stream_islands(rows: DataFrame, keys: Sequence[str], same: str, start: str, end: str, max_gap: int = ISLAND_GAP_PTS, idle_ms: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Islands of each track, given out when the next one opens.

    State is one open island per track; null values are equal to each other,
    rows without start or end are left out. With ``idle_ms`` an island is also given
    out when its track was silent for so long in processing time. ``order``
    sorts the rows of each batch. ``open_islands`` gives those still open when the
    input has ended.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{same}` {types[same]}, `{start}` bigint, `{end}` bigint, rows bigint"
    state_ddl = f"same {types[same]}, start bigint, end bigint, rows bigint"
    columns = [*keys, same, start, end, "rows"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done = [(*key, *state.get)]
            state.remove()
            yield pd.DataFrame(done, columns=columns)
            return
        held = list(state.get) if state.exists else None
        done = []
        for part in [pd.concat(list(parts)).sort_values(list(order), kind="stable")] if order else parts:
            part = part.dropna(subset=[start, end])
            for value, a, b in zip(part[same].astype(object).where(part[same].notna(), None), part[start], part[end]):
                if held is not None and held[0] == value and max(0, a - held[2]) <= max_gap:
                    held[2], held[3] = max(held[2], int(b)), held[3] + 1
                    continue
                if held is not None:
                    done.append((*key, *held))
                held = [value, int(a), int(b), 1]
        if held is not None:
            state.update(tuple(held))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if done:
            yield pd.DataFrame(done, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, ddl, state_ddl, "append", timeout)


def open_islands(spark: SparkSession, checkpoint: str, keys: Sequence[str], same: str, start: str, end: str) -> DataFrame:
    """The island of each track that a stopped query of ``stream_islands`` left open, read from its state."""
    state = spark.read.format("statestore").load(checkpoint)
    held = [F.col(f"value.groupState.{c}").alias(n) for c, n in (("same", same), ("start", start), ("end", end), ("rows", "rows"))]
    return state.select(*[F.col("key").getField(k).alias(k) for k in keys], *held)


def stream_display_sets(packets: DataFrame) -> DataFrame:
    """Display sets of streams of packets; a set is given out with its end packet.

    State is the decoder of each stream (palettes, objects, windows) and the
    packets of its open set.
    """
    columns = ["source_id", "raw_index", "pts", "composition_state", "has_composition", "complete", "windows", "surface"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder, held = pickle.loads(state.get[0]) if state.exists else (StreamDecoder(), [])
        rows = []
        whole = pd.concat(list(parts)).sort_values(["raw_index", "packet_no"], kind="stable")
        for raw, pts, kind, payload in zip(whole["raw_index"], whole["pts"], whole["segment_type"], whole["payload"]):
            held.append((int(pts), int(kind), bytes(payload)))
            if kind == END:
                rows.append({"source_id": key[0], "raw_index": int(raw)} | decoder.display_set(held))
                held = []
        decoder._kept.clear()
        state.update((pickle.dumps((decoder, held)),))
        if rows:
            frame = pd.DataFrame(rows, columns=columns)
            for c in ("raw_index", "pts", "composition_state"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return packets.groupBy("source_id").applyInPandasWithState(run, DISPLAY_SETS, "state binary", "append", GroupStateTimeout.NoTimeout)
