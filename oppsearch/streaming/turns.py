"""Per-thread state across turns as a stream; equals the batch operator on the same turns, in
whatever order and micro-batches they arrive.

The turns of a thread are kept in its state under (turn, hash of the text, hash of the row), the
order the batch operator takes them in. Turns that come after all stored ones are answered from the
newest values alone. An earlier one changes the turns behind it: these are replayed and come out
again with a higher ``revision``; ``latest_revisions`` keeps the last of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oppsearch.operators.turns import finish_turns, with_search
from oppsearch.schemas import PROFILE_FIELDS

CARRIED = [*PROFILE_FIELDS, "search_question", "search_route"]


@contextmanager
def state_store_settings(spark: SparkSession, partitions: int | None = None):
    """Settings a stateful query is started with, put back after.

    A checkpoint keeps its number of state partitions for good, so it is chosen here: by default
    one per core of the session, not the width of batch shuffles.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


KEY = T.StructType([T.StructField("turn", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("row", T.StringType())])
#: What tells the put-out rows apart: hash of the turn's row, number of equal rows before, revision.
REVISED = ("row_key", "copy", "revision")
#: Turns that are held at once while a thread is replayed.
REPLAYED = 4096


class CarryForward(StatefulProcessor):
    """Gives each turn the newest values of the turns before it.

    ``columns`` are the turn's own, among them ``CARRIED`` but for the search question: that is the
    turn's question where it has a search route, and is not shuffled and stored a second time. The
    stored row also says how often it has come, because repeated rows are turns of their own.
    """

    def __init__(self, fields: list[T.StructField], ttl_ms: int | None):
        self.fields, self.ttl_ms = fields, ttl_ms
        self.columns = [f.name for f in fields]
        self.at = [self.columns.index("question" if c == "search_question" else c) for c in CARRIED]
        self.searched = CARRIED.index("search_question"), self.columns.index("search_route")

    def init(self, handle: StatefulProcessorHandle) -> None:
        copies = T.StructField("copies", T.LongType())
        self.turns = handle.getMapState("turns", KEY, T.StructType([*self.fields, copies]),
                                        self.ttl_ms)
        newest = [T.StructField(f"last_{f.name}", f.dataType) for f in KEY.fields]
        newest += [T.StructField(c, T.StringType()) for c in CARRIED]
        newest.append(T.StructField("revision", T.LongType()))
        self.newest = handle.getValueState("newest", T.StructType(newest), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values
                        ) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        last = tuple(held[:3]) if held else None
        revision = held[-1] + 1 if held else 0
        carried = list(held[3:-1]) if held else [None] * len(CARRIED)
        arriving, late = {}, None  # late: the first stored or passed place that has to be replayed
        for frame in rows:
            for place, row in self._places(frame):
                if (last is None or place > last) and len(arriving) < REPLAYED:
                    arriving[place] = (row, arriving.get(place, (row, 0))[1] + 1)
                else:
                    self._store(place, row, 1)
                    late = min(late, place) if late else place
        for place, (row, n) in arriving.items():
            if late is None:
                self.turns.updateValue(place, (*row, n))
            else:
                self._store(place, row, n)
        if late is None:
            order = sorted(arriving)
            found = ((place, *arriving[place]) for place in order)
        else:
            late, before = min([late, *arriving]), [(None, None)] * len(CARRIED)
            order = []
            for place, row in self.turns.iterator():
                place = tuple(place)
                if place >= late:
                    order.append(place)
                    continue
                for i, value in enumerate(self._own(row)):
                    if value is not None and (before[i][0] is None or place > before[i][0]):
                        before[i] = (place, value)
            order.sort()
            carried = [value for _, value in before]
            stored = ((place, self.turns.getValue(place)) for place in order)
            found = ((place, tuple(row[:-1]), row[-1]) for place, row in stored)
        out = []
        for place, row, copies in found:
            for n in range(copies):
                out.append((*row, *carried, place[2], n, revision))
                carried = [new if new is not None else old
                           for new, old in zip(self._own(row), carried)]
                if len(out) == REPLAYED:
                    yield self._frame(out)
                    out = []
        newest = max(order[-1], last) if last else order[-1]
        self.newest.update((*newest, *carried, revision))
        if out:
            yield self._frame(out)

    def _own(self, row) -> list:
        """The turn's own values of ``CARRIED``."""
        values = [row[at] for at in self.at]
        question, route = self.searched
        if row[route] is None:
            values[question] = None
        return values

    def _places(self, frame: pd.DataFrame):
        """Each row of a frame with its place in the thread."""
        own = frame[self.columns].astype(object).where(frame[self.columns].notna(), None)
        question, turn = self.columns.index("question"), self.columns.index("turn")
        for row in own.itertuples(index=False, name=None):
            text = "" if row[question] is None else hashlib.md5(row[question].encode()).hexdigest()
            yield (int(row[turn]), text,
                   hashlib.md5(repr(row).encode()).hexdigest()), row

    def _store(self, place, row, copies: int) -> None:
        known = self.turns.getValue(place) if self.turns.containsKey(place) else None
        self.turns.updateValue(place, (*row, copies + (known[-1] if known else 0)))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [*self.columns, *[f"prev_{c}" for c in CARRIED], *REVISED]
        return pd.DataFrame(rows, columns=names)

    def close(self) -> None:
        pass


def read_turn_stream(spark: SparkSession, path: str, schema: T.StructType,
                     bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Turn files as a stream whose micro-batches, and so the rows of any one thread in them, are
    bounded in bytes."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(
        path)


def stream_turns(turns: DataFrame, thread: str = "thread", ttl_ms: int | None = None) -> DataFrame:
    """Streaming turns with own ``question``, ``route`` and profile columns -> state after each, with
    the columns ``REVISED``.

    ``ttl_ms``: forget turns that were not touched for so long. Start it inside
    ``state_store_settings``.
    """
    flat = with_search(turns).select(
        *[c for c in turns.columns], F.col("search.route").alias("search_route"))
    extra = [*[T.StructField(f"prev_{c}", T.StringType()) for c in CARRIED],
             *[T.StructField(n, k) for n, k in zip(REVISED, (T.StringType(), T.LongType(), T.LongType()))]]
    carried = flat.groupBy(thread).transformWithStateInPandas(
        statefulProcessor=CarryForward(flat.schema.fields, ttl_ms),
        outputStructType=T.StructType([*flat.schema.fields, *extra]), outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None")
    packed = carried.select(
        *turns.columns, *REVISED,
        F.when(F.col("search_route").isNotNull(),
               F.struct("question", F.col("search_route").alias("route"))).alias("search"),
        *[F.col(f"prev_{c}") for c in PROFILE_FIELDS],
        F.when(F.col("prev_search_route").isNotNull(),
               F.struct(F.col("prev_search_question").alias("question"),
                        F.col("prev_search_route").alias("route"))).alias("prev_search"))
    return finish_turns(packed)


def latest_revisions(states: DataFrame, thread: str = "thread") -> DataFrame:
    """Of each turn, as the stream has put it out so far, the row of the highest revision."""
    keys = [thread, "turn", *REVISED[:2]]
    others = [c for c in states.columns if c not in (*keys, "revision")]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*others), "revision").alias("last"))
    return last.select(thread, "turn", *[F.col("last")[c].alias(c) for c in others])
