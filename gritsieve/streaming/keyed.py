"""Detectors over keyed rows in order: one step function for the static and the stateful form.

A step takes a detector and a run of its key's rows and returns the run's result
columns; the detector carries all that later rows need, so a key may arrive in any
number of runs.

In a stream a detector is kept as typed state, column by column, which Spark's state
reader shows: values that are written when they change, logs that are appended to and
cut at the front, and maps that are looked up entry by entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T


class Detector:
    """What a detector keeps between runs. The names and columns of the state are its contract with older checkpoints.

    A later version may gain attributes of its own, and further values, logs and maps under new names; a checkpoint
    without them leaves those of a fresh detector.
    """

    #: Columns of each value, of each log's entries, and of each map's keys and entries.
    VALUES: dict[str, str] = {}
    LOGS: dict[str, str] = {}
    MAPS: dict[str, tuple[str, str]] = {}

    def values(self) -> dict[str, tuple]:
        """Values that changed since they were last restored."""
        return {}

    def logs(self) -> dict[str, tuple[list, int, int]]:
        """(entries held, how many of them were added, how many others were dropped from the front) of each log since it was restored."""
        return {}

    def restore(self, values: dict[str, tuple], logs: dict[str, list[tuple]], maps: dict[str, Any]) -> None:
        """Take what was kept; names that are not there were never written."""


class Parts(Detector):
    """Several detectors as one: the state of each under its own prefix."""

    def __init__(self, **parts: Detector):
        self.parts = parts
        named = lambda what: {f"{p}_{n}": c for p, d in parts.items() for n, c in getattr(d, what).items()}
        self.VALUES, self.LOGS, self.MAPS = named("VALUES"), named("LOGS"), named("MAPS")

    def values(self) -> dict[str, tuple]:
        return {f"{p}_{n}": v for p, d in self.parts.items() for n, v in d.values().items()}

    def logs(self) -> dict[str, tuple[list, int, int]]:
        return {f"{p}_{n}": v for p, d in self.parts.items() for n, v in d.logs().items()}

    def restore(self, values: dict, logs: dict, maps: dict) -> None:
        for p, d in self.parts.items():
            own = ({n.removeprefix(f"{p}_"): v for n, v in kept.items() if n.startswith(f"{p}_")} for kept in (values, logs, maps))
            d.restore(*own)


Make = Callable[[], Any]
Step = Callable[[Any, pd.DataFrame], pd.DataFrame]


def in_order(df: DataFrame, key: str, order: list[str], schema: str, make: Make, step: Step) -> DataFrame:
    """Each key's rows in order through a detector of its own.

    Rows are dealt by key and sorted by Spark (which spills); a task holds one detector and one batch of rows,
    however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, detector = None, None
        for pdf in batches:
            for name, part in pdf.groupby(key, sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if detector is None or name != held:
                    held, detector = name, make()
                yield step(detector, part.reset_index(drop=True))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Entries:
    """A map in the state by single text keys; what a run has looked up or set is not asked for again."""

    def __init__(self, state):
        self.state, self.seen = state, {}

    def get(self, key: str) -> Any:
        if key not in self.seen:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.seen[key] = None if found is None else found[0]
        return self.seen[key]

    def __setitem__(self, key: str, value: Any) -> None:
        self.state.updateValue((key,), (value,))
        self.seen[key] = value

    def pop(self, key: str) -> None:
        self.state.removeKey((key,))
        self.seen[key] = None

    def items(self) -> list[tuple[str, Any]]:
        return [(k[0], v[0]) for k, v in self.state.iterator()]


#: A log is written anew when it has more dropped entries than held ones, and so many at least.
REWRITE = 1000


_DROPPED = "n bigint"


def _kinds(detector: Detector) -> dict[str, T.StructType]:
    """The types of all columns of a detector's state; only a session can tell them."""
    of = {*detector.VALUES.values(), *detector.LOGS.values(), _DROPPED, *(c for pair in detector.MAPS.values() for c in pair)}
    return {c: T.StructType.fromDDL(c) for c in of}


class Kept:
    """The typed state of one query's detectors."""

    def __init__(self, handle, detector: Detector, kinds: dict[str, T.StructType]):
        struct = kinds.__getitem__
        self.values = {n: handle.getValueState(n, struct(c)) for n, c in detector.VALUES.items()}
        self.logs = {n: handle.getListState(n, struct(c)) for n, c in detector.LOGS.items()}
        self.dropped = {n: handle.getValueState(f"{n}_dropped", struct(_DROPPED)) for n in detector.LOGS}
        self.maps = {n: handle.getMapState(n, struct(k), struct(v)) for n, (k, v) in detector.MAPS.items()}

    def load(self, detector: Detector) -> dict[str, tuple[int, int]]:
        """Restores a fresh detector; (dropped entries, held entries) of each log."""
        values = {n: v for n, s in self.values.items() if (v := s.get()) is not None}
        logs, at = {}, {}
        for n, s in self.logs.items():
            cut = self.dropped[n].get()
            entries = [tuple(e) for e in s.get()] if cut is not None else []
            logs[n] = entries[cut[0] :] if cut is not None else []
            at[n] = (cut[0] if cut is not None else 0, len(logs[n]))
        detector.restore(values, logs, {n: Entries(s) for n, s in self.maps.items()})
        return at

    def save(self, detector: Detector, at: dict[str, tuple[int, int]]) -> None:
        for n, value in detector.values().items():
            self.values[n].update(value)
        for n, (held, added, gone) in detector.logs().items():
            before, loaded = at[n]
            if gone > loaded or before + gone > max(REWRITE, len(held)):
                self.logs[n].put(held) if held else self.logs[n].clear()
                self.dropped[n].update((0,))
            else:
                if added:
                    self.logs[n].appendList(held[len(held) - added :])
                if added or gone:
                    self.dropped[n].update((before + gone,))


#: Rows of a key that are worked on at once.
RUN = 10_000


def sorted_runs(parts: Iterable[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of a trigger, sorted, a run at a time.

    The rows wait for their order in Arrow's columns, some bytes each; what pandas and a step make of them is made
    for a run alone.
    """
    table = pa.concat_tables([pa.Table.from_pandas(p, preserve_index=False) for p in parts], promote_options="permissive").combine_chunks()
    at = pc.sort_indices(table.select(order), [(c, "ascending") for c in order])
    for a in range(0, len(table), RUN):
        yield table.take(at[a : a + RUN]).to_pandas()


def stateful(stream: DataFrame, key: str, order: list[str], schema: str, make: Make, step: Step, initial: DataFrame | None = None, load: Callable[[Any, Any], None] | None = None) -> DataFrame:
    """The same over a stream: each key's detector is kept between triggers, whose rows are sorted.

    `initial` has a row for each key that `load` puts into a fresh detector. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kinds = _kinds(make())

    class Keyed(StatefulProcessor):
        def init(self, handle):
            self.kept = Kept(handle, make(), kinds)

        def handleInputRows(self, name, rows, timerValues):
            detector = make()
            at = self.kept.load(detector)
            for part in sorted_runs(rows, order):
                yield step(detector, part)
            self.kept.save(detector, at)

        def handleInitialState(self, name, row, timerValues):
            detector = make()
            at = self.kept.load(detector)
            load(detector, row.iloc[0])
            self.kept.save(detector, at)

        def close(self):
            pass

    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Keyed(), outputStructType=T.StructType.fromDDL(schema), outputMode="append", timeMode="none", initialState=None if initial is None else initial.groupBy(key))


def milliseconds(span: str) -> int:
    """The length of a span such as `10 minutes`."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
    n, unit = span.split()
    return int(float(n) * 1000 * units[unit.removesuffix("s")])
