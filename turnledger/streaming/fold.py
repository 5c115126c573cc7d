"""Stateful fold of patches per scope, in floor order, whatever order they arrive in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGES = StructType(
    [
        StructField("chat_id", StringType()),
        StructField("branch_id", StringType()),
        StructField("seq", LongType()),
        StructField("op", StringType()),
        StructField("path", StringType()),
        StructField("old_value", StringType()),
        StructField("new_value", StringType()),
    ]
)

_COLUMNS = [f.name for f in CHANGES.fields]

#: Cells and floors that one call holds before it turns to the state store.
HELD_CELLS, HELD_FLOORS = 20_000, 20_000


def _parent(path: str) -> str | None:
    return path.rpartition("/")[0] if "/" in path else None


class PathTree:
    """Known paths in a map state, each with its value and its place among its siblings.

    A cell is ``value, first child, next sibling, previous sibling``. Paths above a known one
    have cells without a value, which go when their last child goes. Setting or removing a
    path reads its ancestors, its neighbours and what lies below it, never the other paths,
    and no cell grows with the number of children.
    """

    def __init__(self, cells) -> None:
        self.cells = cells

    def get(self, path: str) -> list | None:
        return list(self.cells.getValue((path,))) if self.cells.containsKey((path,)) else None

    def _put(self, path: str, cell: list) -> None:
        self.cells.updateValue((path,), tuple(cell))

    def set(self, path: str, value: str) -> None:
        cell = self.get(path)
        if cell is not None:
            self._drop(cell[1])
            self._put(path, [value, None, *cell[2:]])
            return
        cell = [value, None, None, None]
        while (parent := _parent(path)) is not None:
            above = self.get(parent)
            if above is not None:
                cell[2] = above[1]
                if above[1] is not None:
                    self._relink(above[1], 3, path)
                self._put(parent, [above[0], path, *above[2:]])
                break
            self._put(path, cell)
            path, cell = parent, [None, path, None, None]
        self._put(path, cell)

    def remove(self, path: str) -> None:
        """Takes a path with a cell out, with all below it and with cells above left empty."""
        cell = self.get(path)
        self._drop(cell[1])
        while True:
            self.cells.removeKey((path,))
            parent = _parent(path)
            if parent is None:
                return
            if cell[2] is not None:
                self._relink(cell[2], 3, cell[3])
            if cell[3] is not None:
                self._relink(cell[3], 2, cell[2])
                return
            above = self.get(parent)
            above[1] = cell[2]
            if above[0] is not None or above[1] is not None:
                self._put(parent, above)
                return
            path, cell = parent, above

    def _relink(self, path: str, place: int, other: str | None) -> None:
        cell = self.get(path)
        cell[place] = other
        self._put(path, cell)

    def _drop(self, first: str | None) -> None:
        todo = [first]
        while todo:
            path = todo.pop()
            if path is not None:
                _, child, sibling, _ = self.get(path)
                self.cells.removeKey((path,))
                todo += [sibling, child]


class BatchCells:
    """Cells of a map state as one call of the fold sees them: read once, written once.

    At most ``limit`` cells are held; then changes are written and the cells are let go.
    """

    def __init__(self, state, limit: int = HELD_CELLS) -> None:
        self.state, self.limit = state, limit
        self.cells: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()
        self.stored: set[tuple] = set()

    def _read(self, key: tuple) -> tuple | None:
        if key not in self.cells:
            if len(self.cells) >= self.limit:
                self.flush()
            found = self.state.containsKey(key)
            self.cells[key] = tuple(self.state.getValue(key)) if found else None
            if found:
                self.stored.add(key)
        return self.cells[key]

    def containsKey(self, key: tuple) -> bool:
        return self._read(key) is not None

    def getValue(self, key: tuple) -> tuple | None:
        return self._read(key)

    def updateValue(self, key: tuple, cell: tuple) -> None:
        self._read(key)
        self.cells[key] = cell
        self.changed.add(key)

    def removeKey(self, key: tuple) -> None:
        self.updateValue(key, None)

    def flush(self) -> None:
        for key in self.changed:
            cell = self.cells[key]
            if cell is not None:
                self.state.updateValue(key, cell)
            elif key in self.stored:
                self.state.removeKey(key)
        self.cells, self.changed, self.stored = {}, set(), set()


class PatchFold(StatefulProcessor):
    """State: a tree of paths, the next expected position, floors waiting for an earlier one.

    A floor that arrives early waits; one that was folded already is ignored (edits go
    through the rebuild plan). Changes list the topmost path only, as the batch diff does.
    Paths and waiting floors are map entries of the state store, so a long chat is never
    loaded whole, and a patch reads only the cells around its path. Cells are read and written
    once a call, and of the floors of a call only those are stored that still wait at its end;
    a call that holds many spills them to the store.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("v", StringType())])
        number = StructType([StructField("v", LongType())])
        cell = StructType([StructField(n, StringType()) for n in ("value", "first", "next", "previous")])
        self.tree = PathTree(handle.getMapState("tree", text, cell))
        self.waiting = handle.getMapState("waiting", number, text)
        self.next = handle.getValueState("next", number)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected = self.next.get()[0] if self.next.exists() else 0
        cells = BatchCells(self.tree.cells)
        tree, here, out = PathTree(cells), {}, []
        # Floors that waited, read at once; not complete: others are looked up one by one.
        waited = dict(islice(((k[0], v[0]) for k, v in self.waiting.iterator()), HELD_FLOORS)) if self.waiting.exists() else {}
        complete, used = len(waited) < HELD_FLOORS, []

        def fold() -> None:
            nonlocal expected
            while True:
                patches = here.pop(expected, None)
                if expected in waited:
                    earlier = waited.pop(expected)
                    patches = earlier if patches is None else patches
                    used.append(expected)
                elif not complete and self.waiting.containsKey((expected,)):
                    patches = self.waiting.getValue((expected,))[0] if patches is None else patches
                    self.waiting.removeKey((expected,))
                if patches is None:
                    return
                self._apply(tree, key, expected, json.loads(patches), out)
                expected += 1

        def store() -> None:
            if used and complete and not waited:
                self.waiting.clear()
            else:
                for seq in used:
                    self.waiting.removeKey((seq,))
            for seq, patches in here.items():
                self.waiting.updateValue((int(seq),), (patches,))
            used.clear()
            here.clear()

        for batch in rows:
            for seq, patches in zip(batch["seq"].tolist(), batch["patches"].tolist()):
                if seq >= expected:
                    here[seq] = patches
            if len(here) >= HELD_FLOORS:
                fold()
                store()
                waited, complete = {}, False
                if out:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out.clear()
        fold()
        store()
        cells.flush()
        self.next.update((expected,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    @staticmethod
    def _apply(tree: PathTree, key: tuple, seq: int, patches: dict, out: list) -> None:
        for path, value in sorted(patches.items()):
            cell = tree.get(path)
            old = cell[0] if cell else None
            # A path that is set or removed takes what lies below it along.
            if value is None:
                if cell:
                    tree.remove(path)
                    out.append((*key, seq, "remove", path, old, None))
            elif old != value or cell[1] is not None:
                tree.set(path, value)
                if old != value:
                    out.append((*key, seq, "add" if old is None else "replace", path, old, value))

    def close(self) -> None:
        pass


def fold_stream(floors: DataFrame) -> DataFrame:
    """Change rows of a stream of floors ``(scope, seq, patches)``.

    ``seq`` counts the floors of a scope from 0; ``patches`` is a JSON object of pointers
    and values, null for a removal.
    """
    return floors.groupBy("chat_id", "branch_id").transformWithStateInPandas(
        statefulProcessor=PatchFold(), outputStructType=CHANGES, outputMode="Append", timeMode="None"
    )
