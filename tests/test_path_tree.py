"""The tree of paths behind the streaming fold, against a plain dictionary of paths."""

import random

from turnledger.streaming.fold import PathTree


class Cells:
    """A map state in memory that counts its reads and writes."""

    def __init__(self):
        self.data, self.used = {}, 0

    def containsKey(self, key):
        self.used += 1
        return key in self.data

    def getValue(self, key):
        return self.data[key]

    def updateValue(self, key, value):
        self.used += 1
        self.data[key] = value

    def removeKey(self, key):
        self.used += 1
        del self.data[key]


def walk(cells, path):
    """Values at and below a path, along the links."""
    value, child, _, _ = cells.data[(path,)]
    found = {path: value} if value is not None else {}
    before = None
    while child is not None:
        assert cells.data[(child,)][3] == before
        found |= walk(cells, child)
        before, child = child, cells.data[(child,)][2]
    return found


def test_path_tree_equals_a_dictionary():
    rng = random.Random(3)
    for _ in range(60):
        cells, plain = Cells(), {}
        tree = PathTree(cells)
        for step in range(120):
            path = "".join(f"/{rng.choice('abc')}" for _ in range(rng.randrange(0, 5)))
            below = [k for k in plain if k.startswith(path + "/")]
            cell = tree.get(path)
            assert (cell is not None) == (path in plain or bool(below))
            for k in below:
                del plain[k]
            if rng.random() < 0.4:
                plain.pop(path, None)
                if cell:
                    tree.remove(path)
            else:
                plain[path] = str(step)
                tree.set(path, str(step))
            assert {k[0]: c[0] for k, c in cells.data.items() if c[0] is not None} == plain
            assert (walk(cells, "") if cells.data else {}) == plain
            # A cell without a value stands above a known path.
            assert all(c[0] is not None or c[1] is not None for c in cells.data.values())


def test_names_that_begin_alike_and_paths_without_a_slash():
    cells = Cells()
    tree = PathTree(cells)
    for path in ["/a", "/ab", "/a/", "/a//x", "a", "a/b"]:
        tree.set(path, path)
    tree.remove("/a")
    assert sorted(k for (k,), c in cells.data.items() if c[0]) == ["/ab", "a", "a/b"]
    tree.remove("a")
    assert sorted(k for (k,), c in cells.data.items() if c[0]) == ["/ab"]


def test_a_patch_reads_only_the_cells_around_its_path():
    cells = Cells()
    tree = PathTree(cells)
    for i in range(5000):
        tree.set(f"/story/{i}/text", str(i))
    for change in (lambda: tree.set("/story/77/text", "new"), lambda: tree.remove("/story/4000"), lambda: tree.set("/story/x/y", "1")):
        cells.used = 0
        change()
        assert cells.used <= 12
