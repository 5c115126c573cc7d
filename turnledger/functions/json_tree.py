"""Canonical JSON text as a tree of spans, of any depth: no recursion, one pass over the tokens.

The text is what ``canonical_json`` gives (sorted keys, no spacing), so a node's value is a
piece of the text. A node's digest covers its kind and those of all below it, so two
subtrees are equal when their digests are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{}]|[^\[\]{}:,"\s]+', re.S)


class Node:
    __slots__ = ("digest", "end", "items", "kind", "name", "start")

    def __init__(self, kind: str, start: int, name: str | None) -> None:
        self.kind, self.start, self.name, self.items = kind, start, name, []


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def read_tree(text: str) -> Node:
    """Root of the tree; ``items`` are a container's nodes in order, ``name`` a member's key."""
    open_: list[Node] = []
    name = None
    for token in _TOKEN.finditer(text):
        word = token.group()
        if word in ("{", "["):
            open_.append(Node("object" if word == "{" else "array", token.start(), name))
            name = None
            continue
        if word in ("}", "]"):
            node = open_.pop()
            mark = blake2b(node.kind.encode(), digest_size=16)
            for item in node.items:
                key = _bytes(item.name or "")
                mark.update(b"%d:" % len(key) + key + item.digest)
        elif name is None and open_ and open_[-1].kind == "object":
            name = _bytes(json.loads(word, strict=False)).decode()
            continue
        else:
            node, name = Node("value", token.start(), name), None
            mark = blake2b(_bytes(word), digest_size=16, person=b"value")
        node.end, node.digest = token.end(), mark.digest()
        if not open_:
            return node
        open_[-1].items.append(node)
    raise ValueError("not canonical JSON")


def _below(path: str, name: str) -> str:
    return f"{path}/{name.replace('~', '~0').replace('/', '~1')}"


def tree_rows(text: str, expand_arrays: bool, members: bool = False) -> Iterator[tuple[str | None, ...]]:
    """path, kind and value of the root and all below it, each container after what it holds.

    With ``members`` also the escaped names of an object's members, joined by ``/``.
    """
    open_: list[tuple[str, list[str] | None, list[int]]] = []  # path, names of an object, items so far
    name = None
    closed, start = 0, 0  # brackets open in an array that stays closed, and where it starts
    for token in _TOKEN.finditer(text):
        word = token.group()
        first = word[0]
        if closed:
            closed += (first in "[{") - (first in "]}")
            if not closed:
                yield (path, "value", text[start : token.end()], None) if members else (path, "value", text[start : token.end()])
            continue
        if first in "}]":
            path, names, _ = open_.pop()
            kind = "array" if names is None else "object"
            yield (path, kind, None, None if names is None else "/".join(names)) if members else (path, kind, None)
            continue
        if not open_:
            path = ""
        else:
            above, names, items = open_[-1]
            if names is None:
                path = f"{above}/{items[0]}"
                items[0] += 1
            elif name is None:
                name = word[1:-1] if "\\" not in word else _bytes(json.loads(word, strict=False)).decode()
                if "~" in name or "/" in name:
                    name = name.replace("~", "~0").replace("/", "~1")
                names.append(name)
                continue
            else:
                path, name = f"{above}/{name}", None
        if first == "{":
            open_.append((path, [], [0]))
        elif first == "[":
            if expand_arrays:
                open_.append((path, None, [0]))
            else:
                closed, start = 1, token.start()
        else:
            yield (path, "value", word, None) if members else (path, "value", word)


def tree_changes(before: str | None, after: str | None) -> Iterator[tuple]:
    """op, path, old and new kind and value of the topmost changes; equal subtrees stay closed."""

    def shown(text, node):
        if node is None:
            return None, None
        return ("object", None) if node.kind == "object" else ("value", text[node.start : node.end])

    todo = [("", *(None if t is None else read_tree(t) for t in (before, after)))]
    while todo:
        path, old, new = todo.pop()
        if old is None or new is None:
            if old is not new:
                yield ("add" if old is None else "remove", path, *shown(before, old), *shown(after, new))
        elif old.digest == new.digest:
            continue
        elif old.kind == new.kind == "object":
            left, right = ({item.name: item for item in side.items} for side in (old, new))
            todo += [(_below(path, name), left.get(name), right.get(name)) for name in left | right]
        else:
            yield ("replace", path, *shown(before, old), *shown(after, new))
