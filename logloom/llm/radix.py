"""Adaptive radix trees over byte keys of fixed-width parts.

Keys are strings of whole parts of ``width`` bytes, here big-endian turn ids.
An inner node holds its children in one of four layouts that grow with their
number (4 or 16 sorted bytes, an index of 256 places into 48 slots, 256 slots),
and the bytes that all keys below it share are kept in the node (path
compression).  Bytes between part boundaries never become nodes of the result:
``walk`` reports the tree at depths that are whole parts, those inside a
compressed path included."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator


class Few:
    """4 or 16 children as sorted bytes beside their nodes."""

    __slots__ = ("room", "keys", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.nodes = room, [], {}

    def get(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.nodes[byte] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node) -> bool:
        """Whether there was room."""
        if byte not in self.nodes:
            if len(self.keys) == self.room:
                return False
            insort(self.keys, byte)
        self.nodes[byte] = node
        return True

    def items(self):
        return [(b, self.nodes[b]) for b in self.keys]

    def grown(self):
        larger = Few(16) if self.room == 4 else Indexed()
        for b, n in self.items():
            larger.put(b, n)
        return larger


class Indexed:
    """Up to 48 children in slots, found by an index over all bytes."""

    __slots__ = ("slot", "nodes")
    room = 48

    def __init__(self):
        self.slot, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.slot[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> bool:
        at = self.slot[byte]
        if at:
            self.nodes[at - 1] = node
            return True
        if len(self.nodes) == self.room:
            return False
        self.nodes.append(node)
        self.slot[byte] = len(self.nodes)
        return True

    def items(self):
        return [(b, self.nodes[self.slot[b] - 1]) for b in range(256) if self.slot[b]]

    def grown(self):
        larger = Full()
        for b, n in self.items():
            larger.put(b, n)
        return larger


class Full:
    """A slot for every byte."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self):
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class Node:
    """The bytes from its parent's branch on, the value that ends here, children."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.children = path, value, None

    def child(self, byte: int):
        return self.children.get(byte) if self.children is not None else None

    def adopt(self, node: Node) -> None:
        if self.children is None:
            self.children = Few()
        if not self.children.put(node.path[0], node):
            self.children = self.children.grown()
            self.children.put(node.path[0], node)


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and of ``b`` from ``at``."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # the first differing byte lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Keys are ``header`` bytes, whatever they say, and parts of ``width``."""

    def __init__(self, width: int, merge: Callable, header: int = 0):
        self.width, self.header, self.merge = width, header, merge
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.adopt(Node(key[at:], value))
                return
            same = _common(below.path, key, at)
            at += same
            if same < len(below.path):  # split the compressed path
                upper = Node(below.path[:same])
                below.path = below.path[same:]
                upper.adopt(below)
                node.adopt(upper)
                below = upper
            node = below
        node.value = value if node.value is None else self.merge(node.value, value)

    def walk(self) -> Iterator[tuple[bytes, int, int, object]]:
        """(key, first depth, last depth, value) for each run of whole-part nodes
        on one compressed path: all of them are starts of ``key`` and have the
        merged value of what ends at or below them.  Children come first."""
        stack: list[list] = [[self.root, b"", None, None]]  # node, key to its end, children to do, value
        while stack:
            frame = stack[-1]
            node, key, todo, _ = frame
            if todo is None:
                frame[3] = node.value
                todo = frame[2] = [n for _, n in node.children.items()][::-1] if node.children is not None else []
            if todo:
                below = todo.pop()
                stack.append([below, key + below.path, None, None])
                continue
            stack.pop()
            value = frame[3]
            above = len(key) - len(node.path) - self.header
            first = 0 if node is self.root else max(above // self.width + 1, 0)
            last = (len(key) - self.header) // self.width
            if first <= last and value is not None:
                yield key, first, last, value
            if stack and value is not None:
                held = stack[-1][3]
                stack[-1][3] = value if held is None else self.merge(held, value)
