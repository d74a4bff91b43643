"""An adaptive radix tree over byte strings of whole fixed-width ids.

A node has one of four layouts by the number of its children: up to 4 or 16 children as two parallel lists in byte order, up
to 48 through an index of 256 bytes, up to 256 as a direct table. A node grows into the next layout when it is full. A run
of bytes without a branch is kept as the prefix of the node below it. A string may end where another goes on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

LAYOUTS = (4, 16, 48, 256)


class Node:
    """``prefix``: the bytes between the parent's branch byte and this node; ``own``: what ends here (None: nothing)."""

    __slots__ = ("children", "index", "layout", "own", "prefix")

    def __init__(self, prefix: bytes):
        self.prefix, self.own, self.layout = prefix, None, 4
        self.index: list | bytearray | None = []  # bytes in order; from 48 on the place of each byte's child, plus one
        self.children: list = []

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.children[byte]
        if self.layout == 48:
            place = self.index[byte]
            return self.children[place - 1] if place else None
        at = bisect_left(self.index, byte)
        return self.children[at] if at < len(self.index) and self.index[at] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Set the child at ``byte``, growing if there is no room for one more."""
        if self.layout <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.children[at] = node
            elif len(self.children) < self.layout:
                self.index.insert(at, byte)
                self.children.insert(at, node)
            else:
                self._grow()
                self.put(byte, node)
        elif self.layout == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
            else:
                self._grow()
                self.children[byte] = node
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.layout == 16:
            places = bytearray(256)
            for place, byte in enumerate(self.index):
                places[byte] = place + 1
            self.index = places
        elif self.layout == 48:
            table: list = [None] * 256
            for byte, place in enumerate(self.index):
                if place:
                    table[byte] = self.children[place - 1]
            self.index, self.children = None, table
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]

    def branches(self) -> Iterator[Node]:
        return (c for c in self.children if c is not None)


class Tree:
    """Strings with lists of numbers that are added up (the first one: the smallest is kept)."""

    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, smallest: int, sums: list[int]) -> None:
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                below = Node(key[at + 1 :])
                node.put(key[at], below)
                node, at = below, len(key)
                break
            same = len(commonprefix([below.prefix, key[at + 1 : at + 1 + len(below.prefix)]]))
            if same < len(below.prefix):  # the run forks, or the key ends inside it
                fork = Node(below.prefix[:same])
                fork.put(below.prefix[same], below)
                below.prefix = below.prefix[same + 1 :]
                node.put(key[at], fork)
                below = fork
            node, at = below, at + 1 + same
        node.own = [smallest, *sums] if node.own is None else [min(node.own[0], smallest), *[a + b for a, b in zip(node.own[1:], sums)]]

    def totals(self, width: int) -> Iterator[tuple[int, list[int]]]:
        """For every prefix of whole ids of ``width`` bytes that some string has: (ids in it, [smallest, sums…]) over the
        strings that begin with it. The prefix of no ids comes too; a node comes after all below it."""
        order, stack = [], [(self.root, 0, 0)]
        while stack:
            node, above, depth = stack.pop()
            order.append((node, above, depth))
            stack.extend((c, depth, depth + 1 + len(c.prefix)) for c in node.branches())
        total: dict[int, list[int]] = {}
        for node, above, depth in reversed(order):
            parts = [total.pop(id(c)) for c in node.branches()] + ([node.own] if node.own is not None else [])
            if not parts:
                continue  # the root of an empty tree
            own = [min(p[0] for p in parts), *[sum(column) for column in list(zip(*parts))[1:]]]
            total[id(node)] = own
            # All whole ids that end on the run down to this node, the branch byte included, have this node's strings.
            first = above // width + 1 if node is not self.root else 0
            for ids in range(first, depth // width + 1):
                yield ids, own
