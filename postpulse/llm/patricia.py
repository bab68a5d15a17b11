"""A compressed radix trie over byte strings whose subtrees can be spilled."""

from __future__ import annotations

from collections.abc import Iterator

NODE_BYTES = 300  # what a node takes beside its label, roughly


class _Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.value: tuple | None = None


def _common(data: bytes, start: int, label: bytes) -> int:
    """How many bytes of ``label`` stand in ``data`` from ``start``; found by halving."""
    low, high = 0, min(len(label), len(data) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if data.startswith(label[low:middle], start + low):
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Full byte strings; a terminal node holds the best candidate and how many came.

    A candidate is a tuple; the smallest stays.
    """

    def __init__(self):
        self.root = _Node(b"")
        self.bytes = 0

    def insert(self, data: bytes, candidate: tuple, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(data):
            child = node.children.get(data[at])
            if child is None:
                child = _Node(data[at:])
                node.children[data[at]] = child
                self.bytes += len(child.label) + NODE_BYTES
                node, at = child, len(data)
            elif data.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                same = _common(data, at, child.label)
                middle = _Node(child.label[:same])
                child.label = child.label[same:]
                middle.children[child.label[0]] = child
                node.children[data[at]] = middle
                self.bytes += NODE_BYTES
                node, at = middle, at + same
        if node.value is None:
            node.value = (candidate, count)
        else:
            node.value = (min(node.value[0], candidate), node.value[1] + count)

    @staticmethod
    def _below(node: _Node, path: bytes) -> Iterator[tuple[bytes, tuple, int, int]]:
        """Terminals at and below a node, with the bytes of memory each node takes."""
        todo = [(node, path)]
        while todo:
            node, path = todo.pop()
            path += node.label
            size = len(node.label) + NODE_BYTES
            if node.value is not None:
                yield path, *node.value, size
            todo += [(child, path) for child in node.children.values()]

    def _size(self, node: _Node) -> int:
        todo, size = [node], 0
        while todo:
            node = todo.pop()
            size += len(node.label) + NODE_BYTES
            todo += node.children.values()
        return size

    def spill(self, keep: int) -> Iterator[tuple[bytes, tuple, int]]:
        """Cut off the largest subtrees until at most ``keep`` bytes remain; yield their terminals.

        A string that is inserted again later starts a new terminal; whoever receives
        the terminals merges those of the same string.
        """
        sizes = {first: self._size(child) for first, child in self.root.children.items()}
        while self.bytes > keep and sizes:
            first = max(sizes, key=sizes.get)
            child = self.root.children.pop(first)
            self.bytes -= sizes.pop(first)
            for path, candidate, count, _ in self._below(child, b""):
                yield path, candidate, count

    def terminals(self) -> Iterator[tuple[bytes, tuple, int]]:
        """All terminals; the trie is empty afterwards."""
        for path, candidate, count, _ in self._below(self.root, b""):
            yield path, candidate, count
        self.root, self.bytes = _Node(b""), 0
