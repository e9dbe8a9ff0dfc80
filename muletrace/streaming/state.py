"""Structures over keyed map state that are read and written by what a batch brings, not by what they hold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

FAN = 5  # bits of a branch
WIDE = 1 << FAN
LONGEST = (1 << 62) - 1  # values beyond are counted here


class Queue:
    """First in, first out: places in a map, the first and the next free one beside it in ``at`` as [head, tail]."""

    KEY, VALUE = "place bigint", "item bigint"

    def __init__(self, state: Any, head: int, tail: int):
        self.state, self.head, self.tail = state, head, tail

    def __len__(self) -> int:
        return self.tail - self.head

    def push(self, item: int) -> None:
        self.state.updateValue((self.tail,), (item,))
        self.tail += 1

    def first(self) -> int:
        return self.state.getValue((self.head,))[0]

    def pop(self) -> int:
        item = self.first()
        self.state.removeKey((self.head,))
        self.head += 1
        return item


def branches(value: int) -> Iterator[tuple[tuple[int, int, int], int]]:
    """(node, child) from the root to the leaf: by number of bits first, then ``FAN`` bits at a time."""
    value = min(max(value, 0), LONGEST)
    bits = value.bit_length()
    yield (-1, 0, 0), bits // WIDE
    yield (-1, 1, bits // WIDE), bits % WIDE
    left = max(bits - 1, 0)
    while left:
        take = min(FAN, left)
        yield (bits, left, value >> left), value >> (left - take) & (1 << take) - 1
        left -= take


class Counts:
    """How often which whole number came, as a logarithmic histogram whose leaves are single numbers.

    A node holds the counts of its children, so adding a number and finding the k-th smallest both touch one node per
    level: 2 and a fifth of the bits. Nodes a batch has touched are kept until :meth:`flush`.
    """

    KEY = "bits int, below int, lead bigint"
    VALUE = ", ".join(f"n{k} bigint" for k in range(WIDE))

    def __init__(self, state: Any):
        self.state = state
        self.nodes: dict[tuple[int, int, int], list[int]] = {}
        self.changed: set[tuple[int, int, int]] = set()

    def _node(self, key: tuple[int, int, int]) -> list[int]:
        if key not in self.nodes:
            self.nodes[key] = list(self.state.getValue(key) or [0] * WIDE)
        return self.nodes[key]

    def add(self, value: int) -> None:
        for key, child in branches(value):
            self._node(key)[child] += 1
            self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            self.state.updateValue(key, tuple(self.nodes[key]))
        self.changed = set()

    def kth(self, k: int) -> int:
        """The k-th smallest, from 1."""

        def child(key: tuple[int, int, int], k: int) -> tuple[int, int]:
            for c, n in enumerate(self._node(key)):
                if k <= n:
                    return c, k
                k -= n
            raise IndexError(k)

        high, k = child((-1, 0, 0), k)
        low, k = child((-1, 1, high), k)
        bits = high * WIDE + low
        value, left = min(bits, 1), max(bits - 1, 0)
        while left:
            take = min(FAN, left)
            c, k = child((bits, left, value), k)
            value, left = value << take | c, left - take
        return value

    def median(self, n: int) -> float | None:
        """Of n numbers; the mean of the two in the middle."""
        return (self.kth((n + 1) // 2) + self.kth(n // 2 + 1)) / 2.0 if n else None
