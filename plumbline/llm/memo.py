"""A memo of bounded size."""

from __future__ import annotations

from collections.abc import Callable

#: What an entry of short bytes takes besides its contents: two objects and a slot of each table.
ENTRY_BYTES = 200


class Memo(dict):
    """Results by key in two generations, bounded by bytes.

    When the young generation has taken its half of ``most`` bytes it becomes the old one and the
    former old one is let go, so what is used often stays. ``size`` gives a result's bytes.
    """

    def __init__(self, make: Callable, most: int = 64 << 20, size: Callable = len):
        super().__init__()
        self.make, self.half, self.size = make, most // 2, size
        self.old, self.taken = {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.taken += ENTRY_BYTES + len(key) + self.size(value)
        if self.taken > self.half:
            self.old = dict(self)
            self.clear()
            self.taken = 0
        self[key] = value
        return value
