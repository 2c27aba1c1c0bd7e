"""What Python workers remember between batches and tasks: bounded in bytes, and of one operator at a time.

Workers are used again by the next stage.  What an operator has remembered goes
as soon as another one remembers something, so stages do not add up.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hands freed memory to the system, where its allocators would keep it for this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Remembered(dict):
    """Values made from keys, those used lately: at most ``limit`` bytes, counted by the caller.

    Entries are in two halves; when the newer one is full the older one goes, and
    what is found in the older half moves to the newer one.
    """

    _active: Remembered | None = None

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0
        self.earlier: dict = {}

    def keep(self, key, value, size: int) -> None:
        self._make_room()
        self[key] = value
        self.held += size

    def keep_all(self, made: dict, size: int) -> None:
        """Many entries, ``size`` bytes in all."""
        self._make_room()
        self.update(made)
        self.held += size

    def take_over(self) -> None:
        """What another operator has remembered goes; its place is this one's."""
        if Remembered._active is not self:
            if Remembered._active is not None:
                Remembered._active.forget()
                give_back()
            Remembered._active = self

    def _make_room(self) -> None:
        self.take_over()
        if self.held > self.limit // 2:
            self.earlier, self.held = dict(self), 0
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.earlier, self.held = {}, 0
