"""What a Python worker remembers between tasks: one thing at a time, so stages don't add up their memories."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def only(key: Hashable, make: Callable[[], T]) -> T:
    """The thing held under ``key``; whatever else was held goes first."""
    if key not in _HELD:
        clear()
        _HELD[key] = make()
    return _HELD[key]


def clear() -> None:
    """Called at the start of tasks that need their memory for themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
