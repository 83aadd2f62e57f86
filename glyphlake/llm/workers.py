"""What a Python worker keeps between tasks: the caches of the operator that runs in it, and of no other."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[tuple, Any] = {}
_owner: list[str] = [""]


def enter(owner: str) -> None:
    """Called where an operator's function starts in a worker: drops what others kept and gives freed memory back."""
    if _owner[0] != owner:
        _kept.clear()
        _owner[0] = owner
        gc.collect()
    release()


def release() -> None:
    """Gives freed memory back: else a worker keeps the most that any of its batches took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def kept(owner: str, build: Callable[..., Any], *key: Any) -> Any:
    """build(*key), kept for the worker's next tasks of the same operator."""
    enter(owner)
    if (owner, *key) not in _kept:
        _kept[(owner, *key)] = build(*key)
    return _kept[(owner, *key)]
