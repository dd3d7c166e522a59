"""What a Python worker opens once and keeps for its tasks: models, connections."""

from __future__ import annotations

from collections.abc import Callable

#: What a worker has opened: one classifier at a time, kept for all tasks that use it.
_OPEN: dict[str, object] = {}


def held(key: str, open_: Callable[[], object]) -> object:
    """The opened thing of this key; another key's is closed first, so a worker holds one."""
    if key not in _OPEN:
        for old in _OPEN.values():
            if hasattr(old, "close"):
                old.close()
        _OPEN.clear()
        _OPEN[key] = open_()
    return _OPEN[key]
