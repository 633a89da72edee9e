"""Models that live as long as a worker process, and the lane in which they run one at a time.

Python workers are reused by task after task, so a model that is kept by its identity is loaded once for each worker, not for
each task. A load that failed is told to all who ask within ``RETRY_SECONDS`` and only then tried again, so that the tasks of
a stage don't each wait for the same failure.
"""

from __future__ import annotations

import fcntl
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

RETRY_SECONDS = 30.0
_LOADED: dict[str, Any] = {}
_FAILED: dict[str, tuple[float, str]] = {}


def loaded(identity: str, load: Callable[[], Any], retry: float = RETRY_SECONDS) -> Any:
    """This process's model of that identity; the first who asks loads it."""
    if identity in _LOADED:
        return _LOADED[identity]
    if (failed := _FAILED.get(identity)) and time.monotonic() < failed[0]:
        raise RuntimeError(f"model {identity} can't be loaded: {failed[1]}")
    try:
        model = load()
    except Exception as error:
        _FAILED[identity] = (time.monotonic() + retry, repr(error))
        raise
    _FAILED.pop(identity, None)
    _LOADED[identity] = model
    return model


def forget(identity: str) -> None:
    """Drops a model, and what is known of its failures, from this process."""
    _LOADED.pop(identity, None)
    _FAILED.pop(identity, None)


@contextmanager
def lane(path: str | None) -> Iterator[None]:
    """Held by one process of a machine at a time; it is free again when its holder dies. Without a path there is no lane."""
    if path is None:
        yield
        return
    with open(path, "a") as file:
        fcntl.flock(file, fcntl.LOCK_EX)
        yield
