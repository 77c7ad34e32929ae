"""Word caches shared by the text operators' Python workers, and their memory between tasks."""

from __future__ import annotations

import ctypes
import functools
import weakref
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa

CACHE_LIMIT = 350_000
_LIVE: weakref.WeakSet = weakref.WeakSet()
_OWNER = [""]


class WordCache(dict):
    """A dict from word to value, filled by a batch function, in two generations.

    When the young generation is full it becomes the old one; words found there move back. The
    bound keeps a worker's memory independent of the vocabulary, and frequent words stay known.
    """

    __hash__ = object.__hash__  # identity, for the set of live caches

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = CACHE_LIMIT):
        super().__init__()
        self._compute, self._limit = compute, limit
        self._old: dict = {}
        _LIVE.add(self)

    def forget(self) -> None:
        """Empty both generations."""
        self.clear()
        self._old = {}

    def ensure(self, words: Collection) -> None:
        """Make sure that every word of ``words`` (each named once) has a value."""
        missing = [w for w in words if w not in self]
        if not missing:
            return
        if len(self) + len(missing) > self._limit:
            self._old = dict(self)
            self.clear()
            missing = list(words)
        old = self._old
        new = []
        for w in missing:
            if w in old:
                self[w] = old[w]
            else:
                new.append(w)
        if new:
            self.update(zip(new, self._compute(new), strict=True))


def lean(owner: str) -> Callable:
    """Decorates a task function: caches of other operators are emptied first, freed memory is given back last.

    Spark reuses Python workers from one operator to the next; without this a worker would hold the
    caches of all operators that it has ever run.
    """

    def wrap(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        @functools.wraps(run)
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_over(owner)
            try:
                yield from run(batches)
            finally:
                give_back()

        return task

    return wrap


def take_over(owner: str) -> None:
    """Empty all caches if another operator filled them."""
    if _OWNER[0] != owner:
        for cache in list(_LIVE):
            cache.forget()
        _OWNER[0] = owner


def give_back() -> None:
    """Return unused memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has no such call
        pass
