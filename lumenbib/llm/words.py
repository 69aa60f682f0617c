"""Helpers inside tasks: documents in bounded slices, remembered results per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

SLICE_CHARS = 1 << 20
KNOWN_WORDS = 300_000


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``chars`` characters each; one longer document stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """``compute`` gives the values of many words at once; values of about ``limit`` words are kept, the latest used.

    What is kept never changes a result: a word that was dropped is computed again. No value is None.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence], limit: int = KNOWN_WORDS):
        self.compute, self.limit = compute, limit
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def __call__(self, words: list[str]) -> list:
        found = list(map(self.known.get, words))  # one look-up for a word that is known
        if None not in found:
            return found
        gaps = [i for i, x in enumerate(found) if x is None]
        lacking = {words[i] for i in gaps}
        values = {w: x for w in lacking if (x := self.older.get(w)) is not None}
        missing = list(lacking - values.keys())
        values.update(zip(missing, self.compute(missing), strict=True))
        self.known.update(values)
        for i in gaps:
            found[i] = values[words[i]]
        if len(self.known) > self.limit // 2:  # the older half goes
            self.known, self.older = {}, self.known
        return found
