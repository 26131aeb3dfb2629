"""Exact encoding of long texts chunk by chunk, with a bounded memory of chunks already seen.

Where no piece of a vocabulary crosses the beginning of a word, nothing is joined across a single space between
two visible characters. So a text is the row of its chunks, each with the space before it, and frequent chunks are encoded once
per task. Texts where a space has another white space beside it are cut at fewer places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Chunks remembered per task, and the longest chunk worth remembering: a bound on memory, not on what is encoded.
MEMORY, LONGEST = 200_000, 48
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class ChunkEncoder:
    """Ids of a whole text as packed integers.

    ``encode`` maps a list of chunks to id lists; its flag says whether a space stood before each of them.
    """

    def __init__(self, encode: Callable[[list[str], bool], list[list[int]]], dtype: str):
        self._encode, self._dtype, self._known = encode, dtype, {}

    def __call__(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        found = list(map(self._known.get, parts[1:]))
        if None in found or not _visible(parts[0][-1:]):
            missing = {p for p, f in zip(parts[1:], found) if f is None}
            if not _visible(parts[0][-1:]) or not all(map(_regular, missing)):
                parts = _CUT.split(text)
                missing = {p for p in parts[1:] if p not in self._known}
            ids = self._learn(sorted(missing))
            found = [ids[p] if p in ids else self._known[p] for p in parts[1:]]
        first = self._pack(self._encode([parts[0]], False)[0])
        return np.frombuffer(b"".join([first, *found]), self._dtype)

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self._dtype).tobytes()

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Encode new chunks. Regular ones of moderate length are remembered while there is room."""
        fresh = dict(zip(missing, map(self._pack, self._encode(missing, True)))) if missing else {}
        known = self._known
        if len(known) < MEMORY:
            known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST and _regular(p))
        return fresh


def _regular(part: str) -> bool:
    return _visible(part[:1]) and _visible(part[-1:])


def _visible(char: str) -> bool:
    """Whether a single space beside this character is a place to cut."""
    return bool(char) and not char.isspace() and char != "▁"
