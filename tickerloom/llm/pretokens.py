"""Cuts texts where any byte-level pre-tokenizer pattern of the usual form also cuts: before a space and a non-space.

A pattern whose alternatives take at most one leading space always starts a new match at a
space that white space doesn't follow. So a text is a list of chunks, " word," and the like,
that repeat often; what a chunk encodes to is found once and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_LOOSE = re.compile(r" (?:\s|\Z)")
#: Longer texts are cut into windows of about so many code points, at chunk borders.
WINDOW = 1 << 22


class Numbers(dict):
    """Numbers keys in order of appearance and remembers the new ones."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = found = len(self)
        self.new.append(key)
        return found


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in pieces that start at chunk borders."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def chunk_keys(text: str) -> list:
    """Keys of the chunks of a text: the chunk without its leading space, or a 1-tuple if it has none."""
    if not text:
        return []
    parts = text.split(" ")
    if _LOOSE.search(text):
        runs = [[parts[0]]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                runs.append([part])
            else:
                runs[-1].append(part)
        parts = [" ".join(run) for run in runs]
    parts[0] = (parts[0],)
    return parts


def chunk_text(key) -> str:
    return key[0] if isinstance(key, tuple) else " " + key


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[s : s + n], one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)]
