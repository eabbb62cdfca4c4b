"""Words of many texts at once, as numbers."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

#: Bytes of text that are worked on at once, and words of a vocabulary after which a new one is begun.
CHUNK, HELD = 1 << 20, 1 << 18

P = 0x9E3779B97F4A7C55
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Vocabulary(dict):
    """Numbers for words, in the order in which they are first met, and a hash of each."""

    def __init__(self):
        self.hashes = np.zeros(1024, "u8")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return n


@dataclass
class Coded:
    """The words of some texts: their numbers, how many each text has, the hash of each number, and a digest of each text's words
    (None for none)."""

    ids: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    digests: list[bytes | None]

    @staticmethod
    def of(texts: list[bytes], vocabulary: Vocabulary) -> tuple[Vocabulary, Coded]:
        """With the vocabulary that goes on to the next texts."""
        if len(vocabulary) > HELD:
            vocabulary = Vocabulary()
        split = [t.translate(LOWER).split() for t in texts]
        ids = np.array([n for w in split for n in map(vocabulary.__getitem__, w)], "i8")
        digests = [blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in split]
        return vocabulary, Coded(ids, np.array([len(w) for w in split], "i8"), vocabulary.hashes[: len(vocabulary)], digests)


def chunks(texts: list[bytes], size: int = CHUNK):
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i - begin >= 8000:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
