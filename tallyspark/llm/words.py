"""Word splitting shared by the text operators: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""

from __future__ import annotations

import numpy as np
import xxhash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _fold(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 32
    return byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20


_TABLE = bytes(map(_fold, range(256)))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none. One pass in C over the text's bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound so that memory stays flat on any corpus."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
