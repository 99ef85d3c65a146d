"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

The tokenizer drops white space and splits the rest by a fixed pattern before it looks
for tokens, so the ids of a text are those of its pieces one after another. Texts in
ASCII and Latin-1 letters are split by that pattern here; any other text is split at ASCII white
space only, and its parts go to the library as they are. Each new piece is encoded once by
the library. The pattern is that of word_bpe_49k.json; for another file, ids come from the library alone.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np

# The tokenizer's own split pattern, for the letters that it is used on here.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"[^\t-\r ]+")
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"

CACHED_PIECES = 600_000
GROUP_CHARS = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """Pieces by number, in the order of their first use; `new` has those not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of texts; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            head = file.read(20_000)
        self.by_piece = KNOWN_PATTERN.replace("\\", "\\\\") in head
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return PIECES.findall(text.lower())
        return PARTS.findall(text)

    def _learn(self, new: list[str]) -> None:
        """Encodes the pieces that were numbered last."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids)
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, first + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has."""
        # one look-up a piece: a new one gets its number by it
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)
        ids = self.ids[places]
        if len(self.numbers) > CACHED_PIECES:
            self.clear()
        return ids, ends

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if not self.by_piece:
            for text in texts:
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)
            return
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.pieces(text) for text in texts]
        ids, ends = self._joined([piece for pieces in split for piece in pieces])
        ends = np.concatenate([[0], ends])
        last = np.cumsum([0, *map(len, split)])
        for first, after in zip(last, last[1:]):
            yield ids[ends[first] : ends[after]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
