"""Vectorised views of texts as bytes: bounded buffers of whole documents, tokens and their hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACE, WORD, MARK = 0, 1, 2
# Odd multiplier of the polynomial hash modulo 2**64, and a mixer for its weak low bits.
RADIX = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xD6E8FEB86659FD93)


def _classes() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[:33] = SPACE
    kinds[127:] = WORD
    for first, last in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
        kinds[first[0] : last[0] + 1] = WORD
    return kinds


CLASS = _classes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> list[np.ndarray]:
    """The first `count` powers of the radix and of its inverse."""
    if len(_powers[0]) < count:
        inverse = pow(int(RADIX), -1, 1 << 64)
        with np.errstate(over="ignore"):
            for i, base in enumerate((RADIX, np.uint64(inverse))):
                steps = np.full(count, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers


def buffers(texts: Iterable[str | None], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, documents): buffers of about `limit` bytes at most, each document ended by line breaks.

    A longer text goes on in the next buffer, cut after white space where there is any
    in the last kilobyte; `documents` holds the index of the document of each start.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        body = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            piece = body[at : at + limit]
            if at + limit < len(body):
                near = max(piece.rfind(b" ", limit - 1024), piece.rfind(b"\n", limit - 1024))
                piece = piece[: near + 1] if near > 0 else piece
            if parts and size + len(piece) > limit:
                yield _joined(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(piece + b"\n\n\n\n")
            owners.append(number)
            size += len(piece)
            at += len(piece)
            if at >= len(body):
                break
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(parts), np.uint8), starts, np.asarray(owners)


def tokens(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, class, hash) of the runs of word characters and of marks."""
    kinds = CLASS[buffer]
    cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(buffer)]])
    wanted = kinds[starts] != SPACE
    starts, ends = starts[wanted], ends[wanted]
    up, down = powers(len(buffer) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)])])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return starts, ends - starts, kinds[starts], hashes


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(32))) * MIXER
        return values ^ (values >> np.uint64(29))
