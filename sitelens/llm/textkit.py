"""Vectorised words, word hashes and n-gram hashes of batches of whole texts (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE * 2)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                steps = np.full(size, U(base), U)
                steps[0] = U(1)
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slices(texts: Sequence[str | None], limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, past, bytes, bounds)`` over runs of texts of about ``limit`` bytes.

    Texts are lower-cased; each is followed by one newline, so nothing spans two of them. A null
    counts as empty. A text longer than the limit is a run of its own, never cut.
    """
    first, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace") if t else b""
        parts.append(raw)
        size += len(raw) + 1
        if size >= limit:
            yield _joined(first, i + 1, parts)
            first, parts, size = i + 1, [], 0
    if parts:
        yield _joined(first, len(texts), parts)


def _joined(first: int, past: int, parts: list[bytes]) -> tuple[int, int, np.ndarray, np.ndarray]:
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return first, past, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), bounds


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters and digits and of all bytes from 128 on."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _WORD[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each span, for several lists of spans."""
    up, down = _power(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
        return [mix((total[e] - total[s]) * down[s]) for s, e in spans]


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, per text, the range of its words."""
    starts, ends = word_spans(buf)
    (hashes,) = span_hashes(buf, (starts, ends))
    return hashes, np.searchsorted(starts, bounds)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each text, and the range of each text's runs.

    A text of fewer words than ``n``, but at least one, has one run: all its words.
    """
    lengths = np.diff(bounds)
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out_bounds[1:])
    factors = mix(np.arange(1, n + 1, dtype=U))
    padded = np.concatenate([hashes, np.zeros(n, U)])
    out = np.empty(out_bounds[-1], U)
    with np.errstate(over="ignore"):
        every = np.zeros(len(hashes), U)
        for k in range(n):
            every += padded[k : k + len(hashes)] * factors[k]
        every = mix(every)
        keep = np.zeros(len(hashes) + 1, bool)
        position = np.arange(len(hashes), dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keep[:-1] = position + n <= bounds[1:][owner] if len(hashes) else False
        short = np.flatnonzero((lengths > 0) & (lengths < n))
        if len(short):
            for d in short:
                h = hashes[bounds[d] : bounds[d + 1]]
                every[bounds[d]] = mix(np.array([(h * factors[: len(h)]).sum() + U(len(h))], U))[0]
                keep[bounds[d]] = True
                keep[bounds[d] + 1 : bounds[d + 1]] = False
    out[:] = every[keep[:-1]]
    return out, out_bounds
