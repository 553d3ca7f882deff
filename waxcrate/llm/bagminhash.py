"""BagMinHash signatures: an unbiased estimate of weighted Jaccard similarity.

Each element carries a Poisson process over (weight, time), the same in every document; a document sees the points whose weight
lies under the element's, and each register keeps its earliest point. Weights are discretised into whole numbers, and their axis
into the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on. An interval's process has its length as its rate, so an element of
weight w has about log2(w) processes; the place of a point in the last, cut interval tells whether it lies under w. All
processes of many documents advance together, and stop when they pass their document's latest register.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

REGISTERS = 125
#: Probability at most with which two documents just as similar as the threshold share no band, or agree in too few registers.
MISS = 1e-4


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """The times of the registers (float64, infinite for an empty set), one row for each set of (element, whole weight)."""
    out = np.full((len(sets), registers), np.inf)
    if not sets:
        return out
    sizes = np.array([len(s[0]) for s in sets])
    element = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(np.int64)
    document = np.repeat(np.arange(len(sets)), sizes)
    # One process for each interval that begins under the weight.
    intervals = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    intervals[weight < 1] = 0
    which = np.repeat(np.arange(len(element)), intervals)
    level = np.arange(len(which)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.where(level == 0, 1, low)
    with np.errstate(over="ignore"):
        state = mixed(element[which] + np.uint64(0x632BE59BD9B4E019) * (level.astype(np.uint64) + np.uint64(1)))
    document, weight = document[which], weight[which]
    time, rate = np.zeros(len(which)), (registers * length).astype(float)
    flat, latest = out.reshape(-1), out.max(axis=1)
    scale = 1 / 2.0**53
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(state):
        with np.errstate(over="ignore"):
            state = state + step
            a, b = mixed(state), mixed(state ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 1) * scale) / rate
        register = ((b >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        seen = time < latest[document]
        cut = low + length > weight
        under = seen if not cut.any() else seen & (~cut | (low + ((b & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32 * length).astype(np.int64) < weight))
        at = document[under] * registers + register[under]
        np.minimum.at(flat, at, time[under])
        touched = np.unique(document[under])
        latest[touched] = out[touched].max(axis=1)
        going = time < latest[document]
        state, document, weight, time, rate, low, length = (x[going] for x in (state, document, weight, time, rate, low, length))
    return out


def band_rows(threshold: float, registers: int = REGISTERS) -> int:
    """Registers of a band: as many as keep the probability of sharing no band, (1 - threshold^rows)^(registers // rows), under MISS.

    5 (25 bands) for 0.8, 2 for 0.5, 7 for 0.9.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and 1 at most")
    return max(r for r in range(1, registers + 1) if r == 1 or (1 - threshold**r) ** (registers // r) <= MISS)


def least_agreeing(threshold: float, registers: int = REGISTERS) -> int:
    """Registers in which two documents at least as similar as the threshold agree, but for one pair in 10^7: the mean less 5.5 deviations."""
    return max(1, int(registers * threshold - 5.5 * (registers * threshold * (1 - threshold)) ** 0.5))


def bands(times: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of rows registers of each row of times; keys of different bands differ. Registers left over are in no band."""
    count = times.shape[1] // rows
    bits = mixed(np.ascontiguousarray(times[:, : count * rows]).view(np.uint64)).reshape(len(times), count, rows)
    with np.errstate(over="ignore"):
        key = np.zeros((len(times), count), np.uint64) + np.arange(1, count + 1, dtype=np.uint64)
        for k in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view(np.int64)


def marks(times: np.ndarray) -> np.ndarray:
    """One byte for each register: equal times have equal bytes, different ones in 1 of 256 cases."""
    return (mixed(times.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
