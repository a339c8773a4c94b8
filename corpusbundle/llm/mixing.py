"""The numbers of logistic context mixing: bit predictors, gated mixer, adaptive refinement.

A token is coded as its bytes and a closing byte, each byte as eight binary decisions.
Every decision is predicted from five contexts inside the token; the predictions are
mixed in the logistic domain with weights chosen by a gate, and the result is refined by
an adaptive map. Nothing here knows of Spark; tasks call it on the tokens they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from corpusbundle.llm.spans import mixed, ragged

#: Slots of each predictor's table: no context, one byte, two bytes, three bytes, the whole token so far.
SLOTS = (1 << 8, 1 << 16, 1 << 19, 1 << 20, 1 << 22)
BASES = tuple(int(x) for x in np.cumsum((0, *SLOTS))[:-1])
TOTAL = sum(SLOTS)

#: What stands for a bit that was never seen in a context.
PRIOR = 0.05

#: Gate: place in the token (up to 7) and how much the longest context has seen (12 levels).
PLACES, LEVELS = 8, 12
GATES = PLACES * LEVELS
INPUTS = len(SLOTS) + 1

#: Refinement: by the bits of the byte so far, between support points of the logistic domain.
POINTS = 33
RANGE = 12.0

#: Closing bytes of a word and of a text.
WORD_END, TEXT_END = 0x20, 0x0A

#: Tokens worked on at once.
CHUNK = 1 << 14


def coded(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens with their closing byte, where each token begins); the empty token ends a text."""
    data = b"".join(t + b" " if t else b"\n" for t in tokens)
    n = np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(n)])


def _contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(place in the token, hash of each hashed context) of each byte."""
    n = np.diff(at)
    place = ragged(np.zeros(len(n), np.int64), n)
    before = np.zeros((3, len(data)), np.uint64)
    for k in range(3):
        before[k, k + 1 :] = data[: len(data) - k - 1]
        before[k, place <= k] = 1
    two = before[0] | before[1] << np.uint64(8) | np.uint64(1 << 24)
    three = before[0] | before[1] << np.uint64(8) | before[2] << np.uint64(16) | np.uint64(1 << 25)
    # The bytes of the token before this one, as a polynomial that starts afresh with each token.
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    step = np.full(len(data) + 1, base, dtype=np.uint64)
    step[0] = 1
    powers = np.cumprod(step, dtype=np.uint64)
    step[1:] = inverse
    unpowers = np.cumprod(step, dtype=np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
    begin = np.repeat(at[:-1], n)
    whole = (total[:-1] - total[begin]) * unpowers[begin]
    return place, [before[0], mixed(two), mixed(three), mixed(whole + np.uint64(7))]


def _decisions(data: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each of the eight decisions of all bytes: the bits so far, the bit, each predictor's slot."""
    wide = data.astype(np.uint64)
    for k in range(8):
        node = np.uint64(1 << k) | wide >> np.uint64(8 - k)
        bit = (wide >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        slots = [node.astype(np.int64), (contexts[0] << np.uint64(8) | node).astype(np.int64) + BASES[1]]
        for i in (2, 3, 4):
            h = (contexts[i - 1] + node * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
            slots.append((h >> np.uint64(64 - SLOTS[i].bit_length() + 1)).astype(np.int64) + BASES[i])
        yield node.astype(np.int64), bit, slots


def count_bits(tokens: list[bytes], weights: np.ndarray, into: np.ndarray) -> None:
    """Add each decision of each token to the table of (zeros, ones) per slot."""
    for i in range(0, len(tokens), CHUNK):
        data, at = coded(tokens[i : i + CHUNK])
        weight = np.repeat(weights[i : i + CHUNK], np.diff(at)).astype(np.float64)
        _, contexts = _contexts(data, at)
        for _, bit, slots in _decisions(data, contexts):
            for slot in slots:
                np.add.at(into, 2 * slot + bit, weight)


@dataclass
class Mixer:
    """Weights by gate, and the counts (zeros, ones) of the refinement."""

    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        weights = np.full((GATES, INPUTS), 0.3)
        weights[:, -1] = 0.0
        centre = 1 / (1 + np.exp(-np.linspace(-RANGE, RANGE, POINTS)))
        refined = np.empty((256, POINTS, 2))
        refined[:, :, 0], refined[:, :, 1] = 20 * (1 - centre), 20 * centre
        return cls(weights, refined)


def _inputs(table: np.ndarray, slots: list[np.ndarray], leave: np.ndarray | None, bit: np.ndarray):
    """(predictions in the logistic domain, how often the longest context was seen).

    With ``leave`` one occurrence of the token itself is taken out of the counts, so that
    weights are learned on what the other occurrences predict.
    """
    out = np.empty((len(bit), INPUTS), np.float32)
    counts = table.view(np.complex64)
    one = bit.astype(np.float32)
    for i, slot in enumerate(slots):
        both = counts[slot]
        zeros, ones = both.real, both.imag
        if leave is not None:
            ones, zeros = np.maximum(ones - one, 0), np.maximum(zeros - (1 - one), 0)
        out[:, i] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
    out[:, -1] = 1.0
    return out, zeros + ones


def _mixed(mixer: Mixer, inputs: np.ndarray, seen: np.ndarray, place: np.ndarray):
    level = np.minimum(np.log2(seen + np.float32(1)).astype(np.int64), LEVELS - 1)
    gate = np.minimum(place, PLACES - 1) * LEVELS + level
    x = np.clip(np.einsum("ij,ij->i", inputs, mixer.weights[gate]), -RANGE + 1e-6, RANGE - 1e-6)
    return gate, x


def _support(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower support point, share of the upper one)."""
    at = (x + RANGE) * ((POINTS - 1) / (2 * RANGE))
    low = at.astype(np.int64)
    return low, at - low


def _refined(mixer: Mixer, node: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    low, high = _support(x)
    ones = (mixer.refined[:, :, 1] / mixer.refined.sum(axis=2)).ravel()
    at = node * POINTS + low
    return 0.5 * ((1 - high) * ones[at] + high * ones[at + 1]) + 0.5 / (1 + np.exp(-x))


def learn(mixer: Mixer, table: np.ndarray, tokens: list[bytes], weights: np.ndarray, rate: float = 0.5) -> None:
    """One pass of online learning: each chunk is predicted, then weights and refinement move."""
    for i in range(0, len(tokens), CHUNK // 8):
        part = slice(i, i + CHUNK // 8)
        data, at = coded(tokens[part])
        weight = np.repeat(weights[part], np.diff(at)).astype(np.float64)
        place, contexts = _contexts(data, at)
        for node, bit, slots in _decisions(data, contexts):
            inputs, seen = _inputs(table, slots, weight, bit)
            gate, x = _mixed(mixer, inputs, seen, place)
            error = weight * (bit - 1 / (1 + np.exp(-x)))
            moved = np.zeros((GATES, INPUTS))
            for j in range(INPUTS):
                moved[:, j] = np.bincount(gate, error * inputs[:, j], minlength=GATES)
            scale = np.bincount(gate, weight * np.einsum("ij,ij->i", inputs, inputs), minlength=GATES)
            mixer.weights += rate * INPUTS * moved / (scale[:, None] + 1.0)
            low, high = _support(x)
            np.add.at(mixer.refined, (node, low, bit), weight * (1 - high))
            np.add.at(mixer.refined, (node, low + 1, bit), weight * high)


def log10_probabilities(mixer: Mixer, table: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """log10 of each token's probability."""
    found = [np.zeros(0)]
    for i in range(0, len(tokens), CHUNK):
        data, at = coded(tokens[i : i + CHUNK])
        place, contexts = _contexts(data, at)
        total = np.zeros(len(data))
        for node, bit, slots in _decisions(data, contexts):
            inputs, seen = _inputs(table, slots, None, bit)
            _, x = _mixed(mixer, inputs, seen, place)
            one = _refined(mixer, node, x)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        found.append(np.add.reduceat(total, at[:-1]))
    return np.concatenate(found)
