"""Forward-backward over many chains at once, for conditional random fields.

All chains of a batch lie one after the other. Position t has positive emission scores
and a transition matrix, by index into a stack; the first position of a chain uses a
matrix whose rows are all the start distribution, which makes it forget what lies
before. The product of the matrices is associative, so the positions are cut into
blocks: products of whole blocks first, then a short pass over the blocks, then all
blocks side by side. The result is exact and the work linear in the positions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


def posteriors(emission: np.ndarray, index: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities per position, and the normalised forward and backward scores.

    ``transitions[index[t]]`` leads from position t - 1 to t. Matrix 0 must have equal
    rows; it also fills the last block.
    """
    n, k = emission.shape
    blocks = -(-n // BLOCK)
    e = np.ones((blocks * BLOCK, k))
    e[:n] = emission
    g = np.zeros(blocks * BLOCK, np.int64)
    g[:n] = index
    e = np.ascontiguousarray(e.reshape(blocks, BLOCK, k).transpose(1, 0, 2))
    g = np.ascontiguousarray(g.reshape(blocks, BLOCK).T)
    product = transitions[g[0]] * e[0][:, None, :]
    for t in range(1, BLOCK):
        product = np.matmul(product, transitions[g[t]]) * e[t][:, None, :]
        product /= product.sum((1, 2), keepdims=True)
    before = np.empty((blocks, k))  # forward scores at the end of the block before
    state = np.full(k, 1.0 / k)
    for b in range(blocks):
        before[b] = state
        state = state @ product[b]
        state /= state.sum()
    after = np.empty((blocks, k))  # backward scores at the last position of the block
    state = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        after[b] = state
        state = product[b] @ state
        state /= state.sum()
    forward, backward = np.empty_like(e), np.empty_like(e)
    state = before
    for t in range(BLOCK):
        state = np.matmul(state[:, None, :], transitions[g[t]])[:, 0, :] * e[t]
        state /= state.sum(1, keepdims=True)
        forward[t] = state
    state = after
    for t in range(BLOCK - 1, -1, -1):
        backward[t] = state
        state = np.matmul(transitions[g[t]], (e[t] * state)[:, :, None])[:, :, 0]
        state /= state.sum(1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    forward, backward = flat(forward), flat(backward)
    joint = forward * backward
    return joint / joint.sum(1, keepdims=True), forward, backward


def pair_counts(
    emission: np.ndarray, index: np.ndarray, transitions: np.ndarray, forward: np.ndarray, backward: np.ndarray
) -> np.ndarray:
    """Expected number of each transition, per matrix of the stack (matrix 0 left out)."""
    out = np.zeros_like(transitions)
    right = emission * backward
    for g in range(1, len(transitions)):
        at = np.flatnonzero(index == g)
        if len(at):
            joint = forward[at - 1][:, :, None] * transitions[g] * right[at][:, None, :]
            out[g] = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return out


def scaled(scores: np.ndarray) -> np.ndarray:
    """Positive emissions of log scores; the largest of a position is 1."""
    return np.maximum(np.exp(scores - scores.max(1, keepdims=True)), 1e-12)


class Adam:
    """Full-batch gradient ascent with per-weight steps."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)

    def ascend(self, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9**self.step), self.square / (1 - 0.99**self.step)
        self.weights += self.rate * mean / (np.sqrt(square) + 1e-8)


def sum_rows(weights: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each item's weight rows; ``rows`` holds the items' rows one after the
    other and every item has at least one."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.add.reduceat(weights[rows], starts, axis=0)
