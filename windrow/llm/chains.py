"""Scaled forward and backward recursions over many chains at once.

Chains of a batch are ordered by length, and step t handles the t-th symbol of all chains that have one, so that each
step is a few matrix operations on rows that lie together. Every step is rescaled to sum 1; the logs of the scales add
up to the exact log-likelihood, at any length.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from windrow.llm.common import offsets, run_sums


class Chains:
    """The step-by-step layout of chains that lie one after another in a flat array."""

    def __init__(self, at: np.ndarray) -> None:
        lengths = np.diff(at)
        starts = at[:-1][np.argsort(-lengths, kind="stable")]
        longest = int(lengths.max(initial=0))
        active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.at, self.total = at, int(at[-1])
        #: Where each step begins in the arrays by step, and the places of those in the flat array.
        self.steps = offsets(active)
        self.place = starts[np.arange(self.total) - np.repeat(self.steps[:-1], active)] + np.repeat(np.arange(longest), active)

    def flat(self, by_step: np.ndarray) -> np.ndarray:
        out = np.empty_like(by_step)
        out[self.place] = by_step
        return out

    def forward(self, symbols: np.ndarray, emit: np.ndarray, step: np.ndarray, first: np.ndarray, keep: bool) -> None:
        """emit: a row of potentials for each symbol. Leaves scales and symbols (and alphas if kept) in the order by step."""
        self.symbols = symbols[self.place]
        self.scales = np.empty(self.total, emit.dtype)
        step, first, ones = step.astype(emit.dtype), first.astype(emit.dtype), np.ones(len(first), emit.dtype)
        widest = int(self.steps[1]) if len(self.steps) > 1 else 0
        self.alphas = np.empty((self.total if keep else 0, len(first)), emit.dtype)
        spare = [np.empty((widest, len(first)), emit.dtype) for _ in range(2)]
        alpha = spare[1]
        for t, (a, b) in enumerate(pairwise(self.steps.tolist())):
            now = self.alphas[a:b] if keep else spare[t % 2][: b - a]
            if t:
                np.matmul(alpha[: b - a], step, out=now)
                now *= emit.take(self.symbols[a:b], axis=0)
            else:
                np.multiply(emit.take(self.symbols[a:b], axis=0), first, out=now)
            scale = np.matmul(now, ones, out=self.scales[a:b])
            now /= scale[:, None]
            alpha = now

    def backward(self, emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the states in the order by step, and the expected transitions. Takes the place of the alphas."""
        k = step.shape[0]
        step = step.astype(emit.dtype)
        moves = np.zeros((k, k))
        beta = np.ones((int(self.steps[1]) if len(self.steps) > 1 else 0, k), emit.dtype)
        bounds = list(pairwise(self.steps.tolist()))
        for t in range(len(bounds) - 1, -1, -1):
            a, b = bounds[t]
            if t + 1 < len(bounds):
                c, d = bounds[t + 1]
                right = emit.take(self.symbols[c:d], axis=0)
                right *= beta[: d - c]
                right /= self.scales[c:d, None]
                moves += self.alphas[a : a + d - c].T @ right
                np.matmul(right, step.T, out=beta[: d - c])
            self.alphas[a:b] *= beta[: b - a]
        return self.alphas, moves * step

    def log_likelihoods(self) -> np.ndarray:
        """Natural logs, one a chain, in the order of the chains."""
        return run_sums(self.flat(np.log(self.scales.astype(np.float64))), self.at)
