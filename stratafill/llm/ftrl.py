"""Follow-the-regularised-leader (FTRL-proximal) with an elastic net, for sparse rows."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape (features, outputs); the L1 part keeps most at exactly zero."""

    def __init__(self, weights: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.n = np.zeros_like(weights)
        # the state that the closed form of ``weights`` maps to the given ones
        self.z = -weights * (beta / alpha + l2) - np.sign(weights) * l1

    def weights(self, held) -> np.ndarray:
        z, n = self.z[held], self.n[held]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, held: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        """Follow a gradient at the features ``held``, whose weights are ``w`` now."""
        n = self.n[held]
        grown = n + gradient * gradient
        self.z[held] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[held] = grown
