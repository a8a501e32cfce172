"""FTRL-proximal logistic regression on sparse binary features (numpy)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate learning rates with L1 and L2 penalties.

    Binary features: an example is the array of its distinct feature indices.
    The bias is kept apart and carries no penalty.
    """

    def __init__(self, bits: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << bits, np.float64)
        self.n = np.zeros(1 << bits, np.float64)
        self.zb = self.nb = 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha))

    def update(self, x: np.ndarray, y: int) -> float:
        z, n = self.z[x], self.n[x]
        w, b = self._weights(z, n), self.bias()
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        g2 = g * g
        self.z[x] = z + g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[x] = n + g2
        self.zb += g - (np.sqrt(self.nb + g2) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += g2
        return p

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the weights that are not zero."""
        live = np.flatnonzero(np.abs(self.z) > self.l1)
        return live.astype(np.int64), self._weights(self.z[live], self.n[live])
