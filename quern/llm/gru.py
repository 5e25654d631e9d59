"""A bidirectional gated recurrent layer with attention pooling, forward and backward, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGruPool:
    """(batch, time, inputs) with a mask -> (batch, 2 * hidden).

    Attention weights are a softmax over the unmasked steps of a learned projection of the
    states; a row without steps pools to zero."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.h = hidden
        scale = lambda n: float(1 / np.sqrt(n))
        self.p = {
            "w": rng.standard_normal((inputs, 6 * hidden)).astype(np.float32) * scale(inputs),
            "b": np.zeros(6 * hidden, np.float32),
            "u0": rng.standard_normal((hidden, 3 * hidden)).astype(np.float32) * scale(hidden),
            "u1": rng.standard_normal((hidden, 3 * hidden)).astype(np.float32) * scale(hidden),
            "a": rng.standard_normal(2 * hidden).astype(np.float32) * scale(hidden),
        }

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates of both directions."""
        return x @ self.p["w"] + self.p["b"]

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, batch, 2 * hidden); gates: (time, batch, 6 * hidden), mask: (time, batch)."""
        t, n, _ = gates.shape
        h = self.h
        out = np.empty((t, n, 2 * h), np.float32)
        for way in (0, 1):
            u = self.p[f"u{way}"]
            s = np.zeros((n, h), np.float32)
            steps = []
            for k in range(t) if way == 0 else range(t - 1, -1, -1):
                g = gates[k, :, 3 * h * way : 3 * h * (way + 1)]
                su = s @ u
                rz = sigmoid(g[:, : 2 * h] + su[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * su[:, 2 * h :])
                new = (c + z * (s - c)) if keep is None and mask[k].all() else np.where(mask[k][:, None], c + z * (s - c), s)
                if keep is not None:
                    steps.append((k, s, r, z, c, su[:, 2 * h :]))
                s = new
                out[k, :, h * way : h * (way + 1)] = s
            if keep is not None:
                keep.append(steps)
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.where(mask, states @ self.p["a"], -np.inf)
        top = e.max(0)
        w = np.where(mask, np.exp(e - np.where(np.isfinite(top), top, 0)), 0)
        w /= np.maximum(w.sum(0), 1e-30)
        return np.einsum("tn,tnh->nh", w, states, optimize=True), w

    def forward(self, x: np.ndarray, mask: np.ndarray):
        keep: list = []
        states = self.states(self.gates(x), mask, keep)
        pooled, w = self.pool(states, mask)
        return pooled, (x, mask, states, pooled, w, keep)

    def backward(self, d: np.ndarray, cache) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x, mask, states, pooled, w, keep = cache
        h, t, n = self.h, *mask.shape
        de = w * np.einsum("nh,tnh->tn", d, states) - w * np.einsum("nh,nh->n", d, pooled)
        ds = w[:, :, None] * d[None] + de[:, :, None] * self.p["a"]
        grads = {"a": np.einsum("tn,tnh->h", de, states)}
        dg = np.zeros((t, n, 6 * h), np.float32)
        for way in (0, 1):
            u = self.p[f"u{way}"]
            du = np.zeros_like(u)
            carry = np.zeros((n, h), np.float32)
            for k, s, r, z, c, su in reversed(keep[way]):
                total = ds[k, :, h * way : h * (way + 1)] + carry
                live = np.where(mask[k][:, None], total, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (s - c) * z * (1 - z)
                dr = dc * su * r * (1 - r)
                dsu = np.concatenate((dr, dz, dc * r), axis=1)
                du += s.T @ dsu
                carry = (total - live) + live * z + dsu @ u.T
                dg[k, :, 3 * h * way : 3 * h * (way + 1)] = np.concatenate((dr, dz, dc), axis=1)
            grads[f"u{way}"] = du
        flat = dg.reshape(t * n, -1)
        grads["w"] = x.reshape(t * n, -1).T @ flat
        grads["b"] = flat.sum(0)
        return dg @ self.p["w"].T, grads
