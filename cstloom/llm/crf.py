"""A linear-chain conditional random field over hashed features, trained in numpy."""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 1 << 16


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) & (BUCKETS - 1) for n in names]


class Crf:
    """Weights of features by label and of label pairs; feature 0 of a padded token scores nothing."""

    def __init__(self, labels: int):
        self.w = np.zeros((BUCKETS + 1, labels), np.float64)
        self.t = np.zeros((labels, labels), np.float64)

    @staticmethod
    def _pad(batch: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(batch), max(map(len, batch))
        width = max(len(f) for s in batch for f in s)
        x = np.full((n, most, width), BUCKETS, np.int32)
        for i, s in enumerate(batch):
            for j, f in enumerate(s):
                x[i, j, : len(f)] = f
        return x, np.array([len(s) for s in batch])

    def fit(self, data: list[tuple[list[list[int]], list[int]]], epochs: int = 12, batch: int = 256, rate: float = 0.25, decay: float = 1e-5, seed: int = 5) -> Crf:
        """Adagrad on the conditional log-likelihood, in batches of sequences of like length."""
        rng = np.random.default_rng(seed)
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
        batches = []
        for at in range(0, len(order), batch):
            own = [data[i] for i in order[at : at + batch]]
            x, n = self._pad([d[0] for d in own])
            y = np.zeros(x.shape[:2], np.int64)
            for i, d in enumerate(own):
                y[i, : len(d[1])] = d[1]
            batches.append((x, n, y))
        k = self.t.shape[0]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                x, n, y = batches[b]
                m, length, width = x.shape
                live = np.arange(length)[None] < n[:, None]
                s = self.w[x].sum(2)
                alpha = np.zeros((m, length, k))
                beta = np.zeros((m, length, k))
                alpha[:, 0] = s[:, 0]
                for j in range(1, length):
                    a = _lse(alpha[:, j - 1, :, None] + self.t[None], 1) + s[:, j]
                    alpha[:, j] = np.where(live[:, j, None], a, alpha[:, j - 1])
                z = _lse(alpha[:, -1], 1)
                for j in range(length - 2, -1, -1):
                    c = _lse(self.t[None] + (s[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                    beta[:, j] = np.where(live[:, j + 1, None], c, 0.0)
                p = np.exp(alpha + beta - z[:, None, None])
                for j in range(1, length):  # a padded place repeats the last alpha and must not count
                    p[:, j] *= live[:, j, None]
                gold = np.eye(k)[y] * live[..., None]
                diff = (p - gold) / m
                g = np.stack([np.bincount(x.ravel(), np.repeat(diff[..., c].ravel(), width), BUCKETS + 1) for c in range(k)], 1)
                g[BUCKETS] = 0
                e = np.zeros((k, k))
                for j in range(1, length):
                    pair = np.exp(alpha[:, j - 1, :, None] + self.t[None] + (s[:, j] + beta[:, j])[:, None, :] - z[:, None, None])
                    e += (pair * live[:, j, None, None]).sum(0) / m
                    np.add.at(e, (y[live[:, j], j - 1], y[live[:, j], j]), -1.0 / m)
                g += decay * self.w
                gw += g * g
                gt += e * e
                self.w -= rate * g / np.sqrt(gw)
                self.t -= rate * e / np.sqrt(gt)
        return self

    def decode(self, batch: list[list[list[int]]]) -> list[list[int]]:
        """The likeliest labels of every sequence (Viterbi)."""
        out: list[list[int]] = [[] for _ in batch]
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for at in range(0, len(order), 512):
            own = [i for i in order[at : at + 512] if batch[i]]
            if not own:
                continue
            x, n = self._pad([batch[i] for i in own])
            s = self.w[x].sum(2)
            best, back = s[:, 0], np.zeros(s.shape, np.int64)
            last = best.copy()
            for j in range(1, s.shape[1]):
                c = best[:, :, None] + self.t[None]
                back[:, j] = c.argmax(1)
                best = c.max(1) + s[:, j]
                last = np.where((n > j)[:, None], best, last)
            y = last.argmax(1)
            for r, i in enumerate(own):
                lab, path = int(y[r]), []
                for j in range(int(n[r]) - 1, -1, -1):
                    path.append(lab)
                    lab = int(back[r, j, lab])
                out[i] = path[::-1]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)
