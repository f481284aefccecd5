"""Drift detectors over a 0/1 error stream: DDM (Gama et al. 2004) and ADWIN (Bifet & Gavalda 2007)."""

from __future__ import annotations

import math

import numpy as np

# Defaults of the published detectors as commonly implemented.
DDM_MIN_ROWS = 30
DDM_CHANGE_LEVEL = 3.0
ADWIN_DELTA = 0.002
ADWIN_BUCKETS = 5
ADWIN_CLOCK = 32
ADWIN_MIN_WIDTH = 10
ADWIN_MIN_PART = 5
NORMAL, WARNING, CHANGE = 0, 1, 2


class Ddm:
    def __init__(self, warning: float = 2.0, change: float = DDM_CHANGE_LEVEL, min_rows: int = DDM_MIN_ROWS):
        self.warning, self.change, self.min_rows = warning, change, min_rows
        self._reset()

    def _reset(self) -> None:
        self.n, self.errors, self.best, self.p_min, self.s_min = 0, 0.0, math.inf, math.inf, math.inf
        self.restart = False

    def process(self, errors: np.ndarray) -> np.ndarray:
        """State per row: 0 in control, 1 warning, 2 change (the row after it starts afresh)."""
        out = np.zeros(len(errors), dtype=np.int32)
        for i, e in enumerate(np.asarray(errors, dtype=float).tolist()):
            if self.restart:
                self._reset()
            self.n += 1
            self.errors += e
            p = self.errors / self.n
            s = math.sqrt(p * (1 - p) / self.n)
            if self.n + 1 < self.min_rows:
                continue
            if p + s <= self.best:
                self.best, self.p_min, self.s_min = p + s, p, s
            if self.n + 1 > self.min_rows and p + s > self.p_min + self.change * self.s_min:
                out[i], self.restart = CHANGE, True
            elif p + s > self.p_min + self.warning * self.s_min:
                out[i] = WARNING
        return out


class Adwin:
    """Adaptive window kept as exponential buckets: row r holds buckets of 2**r values."""

    def __init__(self, delta: float = ADWIN_DELTA):
        self.delta = delta
        self.rows: list[list[tuple[float, float]]] = [[]]  # per row, oldest first: (sum, variance sum)
        self.width, self.total, self.var, self.clock = 0, 0.0, 0.0, 0

    def _insert(self, x: float) -> None:
        if self.width > 0:
            mean = self.total / self.width
            self.var += self.width * (x - mean) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        r = 0
        while len(self.rows[r]) > ADWIN_BUCKETS:
            if r + 1 == len(self.rows):
                self.rows.append([])
            (s1, v1), (s2, v2) = self.rows[r][0], self.rows[r][1]
            n = 2**r
            self.rows[r] = self.rows[r][2:]
            self.rows[r + 1].append((s1 + s2, v1 + v2 + n * n * (s1 / n - s2 / n) ** 2 / (2 * n)))
            r += 1

    def _drop_oldest(self) -> None:
        r = len(self.rows) - 1
        s, v = self.rows[r].pop(0)
        n = 2**r
        self.width -= n
        self.total -= s
        if self.width > 0:
            mean = self.total / self.width
            self.var -= v + n * self.width * (s / n - mean) ** 2 / (n + self.width)
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()

    def _cut_found(self) -> bool:
        n0, s0 = 0, 0.0
        var = self.var / self.width
        log_term = math.log(2 * math.log(self.width) / self.delta)
        for r in range(len(self.rows) - 1, -1, -1):
            for s, _ in self.rows[r]:
                n0 += 2**r
                s0 += s
                n1 = self.width - n0
                if n1 < ADWIN_MIN_PART + 1:
                    return False
                if n0 < ADWIN_MIN_PART + 1:
                    continue
                m = 1 / (n0 - ADWIN_MIN_PART + 1) + 1 / (n1 - ADWIN_MIN_PART + 1)
                eps = math.sqrt(2 * m * max(var, 0.0) * log_term) + 2 / 3 * log_term * m
                if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                    return True
        return False

    def add(self, x: float) -> bool:
        """True when the window shrank and its mean rose."""
        before = self.total / self.width if self.width else 0.0
        self._insert(x)
        self.clock += 1
        shrank = False
        if self.clock % ADWIN_CLOCK == 0 and self.width > ADWIN_MIN_WIDTH:
            while self.width > ADWIN_MIN_WIDTH and self._cut_found():
                self._drop_oldest()
                shrank = True
        return shrank and self.total / self.width > before

    def process(self, errors: np.ndarray) -> np.ndarray:
        return np.array([CHANGE if self.add(e) else NORMAL for e in np.asarray(errors, dtype=float).tolist()], dtype=np.int32)
