"""Butterworth filters in second-order sections."""
import cmath
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Sections:
    """Cascade of biquads, rows b0 b1 b2 1 a1 a2."""
    rows: tuple[tuple[float, ...], ...]

    @property
    def gain(self) -> float:
        """Response to a constant."""
        return math.prod(sum(r[:3]) / sum(r[3:]) for r in self.rows)

    @property
    def reach(self) -> int:
        """Samples after which an impulse has decayed below double precision."""
        radius = max(max(abs(np.roots([1.0, r[4], r[5]]))) for r in self.rows)
        return math.ceil((50 + 4 * len(self.rows)) / -math.log(radius)) if radius > 0 else 4

    @property
    def pad(self) -> int:
        """Rows of odd extension at a line's end: three times the filter length."""
        first_order = min(sum(r[2] == 0 for r in self.rows), sum(r[5] == 0 for r in self.rows))
        return 3 * (2 * len(self.rows) + 1 - first_order)

    @property
    def shortest(self) -> int:
        """Lines of up to this many rows are left as they are."""
        return max(6 * len(self.rows), self.pad)

    def recurse(self, x: np.ndarray, state=None):
        """Sample-by-sample cascade; returns the output and the closing state."""
        out = [float(v) for v in x]
        closing = []
        for k, (b0, b1, b2, _, a1, a2) in enumerate(self.rows):
            s1, s2 = (float(v) for v in state[k]) if state is not None else (0.0, 0.0)
            for i, v in enumerate(out):
                y = b0 * v + s1
                s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
                out[i] = y
            closing.append((s1, s2))
        return np.array(out), closing


def butterworth(pass1: float = 0.1, pass2: float = 0.9, fs: float = 10.0, order: int = 4) -> Sections:
    """Band-pass between two frequencies; low-pass if only the second is inside
    (0, fs/2), high-pass if only the first is."""
    low, high = 0 < pass1 < fs / 2, 0 < pass2 < fs / 2
    if not (low or high):
        raise ValueError(f"pass frequencies {pass1}, {pass2} are invalid for rate {fs}")
    if low and high and pass1 >= pass2:
        raise ValueError("the band's lower edge must lie below its upper edge")
    warp = lambda f: 2 * fs * math.tan(math.pi * f / fs)
    proto = [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    if low and high:
        width, centre = warp(pass2) - warp(pass1), math.sqrt(warp(pass1) * warp(pass2))
        poles = [p * width / 2 + s * cmath.sqrt((p * width / 2) ** 2 - centre ** 2)
                 for p in proto for s in (1, -1)]
        zeros, unity = [1.0, -1.0] * order, cmath.exp(2j * math.atan(centre / (2 * fs)))
    elif high:
        poles, zeros, unity = [p * warp(pass2) for p in proto], [-1.0] * order, 1.0
    else:
        poles, zeros, unity = [warp(pass1) / p for p in proto], [1.0] * order, -1.0
    poles = [(2 * fs + p) / (2 * fs - p) for p in poles]
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = [p.real for p in poles if abs(p.imag) <= 1e-12]
    rows = []
    for p in upper:
        pair = (1.0, -1.0) if low and high else (zeros[0], zeros[0])
        rows.append([1.0, -sum(pair), pair[0] * pair[1], 1.0, -2 * p.real, abs(p) ** 2])
    while real:
        if low and high:
            a, b = real.pop(), real.pop()
            rows.append([1.0, 0.0, -1.0, 1.0, -(a + b), a * b])
        else:
            rows.append([1.0, -zeros[0], 0.0, 1.0, -real.pop(), 0.0])
    for r in rows:
        z = unity
        size = abs((r[0] * z * z + r[1] * z + r[2]) / (r[3] * z * z + r[4] * z + r[5]))
        r[:3] = [c / size for c in r[:3]]
    return Sections(tuple(tuple(float(c) for c in r) for r in rows))
