"""The numerics of smooth-overlap descriptors, for batches of neighbours (numpy, inside tasks)."""

from __future__ import annotations

import math

import numpy as np

#: A Gaussian counts as 0 beyond so many widths; distances up to NEAR as 0.
WIDTHS, NEAR = 5, 1e-5
#: Intervals of a radial table for each width of the Gaussians, and the order of its polynomials: what they are off by is near rounding.
INTERVALS, ORDER = 128, 5


def legendre(lmax: int, x: np.ndarray) -> np.ndarray:
    """Associated Legendre functions in the normalisation of spherical harmonics, with the Condon-Shortley sign.

    Shape (l, m, ...), 0 for m > l, by the stable recursion upwards in l.
    """
    x = np.asarray(x, float)
    out = np.zeros((lmax + 1, lmax + 1, *x.shape))
    sine = np.sqrt(np.maximum(0.0, 1 - x * x))
    diagonal = np.full(x.shape, math.sqrt(1 / (4 * math.pi)))
    for m in range(lmax + 1):
        if m:
            diagonal = -diagonal * sine * math.sqrt((2 * m + 1) / (2 * m))
        out[m, m] = diagonal
        for l in range(m + 1, lmax + 1):  # noqa: E741
            f = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            below = out[l - 2, m] if l - 2 >= m else 0.0
            g = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1)) if l - 2 >= m else 0.0
            out[l, m] = f * (x * out[l - 1, m] - g * below)
    return out


def radial_overlap(lmax: int, r: np.ndarray, rij: np.ndarray, sigma: float, *, widths: float = WIDTHS) -> np.ndarray:
    """r times a Gaussian of width sigma about distance rij, times the modified spherical Bessel functions up to lmax.

    ``r`` and ``rij`` broadcast; shape (l, ...). Ratios of neighbouring orders come from a
    continued fraction taken from high orders down, which is stable where recursion upwards is
    not; the order 0 has a form without cancellation. 0 beyond ``widths`` (five) widths, and for r near 0.
    """
    r, rij = np.broadcast_arrays(np.asarray(r, float), np.asarray(rij, float))
    near = rij <= NEAR
    z = np.where(near, 1.0, r * rij / sigma**2)
    first = np.where(
        near,
        r * np.exp(-(r**2) / (2 * sigma**2)),
        r * np.exp(-((r - rij) ** 2) / (2 * sigma**2)) * -np.expm1(-2 * z) / (2 * np.maximum(z, 1e-300)),
    )
    out = np.zeros((lmax + 1, *r.shape))
    out[0] = np.where((r <= NEAR) | (np.abs(r - rij) >= widths * sigma), 0.0, first)
    start = lmax + 30 + int(math.sqrt(60 * max(float(z.max(initial=1.0)), 1.0)))
    ratio, ratios = np.zeros(r.shape), []
    for l in range(start, 0, -1):  # i_l / i_(l-1)  # noqa: E741
        ratio = 1 / ((2 * l + 1) / np.maximum(z, 1e-300) + ratio)
        if l <= lmax:
            ratios.append(ratio)
    for l, ratio in enumerate(reversed(ratios), 1):  # noqa: E741
        out[l] = np.where(near, 0.0, out[l - 1] * ratio)
    return out


def radial_grid(nmax: int, rc: float) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on [0, rc]."""
    x, w = np.polynomial.legendre.leggauss(nmax)
    return rc * (x + 1) / 2, rc * w / 2


def _factors(d: np.ndarray, weight: np.ndarray, *, nmax: int, lmax: int, rc: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Radial parts (l, n, k) and weighted angular parts (l, m, k) of the neighbours at displacements ``d`` (k, 3)."""
    points, w = radial_grid(nmax, rc + 3 * sigma)
    r = np.sqrt((d**2).sum(axis=1))
    cosine = np.where(r == 0, 0.0, d[:, 2] / np.where(r == 0, 1.0, r))
    angle = np.arctan2(d[:, 1], d[:, 0])
    g = radial_overlap(lmax, points[:, None], r[None, :], sigma) * np.sqrt(w)[None, :, None]
    m = np.arange(lmax + 1)
    phase = np.exp(1j * m[:, None] * angle[None, :]) * np.where(m == 0, 1.0, math.sqrt(2))[:, None] * weight[None, :]
    return g, legendre(lmax, cosine) * phase


def density(d: np.ndarray, weight: np.ndarray, *, nmax: int, lmax: int, rc: float, sigma: float) -> np.ndarray:
    """Expansion coefficients (n, l, m >= 0) of the weighted neighbours at displacements ``d`` (k, 3), summed.

    Points reach three widths beyond the cutoff. m >= 1 counts twice, so it has a factor sqrt(2).
    """
    return np.einsum("lnk,lmk->nlm", *_factors(d, weight, nmax=nmax, lmax=lmax, rc=rc, sigma=sigma), optimize=True)


def radial_table(*, nmax: int, lmax: int, rc: float, sigma: float) -> np.ndarray:
    """Values (node, l, n) of the weighted radial parts at nodes from 0 to beyond ``rc``, INTERVALS a width, before they are cut off at WIDTHS."""
    points, w = radial_grid(nmax, rc + 3 * sigma)
    nodes = np.arange(math.ceil(rc / sigma * INTERVALS) + ORDER) * (sigma / INTERVALS)
    return (radial_overlap(lmax, points[:, None], nodes[None, :], sigma, widths=np.inf) * np.sqrt(w)[None, :, None]).transpose(2, 0, 1)


class Densities:
    """Adds up the ``density`` of many neighbours, by polynomials between the nodes of a ``radial_table``.

    Legendre functions go with powers of x + iy in place of angles, and each pair costs a row of the table
    rather than a continued fraction.
    """

    def __init__(self, table: np.ndarray, *, rc: float, sigma: float) -> None:
        intervals, self.orders, self.n = len(table) - ORDER, table.shape[1], table.shape[2]
        self.sigma, self.points = sigma, radial_grid(self.n, rc + 3 * sigma)[0]
        start = np.clip(np.arange(intervals) - ORDER // 2, 0, None)
        solved = {k: np.linalg.inv(np.vander(np.arange(ORDER + 1) - float(k), increasing=True)) for k in range(ORDER // 2 + 1)}
        solve = np.stack([solved[k] for k in np.arange(intervals) - start])
        flat = table.reshape(len(table), -1)
        #: By power, then function: a row over all intervals, which stays in a core's cache.
        self.polynomials = np.ascontiguousarray((solve @ flat[start[:, None] + np.arange(ORDER + 1)]).transpose(1, 2, 0))
        #: The columns (l, m, imaginary) of the angular parts, m >= 0.
        self.columns = [(l, m, part) for m in range(self.orders) for l in range(m, self.orders) for part in range(1 + (m > 0))]  # noqa: E741

    def _radial(self, r: np.ndarray) -> np.ndarray:
        t = np.where(r <= NEAR, 0.0, r * (INTERVALS / self.sigma))
        at = np.minimum(t.astype(np.int64), self.polynomials.shape[2] - 1)
        t -= at
        g, more = self.polynomials[ORDER].take(at, axis=1), np.empty((self.orders * self.n, len(r)))
        for k in range(ORDER - 1, -1, -1):
            g *= t
            g += self.polynomials[k].take(at, axis=1, out=more, mode="clip")
        by_order = g.reshape(self.orders, self.n, -1)
        by_order[1:, :, r <= NEAR] = 0.0
        reach, most = WIDTHS * self.sigma, r.max(initial=0.0)
        for n, point in enumerate(self.points):
            if point >= reach or most - point >= reach:
                by_order[:, n] *= np.abs(point - r) < reach
        return g

    def _angular(self, d: np.ndarray, r: np.ndarray, weight: np.ndarray) -> np.ndarray:
        x, y, z = (d / np.where(r == 0, 1.0, r)[:, None]).T.copy()
        out, lmax = np.empty((len(self.columns), len(r))), self.orders - 1
        column = 0
        real, imaginary = weight * math.sqrt(1 / (4 * math.pi)), None
        for m in range(lmax + 1):
            if m == 1:
                real, imaginary = -math.sqrt(3) * real * x, -math.sqrt(3) * real * y  # sqrt(3 / 2), and sqrt(2) as m >= 1 counts twice
            elif m:
                f = -math.sqrt((2 * m + 1) / (2 * m))
                real, imaginary = f * (real * x - imaginary * y), f * (real * y + imaginary * x)
            both = [real] if imaginary is None else [real, imaginary]
            before, now = None, np.ones(len(r))
            for l in range(m, lmax + 1):  # noqa: E741
                if l > m:
                    g = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
                    above = z * now if before is None else z * now - g * before
                    above *= math.sqrt((4 * l * l - 1) / (l * l - m * m))
                    before, now = now, above
                for part in both:
                    np.multiply(part, now, out=out[column])
                    column += 1
        return out

    def add(self, out: np.ndarray, at: np.ndarray, d: np.ndarray, weight: np.ndarray, *, batch: int = 4096) -> None:
        """Adds to ``out`` (segment, l, n, parts) the neighbours at ``d`` (k, 3) of each segment ``at`` (k, best in long runs); parts are real, then imaginary."""
        l, m, part = np.array(self.columns).T  # noqa: E741
        for first in range(0, len(at), batch):
            own = slice(first, first + batch)
            r = np.sqrt((d[own] ** 2).sum(axis=1))
            g, y = self._radial(r), self._angular(d[own], r, weight[own])
            starts = [0, *(np.flatnonzero(np.diff(at[own])) + 1)]
            sums = np.empty((len(starts), len(y), len(g)))
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(r)])):
                np.matmul(y[:, s:e], g[:, s:e].T, out=sums[k])
            sums = sums.reshape(len(starts), len(l), self.orders, self.n)[:, np.arange(len(l)), l]
            np.add.at(out, (at[own][starts][:, None], l, slice(None), m + part * self.orders), sums)  # a segment may have several runs


def power_spectrum(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(n, n', l): the real part of the sum over m of f conj(h), over sqrt(2 l + 1)."""
    return np.einsum("nlm,klm->nkl", f, h.conj()).real / np.sqrt(2 * np.arange(f.shape[1]) + 1)


def power_spectra(f: np.ndarray) -> np.ndarray:
    """(centre, s, t, n, n', l): ``power_spectrum`` of the densities (centre, species, l, n, parts) of each two species."""
    c, species, orders, n, parts = f.shape
    f = f.transpose(0, 2, 1, 3, 4).reshape(c, orders, species * n, parts)
    p = (f @ f.swapaxes(2, 3)).reshape(c, orders, species, n, species, n) / np.sqrt(2 * np.arange(orders) + 1)[:, None, None, None, None]
    return p.transpose(0, 2, 4, 3, 5, 1)
