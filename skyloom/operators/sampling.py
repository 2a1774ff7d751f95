"""Sampling loops on the driver: component separation, Metropolis steps, the Gibbs cycle.

Maps and timelines stay in Spark; what the driver holds is a state of a few numbers or, for
the amplitude solver, multipole coefficients of the solved resolution.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from skyloom.operators import harmonics as sh
from skyloom.operators.dense import floored_inverse
from skyloom.operators.fourier import conjugate_gradient


@dataclass
class Band:
    """A band's map with its weights and beam."""

    values: np.ndarray
    inv_n: np.ndarray
    beam: np.ndarray  # of l


@dataclass
class AmplitudeSolver:
    """(1 + S^1/2 A^T N^-1 A S^1/2) x = S^1/2 A^T (N^-1 d + N^-1/2 eta1) + S^-1/2 mu + eta2 for component
    amplitudes S^1/2 x over bands; *mixing* is (band, component), *prior* (component, l)."""

    bands: list[Band]
    mixing: np.ndarray
    prior: np.ndarray
    nside: int
    lmax: int
    means: np.ndarray | None = None
    root: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.ell = np.array([ell for ell, _ in sh.pairs(self.lmax)])
        self.root = np.sqrt(self.prior)[:, self.ell]

    def project(self, a: np.ndarray, b: int) -> np.ndarray:
        band = self.bands[b]
        return sh.synthesis((self.mixing[b][:, None] * a).sum(0) * band.beam[self.ell], self.nside, self.lmax)

    def project_adjoint(self, x: np.ndarray, b: int) -> np.ndarray:
        alm = sh.adjoint(x, self.nside, self.lmax) * self.bands[b].beam[self.ell]
        return self.mixing[b][:, None] * alm[None]

    def apply(self, x: np.ndarray) -> np.ndarray:
        a = self.root * x
        return x + self.root * sum(self.project_adjoint(band.inv_n * self.project(a, b), b) for b, band in enumerate(self.bands))

    def rhs(self, eta1: list[np.ndarray] | None = None, eta2: np.ndarray | None = None) -> np.ndarray:
        total = 0
        for b, band in enumerate(self.bands):
            source = band.inv_n * band.values
            if eta1 is not None:
                source = source + np.sqrt(band.inv_n) * eta1[b]
            total = total + self.project_adjoint(source, b)
        out = self.root * total
        if self.means is not None:
            out = out + np.where(self.root > 0, self.means / np.where(self.root > 0, self.root, 1.0), 0.0)
        return out if eta2 is None else out + eta2

    def blocks(self) -> np.ndarray:
        """(l, component, component) of the operator where beams and weights are the same all over the sky."""
        npix = 12 * self.nside**2
        level = np.stack([band.beam**2 * band.inv_n.mean() * npix / (4 * np.pi) for band in self.bands])
        inner = np.einsum("bi,bl,bj->lij", self.mixing, level, self.mixing)
        root = np.sqrt(self.prior).T
        return np.eye(len(self.prior)) + root[:, :, None] * inner * root[:, None, :]

    def preconditioner(self, kind: str = "diagonal") -> Callable[[np.ndarray], np.ndarray]:
        """An approximate inverse of the operator; ``PRECONDITIONERS`` lists the kinds."""
        if kind not in PRECONDITIONERS:
            raise ValueError(f"no preconditioner {kind!r}; there are {', '.join(PRECONDITIONERS)}")
        inverse = PRECONDITIONERS[kind](self)[self.ell]
        return lambda v: np.einsum("kij,jk->ik", inverse, v)

    def solve(self, eta1: list[np.ndarray] | None = None, eta2: np.ndarray | None = None, tolerance: float = 1e-10, most: int = 300, preconditioner: str = "diagonal") -> np.ndarray:
        """Amplitudes S^1/2 x of every component; without draws the mean."""
        weights = np.sqrt(np.array([1.0 if m == 0 else 2.0 for _, m in sh.pairs(self.lmax)]))
        # real inner product of coefficients: scale m > 0 so that plain dot products are the right ones
        apply = lambda v: weights * self.apply(v / weights)
        condition = self.preconditioner(preconditioner)
        x, _ = conjugate_gradient(apply, weights * self.rhs(eta1, eta2), condition, tolerance, most)
        return self.root * (x / weights)


def _diagonal(blocks: np.ndarray) -> np.ndarray:
    n = blocks.shape[1]
    return np.eye(n) / np.maximum(blocks[:, range(n), range(n)], 1e-300)[:, None, :]


#: Preconditioners by name: the inverse block (l, component, component) of a solver.
PRECONDITIONERS: dict[str, Callable[[AmplitudeSolver], np.ndarray]] = {
    "none": lambda s: np.broadcast_to(np.eye(len(s.prior)), (s.lmax + 1, len(s.prior), len(s.prior))),
    "diagonal": lambda s: _diagonal(s.blocks()),
    "joint": lambda s: np.stack([floored_inverse(b) for b in s.blocks()]),
    "beam": lambda s: np.stack([np.eye(len(s.prior)) / max(1e-300, sum(band.beam[ell] ** 2 for band in s.bands)) for ell in range(s.lmax + 1)]),
    "noise": lambda s: np.broadcast_to(np.eye(len(s.prior)) / sum(band.inv_n.mean() for band in s.bands), (s.lmax + 1, len(s.prior), len(s.prior))),
    "mixing": lambda s: np.broadcast_to(floored_inverse(s.mixing.T @ s.mixing), (s.lmax + 1, len(s.prior), len(s.prior))),
}

State = dict[str, float]
#: Log density of a state (minus infinity outside its bounds), and what else was solved for it.
Density = Callable[[State], tuple[float, object]]


def metropolis(start: State, density: Density, step: Callable[[State, np.random.Generator], State], steps: int, rng: np.random.Generator) -> tuple[State, object, int]:
    """A Metropolis chain with symmetric steps: the last state, what was solved for it, and the number accepted.

    A rejected state leaves nothing behind, since what depends on it is in the density's answer.
    """
    here, (level, solved), taken = start, density(start), 0
    for _ in range(steps):
        there = step(here, rng)
        new, other = density(there)
        if new > -np.inf and np.log1p(-rng.random()) < new - level:
            here, level, solved, taken = there, new, other, taken + 1
    return here, solved, taken


def gaussian_step(sizes: State) -> Callable[[State, np.random.Generator], State]:
    """All parameters move at once by normal steps of the given sizes."""
    return lambda here, rng: {k: v + sizes[k] * rng.standard_normal() for k, v in here.items()}


def bounded(likelihood: Callable[[State], float], bounds: dict[str, tuple[float, float]], priors: dict[str, tuple[float, float]]) -> Density:
    """Likelihood times flat priors inside *bounds* and normal ones of mean and width."""

    def density(at: State) -> tuple[float, object]:
        if any(not lo <= at[k] <= hi for k, (lo, hi) in bounds.items()):
            return -np.inf, None
        return likelihood(at) + sum(-0.5 * ((at[k] - m) / w) ** 2 for k, (m, w) in priors.items() if w > 0), None

    return density


@dataclass(frozen=True)
class Parameter:
    """A spectral parameter of one view of a component, as a run's parameters give it."""

    comp: str
    pol: str
    name: str
    value: float
    step: float
    low: float
    high: float
    prior: tuple[float, float] | None = None


def parameter_groups(rows: list[Parameter], chosen: list[str] | None = None) -> dict[tuple[str, str], Parameter]:
    """One parameter a component and name for all its views, of the *chosen* components.

    Views that disagree, a step that is not positive, bounds the wrong way round and a value or a
    prior of no width outside them are errors; parameters with a step of 0 stay fixed and have no group.
    """
    found: dict[tuple[str, str], Parameter] = {}
    for row in rows:
        if chosen is not None and row.comp not in chosen or row.step == 0:
            continue
        where = f"{row.comp} {row.name}"
        if row.step < 0:
            raise ValueError(f"{where}: the step is negative")
        if not row.low < row.high or not row.low <= row.value <= row.high:
            raise ValueError(f"{where}: {row.value} is not inside {row.low} to {row.high}")
        if row.prior is not None and row.prior[1] <= 0:
            raise ValueError(f"{where}: the prior has no width")
        other = found.setdefault((row.comp, row.name), row)
        if (other.value, other.step, other.low, other.high, other.prior) != (row.value, row.step, row.low, row.high, row.prior):
            raise ValueError(f"{where}: its views {other.pol} and {row.pol} disagree")
    return found


def gibbs(steps: list[tuple[str, Callable[[dict], dict]]], state: dict, iterations: int, record: Callable[[int, dict], None] | None = None) -> dict:
    """The cycle of conditional draws: each step takes the state and gives what it replaces."""
    for k in range(iterations):
        for _, step in steps:
            state = state | step(state)
        if record:
            record(k, state)
    return state
