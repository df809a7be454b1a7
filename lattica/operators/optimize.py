"""Metaheuristic allocation: population searches in numpy over the distinct costs of a label's nodes.

Nodes that cost the same are interchangeable, so Spark groups them and the search sees one variable per distinct cost, ``MOST``
at most. Searches are sequential by nature and run on the driver. Each name is the published method's own move; names without
one here are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import PropertyGraph
from lattica.plans.ast import CypherError

MOST = 100_000
Objective = Callable[[np.ndarray], np.ndarray]

FUNCTIONS: dict[str, Objective] = {
    "sphere": lambda x: (x**2).sum(axis=1),
    "rastrigin": lambda x: 10 * x.shape[1] + (x**2 - 10 * np.cos(2 * np.pi * x)).sum(axis=1),
    "ackley": lambda x: -20 * np.exp(-0.2 * np.sqrt((x**2).mean(axis=1))) - np.exp(np.cos(2 * np.pi * x).mean(axis=1)) + 20 + np.e,
    "rosenbrock": lambda x: (100 * (x[:, 1:] - x[:, :-1] ** 2) ** 2 + (1 - x[:, :-1]) ** 2).sum(axis=1),
}


def _zdt(shape: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Objective:
    def value(x: np.ndarray) -> np.ndarray:
        g = 1 + 9 * x[:, 1:].mean(axis=1)
        return np.stack([x[:, 0], g * shape(x[:, 0], g)], axis=1)

    return value


#: Two-objective benchmarks over [0, 1].
MULTI: dict[str, Objective] = {"zdt1": _zdt(lambda f, g: 1 - np.sqrt(f / g)), "zdt2": _zdt(lambda f, g: 1 - (f / g) ** 2), "zdt3": _zdt(lambda f, g: 1 - np.sqrt(f / g) - f / g * np.sin(10 * np.pi * f))}


@dataclass
class Swarm:
    """A population: points, their values, bounds, the share of iterations done, and what a method remembers."""

    objective: Objective
    low: np.ndarray
    high: np.ndarray
    rng: np.random.Generator
    x: np.ndarray
    f: np.ndarray
    t: float = 0.0
    kept: dict[str, Any] = field(default_factory=dict)

    def r(self) -> np.ndarray:
        return self.rng.random(self.x.shape)

    @property
    def best(self) -> np.ndarray:
        return self.x[self.f.argmin()]

    @property
    def worst(self) -> np.ndarray:
        return self.x[self.f.argmax()]

    def peers(self) -> np.ndarray:
        """Another member for each."""
        n = len(self.x)
        return (np.arange(n) + self.rng.integers(1, max(2, n), n)) % n

    def better(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each member the better of two candidates."""
        a, b = np.clip(a, self.low, self.high), np.clip(b, self.low, self.high)
        return np.where((self.objective(a) <= self.objective(b))[:, None], a, b)

    def quasi_opposite(self, x: np.ndarray) -> np.ndarray:
        """Points between the centre of the bounds and the mirror images of x."""
        centre, mirror = (self.low + self.high) / 2, self.low + self.high - x
        return centre + self.r() * (mirror - centre)

    def levy(self, beta: float = 1.5) -> np.ndarray:
        """Heavy-tailed steps by Mantegna's rule."""
        sigma = (math.gamma(1 + beta) * math.sin(math.pi * beta / 2) / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)
        return self.rng.normal(0, sigma, self.x.shape) / np.abs(self.rng.normal(size=self.x.shape)) ** (1 / beta)


def jaya(s: Swarm) -> np.ndarray:
    return s.x + s.r() * (s.best - np.abs(s.x)) - s.r() * (s.worst - np.abs(s.x))


def qojaya(s: Swarm) -> np.ndarray:
    new = jaya(s)
    return s.better(new, s.quasi_opposite(new))


def samp_jaya(s: Swarm) -> np.ndarray:
    """Sub-populations by rank, each with its own best and worst; one more while the search improves, else one fewer."""
    m, last = s.kept.get("groups", 2), s.kept.get("last", np.inf)
    m = min(max(1, len(s.x) // 3), m + 1) if s.f.min() < last else max(1, m - 1)
    s.kept |= {"groups": m, "last": s.f.min()}
    best, worst = np.empty_like(s.x), np.empty_like(s.x)
    for own in np.array_split(np.argsort(s.f), m):
        best[own], worst[own] = s.x[own[0]], s.x[own[-1]]
    return s.x + s.r() * (best - np.abs(s.x)) - s.r() * (worst - np.abs(s.x))


def rao1(s: Swarm) -> np.ndarray:
    return s.x + s.r() * (s.best - s.worst)


def _ordered(s: Swarm) -> tuple[np.ndarray, np.ndarray]:
    """Of each member and another one, the better and the worse."""
    peer = s.peers()
    first = (s.f <= s.f[peer])[:, None]
    return np.where(first, s.x, s.x[peer]), np.where(first, s.x[peer], s.x)


def rao2(s: Swarm) -> np.ndarray:
    good, bad = _ordered(s)
    return s.x + s.r() * (s.best - s.worst) + s.r() * (np.abs(good) - np.abs(bad))


def rao3(s: Swarm) -> np.ndarray:
    good, bad = _ordered(s)
    return s.x + s.r() * (s.best - np.abs(s.worst)) + s.r() * (np.abs(good) - bad)


def qo_rao(s: Swarm) -> np.ndarray:
    new = rao1(s)
    return s.better(new, s.quasi_opposite(new))


def _or_anywhere(s: Swarm, new: np.ndarray) -> np.ndarray:
    """The move for half of the members, a random point for the others."""
    return np.where(s.rng.random((len(s.x), 1)) > 0.5, new, s.high - (s.high - s.low) * s.r())


def bmr(s: Swarm) -> np.ndarray:
    factor = s.rng.integers(1, 3, (len(s.x), 1))
    return _or_anywhere(s, s.x + s.r() * (s.best - factor * s.x.mean(axis=0)) + s.r() * (s.best - s.x[s.peers()]))


def bwr(s: Swarm) -> np.ndarray:
    factor, peer = s.rng.integers(1, 3, (len(s.x), 1)), s.x[s.peers()]
    return _or_anywhere(s, s.x + s.r() * (s.best - factor * peer) - s.r() * (s.worst - peer))


def bmwr(s: Swarm) -> np.ndarray:
    factor = s.rng.integers(1, 3, (len(s.x), 1))
    return _or_anywhere(s, s.x + s.r() * (s.best - factor * s.x.mean(axis=0)) - s.r() * (s.worst - s.x[s.peers()]))


def tlbo(s: Swarm) -> np.ndarray:
    """A teacher's phase, then learners from each other."""
    taught = s.better(s.x, s.x + s.r() * (s.best - s.rng.integers(1, 3) * s.x.mean(axis=0)))
    peer = s.peers()
    ahead = (s.objective(taught) < s.f[peer])[:, None]
    return taught + s.r() * np.where(ahead, taught - s.x[peer], s.x[peer] - taught)


def itlbo(s: Swarm, teachers: int = 4) -> np.ndarray:
    """Several teachers, each for the learners next below it, an adaptive teaching factor, tutorials and self-study."""
    order = np.argsort(s.f)
    out = s.x.copy()
    for own in np.array_split(order, min(teachers, len(order))):
        teacher, mean = s.x[own[0]], s.x[own].mean(axis=0)
        factor = np.divide(mean, teacher, out=np.ones_like(mean), where=np.abs(teacher) > 1e-12)
        out[own] = s.x[own] + s.rng.random((len(own), s.x.shape[1])) * (teacher - np.clip(factor, 0, 2) * mean)
    taught = s.better(s.x, out)
    good, bad = _ordered(s)
    return taught + s.r() * (good - bad) + s.r() * (s.best - s.rng.integers(1, 3) * taught)


def gotlbo(s: Swarm) -> np.ndarray:
    """TLBO with, now and then, the mirror images of the population in its own range."""
    if s.rng.random() < 0.3:
        return s.rng.random() * (s.x.min(axis=0) + s.x.max(axis=0)) - s.x
    return tlbo(s)


def de(s: Swarm) -> np.ndarray:
    n, d = s.x.shape
    a, b, c = (s.x[s.rng.permutation(n)] for _ in range(3))
    cross = (s.r() < 0.9) | (np.arange(d) == s.rng.integers(0, d, (n, 1)))
    return np.where(cross, a + 0.6 * (b - c), s.x)


def pso(s: Swarm) -> np.ndarray:
    own, own_f = s.kept.setdefault("own", s.x.copy()), s.kept.setdefault("own_f", s.f.copy())
    ahead = s.f < own_f
    own[ahead], own_f[ahead] = s.x[ahead], s.f[ahead]
    s.kept["v"] = 0.72 * s.kept.get("v", np.zeros_like(s.x)) + 1.49 * s.r() * (own - s.x) + 1.49 * s.r() * (own[own_f.argmin()] - s.x)
    return s.x + s.kept["v"]


def gwo(s: Swarm) -> np.ndarray:
    a, leads = 2 * (1 - s.t), s.x[np.argsort(s.f)[:3]]
    return sum(lead - a * (2 * s.r() - 1) * np.abs(2 * s.r() * lead - s.x) for lead in leads) / len(leads)


def hs(s: Swarm) -> np.ndarray:
    """Each value from the memory, tuned at times, or anew."""
    n, d = s.x.shape
    memory = s.x[s.rng.integers(0, n, (n, d)), np.arange(d)]
    tuned = memory + (s.r() < 0.3) * (2 * s.r() - 1) * 0.05 * (s.high - s.low)
    return np.where(s.r() < 0.9, tuned, s.low + s.r() * (s.high - s.low))


def abc(s: Swarm, patience: int = 20) -> np.ndarray:
    """Bees move in one coordinate, onlookers around good sources; a source that gives nothing for long is left."""
    n, d = s.x.shape
    tries = s.kept.setdefault("tries", np.zeros(n, dtype=int))
    same = s.kept.get("x")
    if same is not None:
        moved = (same != s.x).any(axis=1)
        tries[moved], tries[~moved] = 0, tries[~moved] + 1
    s.kept["x"] = s.x.copy()
    fit = 1 / (1 + s.f - s.f.min())
    chosen = np.where(s.rng.random(n) < 0.5, np.arange(n), s.rng.choice(n, n, p=fit / fit.sum()))
    new, at = s.x[chosen].copy(), s.rng.integers(0, d, n)
    rows = np.arange(n)
    new[rows, at] += (2 * s.rng.random(n) - 1) * (new[rows, at] - s.x[s.peers(), at])
    left = (tries > patience) & (rows != s.f.argmin())
    new[left] = s.low + s.rng.random((int(left.sum()), d)) * (s.high - s.low)
    tries[left] = 0
    return new


def bat(s: Swarm) -> np.ndarray:
    """Velocities by a frequency each; near the end, loud walks around the best give way to soft ones."""
    s.kept["v"] = 0.9 * s.kept.get("v", np.zeros_like(s.x)) + s.rng.random((len(s.x), 1)) * (s.best - s.x)
    loud, pulse = 0.97 ** (100 * s.t), 0.5 * (1 - math.exp(-3 * s.t))
    walk = s.best + 0.1 * loud * s.rng.normal(size=s.x.shape) * (s.high - s.low)
    return np.where(s.rng.random((len(s.x), 1)) > pulse, s.x + s.kept["v"], walk)


def cuckoo(s: Swarm) -> np.ndarray:
    """Heavy-tailed flights, scaled by the way to the best nest; a quarter of the nests' values are found out and built anew."""
    flown = s.better(s.x, s.x + 0.1 * s.levy() * (s.x - s.best + 1e-3 * (s.high - s.low)))
    return np.where(s.r() < 0.25, flown + s.r() * (s.x[s.peers()] - s.x[s.peers()]), flown)


def fpa(s: Swarm) -> np.ndarray:
    """Pollen flies far towards the best flower or, at times, between two neighbours."""
    far = s.x + 0.3 * s.levy() * (s.best - s.x)
    near = s.x + s.r() * (s.x[s.peers()] - s.x[s.peers()])
    return np.where(s.rng.random((len(s.x), 1)) < 0.8, far, near)


def firefly(s: Swarm) -> np.ndarray:
    """Each moves towards all brighter ones, less the farther they are, and a little at random."""
    scale = s.high - s.low
    out = s.x.copy()
    for k in np.flatnonzero(s.f > s.f.min()):
        to = s.x[s.f < s.f[k]] - s.x[k]
        pull = np.exp(-((to / scale) ** 2).mean(axis=1))[:, None]
        out[k] += (pull * to).mean(axis=0) * 2 * s.rng.random()
    return out + 0.2 * (1 - s.t) ** 2 * (s.r() - 0.5) * scale


def gsa(s: Swarm) -> np.ndarray:
    """Masses by value attract one another; gravity and the number of masses that pull shrink."""
    mass = (s.f.max() - s.f) / max(1e-12, s.f.max() - s.f.min())
    mass = mass / max(1e-12, mass.sum())
    force = np.zeros_like(s.x)
    for j in np.argsort(s.f)[: max(1, int(len(s.x) * (1 - s.t)))]:
        to = s.x[j] - s.x
        force += s.r() * mass[j] * to / (np.linalg.norm(to / (s.high - s.low), axis=1)[:, None] + 1e-9)
    s.kept["v"] = s.r() * s.kept.get("v", np.zeros_like(s.x)) + math.exp(-5 * s.t) * force
    return s.x + s.kept["v"]


def ga(s: Swarm) -> np.ndarray:
    """Tournaments, uniform crossover, normal mutation."""
    n = len(s.x)
    pair = s.rng.integers(0, n, (2, 2, n))
    one, two = (np.where((s.f[a] < s.f[b])[:, None], s.x[a], s.x[b]) for a, b in pair)
    return np.where(s.r() < 0.5, one, two) + (s.r() < 0.1) * s.rng.normal(0, 0.1, s.x.shape) * (s.high - s.low) * (1 - s.t)


def sa(s: Swarm) -> np.ndarray:
    return s.x + s.rng.normal(0, 0.3 * (1 - s.t) + 0.01, s.x.shape) * (s.high - s.low)


MOVES: dict[str, Callable[[Swarm], np.ndarray]] = {
    f.__name__: f for f in (abc, bat, bmr, bmwr, bwr, cuckoo, de, firefly, fpa, ga, gotlbo, gsa, gwo, hs, itlbo, jaya, pso, qo_rao, qojaya, rao1, rao2, rao3, sa, samp_jaya, tlbo)
}
ALGORITHMS = tuple(MOVES)
#: Methods whose members move whether they improve or not.
RESTLESS = {"pso", "gwo", "firefly", "gsa"}
#: Multi-objective methods: the move of each, or crossover and mutation.
PARETO = {"nsga2": None, "motlbo": tlbo, "mo_bmr": bmr, "mo_bwr": bwr, "mo_bmwr": bmwr}


def minimise(objective: Objective, low: np.ndarray, high: np.ndarray, algorithm: str = "jaya", population: int = 30, iterations: int = 100, seed: int = 1) -> tuple[np.ndarray, float, list[float]]:
    """(best point met, its value, best value after each generation)."""
    if algorithm not in MOVES:
        raise CypherError("UnknownAlgorithm", f"{algorithm}; known: {', '.join((*MOVES, *PARETO))}")
    rng = np.random.default_rng(seed)
    x = low + rng.random((population, len(low))) * (high - low)
    s = Swarm(objective, low, high, rng, x, objective(x))
    top, top_f, history = s.best.copy(), float(s.f.min()), []
    for k in range(iterations):
        s.t = k / max(1, iterations)
        new = np.clip(MOVES[algorithm](s), low, high)
        g = objective(new)
        take = np.ones(population, dtype=bool) if algorithm in RESTLESS else g <= s.f
        if algorithm == "sa":
            heat = max(1e-9, float(np.ptp(s.f)) * 0.2 * (1 - s.t) ** 2)
            take |= rng.random(population) < np.exp(-np.clip((g - s.f) / heat, 0, 700))
        s.x, s.f = np.where(take[:, None], new, s.x), np.where(take, g, s.f)
        if s.f.min() < top_f:
            top, top_f = s.best.copy(), float(s.f.min())
        history.append(top_f)
    return top, top_f, history


def front(values: np.ndarray) -> np.ndarray:
    """Rows that no other row dominates (less is better)."""
    keep = np.ones(len(values), dtype=bool)
    for k in range(len(values)):
        keep[k] = not ((values <= values[k]).all(axis=1) & (values < values[k]).any(axis=1)).any()
    return np.flatnonzero(keep)


def crowding(values: np.ndarray) -> np.ndarray:
    """How far each row's neighbours lie apart, over all objectives; endless at the ends."""
    out = np.zeros(len(values))
    for v in values.T:
        order = np.argsort(v, kind="stable")
        out[order[[0, -1]]] = np.inf
        out[order[1:-1]] += (v[order[2:]] - v[order[:-2]]) / max(1e-12, v[order[-1]] - v[order[0]])
    return out


def ranked(values: np.ndarray) -> np.ndarray:
    """Rows in order of their fronts, and within a front the less crowded first."""
    left, out = np.arange(len(values)), []
    while len(left):
        own = left[front(values[left])]
        out.append(own[np.argsort(-crowding(values[own]), kind="stable")])
        left = np.setdiff1d(left, own)
    return np.concatenate(out)


def pareto(objectives: Objective, low: np.ndarray, high: np.ndarray, algorithm: str = "nsga2", population: int = 60, iterations: int = 100, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(points, values) of the front met: parents and children compete by front and crowding."""
    if algorithm not in PARETO:
        raise CypherError("UnknownAlgorithm", f"{algorithm} for several objectives; known: {', '.join(PARETO)}")
    rng = np.random.default_rng(seed)
    x = low + rng.random((population, len(low))) * (high - low)
    values = objectives(x)
    for k in range(iterations):
        order = ranked(values)
        x, values = x[order], values[order]
        rank = np.arange(population, dtype=float)
        if PARETO[algorithm] is None:
            a, b = (np.minimum(*rng.integers(0, population, (2, population))) for _ in range(2))
            u = rng.random(x.shape)
            spread = np.where(u < 0.5, 2 * u, 1 / np.maximum(1e-12, 2 * (1 - u))) ** (1 / 16)  # simulated binary crossover
            new = 0.5 * ((1 + spread) * x[a] + (1 - spread) * x[b])
            v = rng.random(x.shape)
            bend = np.where(v < 0.5, (2 * v) ** (1 / 21) - 1, 1 - (2 * (1 - v)) ** (1 / 21))
            new = np.where(rng.random(x.shape) < 1 / x.shape[1], new + bend * (high - low), new)
        else:  # a move by one objective's leave: members are valued by their distance to the best of a random direction
            w = rng.dirichlet(np.ones(values.shape[1]))
            span = np.maximum(1e-12, np.ptp(values, axis=0))
            low_v = values.min(axis=0)
            by = lambda p: ((objectives(p) - low_v) / span * w).max(axis=1)  # noqa: B023, E731
            s = Swarm(by, low, high, rng, x, by(x) + 1e-9 * rank, k / max(1, iterations))
            new = PARETO[algorithm](s)
        new = np.clip(new, low, high)
        both, all_values = np.concatenate([x, new]), np.concatenate([values, objectives(new)])
        stay = ranked(all_values)[:population]
        x, values = both[stay], all_values[stay]
    own = front(values)
    return x[own], values[own]


def procedure(graph: PropertyGraph, o: dict) -> DataFrame:
    """``algo.or.solve``: shares of a budget over the nodes of a label that minimise the cost properties.

    With several cost properties the result is a front, ``fitness`` is the least first cost on it.
    """
    label = o.get("label") or (graph.labels() or [None])[0]
    costs = o.get("cost_properties") or ([o["cost_property"]] if "cost_property" in o else None)
    if not costs:
        raise CypherError("InvalidArgument", "cost_property or cost_properties is needed")
    several = len(costs) > 1
    budget, algorithm = float(o.get("budget", 1.0)), str(o.get("algorithm", "nsga2" if several else "jaya")).lower()
    columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(costs)]
    rows = graph.scan([label] if label else (), costs).select(*columns).distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise CypherError("TooLarge", f"at most {MOST} distinct costs")
    schema = "fitness double, algorithm string, iterations long, front_size long"
    if not rows:
        return graph.spark.createDataFrame([], schema)
    cost = np.array(sorted(tuple(r) for r in rows), dtype=float)
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1e-12) * budget
    population, iterations, seed = int(o.get("population_size", 30)), int(o.get("max_iterations", 100)), int(o.get("seed", 1))
    low, high = np.zeros(len(cost)), np.ones(len(cost))
    if several:
        _, values = pareto(lambda x: share(x) @ cost, low, high, algorithm, population, iterations, seed)
        return graph.spark.createDataFrame([(float(values[:, 0].min()), algorithm, iterations, len(values))], schema)
    _, best, _ = minimise(lambda x: (share(x) @ cost)[:, 0], low, high, algorithm, population, iterations, seed)
    return graph.spark.createDataFrame([(best, algorithm, iterations, 1)], schema)
