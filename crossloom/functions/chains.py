"""Hidden Markov chains of cross types, as numpy matrices, and kernels that run them for many individuals at once."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Sets of states that partially informative codes of a four-way cross stand for.
FOUR_WAY_SETS = {5: (1, 3), 6: (2, 4), 7: (1, 2), 8: (3, 4), 9: (1, 4), 10: (2, 3), 11: (2, 3, 4), 12: (1, 3, 4), 13: (1, 2, 4), 14: (1, 2, 3)}
LEAST_R = 1e-14
LEAST_ERROR = 1e-50

MASKED = ("ri4self", "ri4sib", "ri8self", "ri8selfIRIP1", "ri8sib", "bgmagic16")


def n_states(crosstype: str, chrtype: str = "A") -> int:
    from crossloom.model import n_genotypes

    return n_genotypes(crosstype, chrtype)


def emissions(crosstype: str, codes: np.ndarray, error: float, chrtype: str = "A") -> np.ndarray:
    """P(code | state) for an array of codes (0: missing); the last axis is the state."""
    e = max(error, LEAST_ERROR)
    k = n_states(crosstype, chrtype)
    codes = np.asarray(codes, np.int64)
    if crosstype in MASKED:
        has = codes[..., None] >> np.arange(k) & 1
        return np.where(codes[..., None] == 0, 1.0, np.where(has == 1, 1 - e, e))
    sets = {c: (c,) for c in range(1, k + 1)}
    if crosstype == "4way":
        sets |= FOUR_WAY_SETS
    elif k == 3:
        sets |= {4: (1, 2), 5: (2, 3)}
    table = np.ones((max(sets) + 1, k))
    for c, states in sets.items():
        s = len(states)
        for v in range(1, k + 1):
            # An error turns up as any other state alike; a set of states is seen if one of its members is.
            inside, outside = 1 - e * (k - s) / (k - 1), e * s / (k - 1)
            table[c, v - 1] = inside if v in states else outside
    codes = np.where((codes < 0) | (codes > max(sets)), 0, codes)
    return table[codes]


@lru_cache(maxsize=4096)
def _generations(s: int, t: int, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint distribution of genotypes (0, 1, 2 B alleles) at two loci after s backcrosses and t - 1 or t selfings of an F1."""
    haps = [(a, b) for a in (0, 1) for b in (0, 1)]

    def gamete(x, y):
        out = np.zeros(4)
        for a, p in ((x, 0.5), (y, 0.5)):
            other = y if a is x else x
            out[haps.index(a)] += p * (1 - r)
            out[haps.index((a[0], other[1]))] += p * r
        return out

    g = np.array([[gamete(x, y) for y in haps] for x in haps])
    p = np.zeros((4, 4))
    p[0, 3] = 1
    for _ in range(s):
        q = np.einsum("xy,xyg->g", p, g)
        p = np.zeros((4, 4))
        p[:, 0] = q
    for _ in range(max(0, t - 1) if s == 0 else t):
        p = np.einsum("xy,xyg,xyh->gh", p, g, g)
    joint = np.zeros((3, 3))
    for i, x in enumerate(haps):
        for j, y in enumerate(haps):
            joint[x[0] + y[0], x[1] + y[1]] += p[i, j]
    return joint, joint.sum(1)


def initial(crosstype: str, chrtype: str = "A", scheme: tuple[int, int] = (0, 0)) -> np.ndarray:
    k = n_states(crosstype, chrtype)
    if crosstype == "bcsft" and k == 3:
        return np.maximum(_generations(*scheme, 0.25)[1], 1e-300)
    return np.array([0.25, 0.5, 0.25]) if k == 3 else np.full(k, 1 / k)


def transition(crosstype: str, r: float, r_male: float | None = None, chrtype: str = "A", scheme: tuple[int, int] = (0, 0)) -> np.ndarray:
    """P(next state | state) over an interval with recombination fraction r."""
    r = min(max(r, LEAST_R), 0.5)
    k = n_states(crosstype, chrtype)
    if k == 2:
        return np.array([[1 - r, r], [r, 1 - r]])
    if crosstype == "f2":
        a, b, c = (1 - r) ** 2, 2 * r * (1 - r), r * r
        return np.array([[a, b, c], [b / 2, a + c, b / 2], [c, b, a]])
    if crosstype == "bcsft":
        joint, single = _generations(*scheme, r)
        return joint / np.maximum(single, 1e-300)[:, None]
    two = lambda x: np.array([[1 - x, x], [x, 1 - x]])
    if crosstype == "4way":  # states AC, BC, AD, BD: the first allele from the mother, the second from the father
        return np.kron(two(min(max(r if r_male is None else r_male, LEAST_R), 0.5)), two(r))
    i = np.arange(k)
    same = i[:, None] == i[None, :]
    if crosstype == "ri4self":
        return np.where(same, (1 - r) / (1 + 2 * r), r / (1 + 2 * r))
    if crosstype == "ri4sib":
        return np.where(same, 1 / (1 + 6 * r), 2 * r / (1 + 6 * r))
    if crosstype == "ri8sib":
        return np.where(same, (1 - r) / (1 + 6 * r), r / (1 + 6 * r))
    if crosstype == "ri8self":
        mate = i[:, None] // 2 == i[None, :] // 2
        return np.where(same, (1 - r) ** 2, np.where(mate, r * (1 - r), r / 2)) / (1 + 2 * r)
    if crosstype == "ri8selfIRIP1":
        stay = ((1 - r) ** 3 + r / 4) / (1 + 2 * r)
        return np.where(same, stay, (1 - stay) / 7)
    # 16-way: lines meet in pairs, fours, eights; then three more rounds of random mating
    kin = np.full((16, 16), r / 8)
    for size, value in ((8, r * (1 - r) / 4), (4, r * (1 - r) ** 2 / 2), (2, r * (1 - r) ** 3)):
        kin = np.where(i[:, None] // size == i[None, :] // size, value, kin)
    kin = np.where(same, (1 - r) ** 4, kin)
    return (1 - r) ** 3 * (kin - 1 / 16) + 1 / 16


def forward(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities (n, loci, k) and the log likelihood of each individual."""
    n, loci, k = emit.shape
    a = np.empty((n, loci, k))
    x = init * emit[:, 0]
    ll = np.zeros(n)
    for j in range(loci):
        if j:
            x = (a[:, j - 1] @ steps[j - 1]) * emit[:, j]
        s = x.sum(1)
        a[:, j] = x / s[:, None]
        ll += np.log(s)
    return a, ll


def backward(emit: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    n, loci, k = emit.shape
    b = np.ones((n, loci, k))
    for j in range(loci - 2, -1, -1):
        x = (emit[:, j + 1] * b[:, j + 1]) @ steps[j].T
        b[:, j] = x / x.sum(1, keepdims=True)
    return b


def posterior(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    p = forward(emit, init, steps)[0] * backward(emit, steps)
    return p / p.sum(2, keepdims=True)


def pair_posterior(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """P(state at j, state at j + 1 | data): (n, loci - 1, k, k)."""
    a, b = forward(emit, init, steps)[0], backward(emit, steps)
    out = np.stack([a[:, j, :, None] * steps[j] * (emit[:, j + 1] * b[:, j + 1])[:, None, :] for j in range(len(steps))], axis=1)
    return out / out.sum((2, 3), keepdims=True)


def viterbi(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Most likely states from 1; ties go to the smaller state."""
    n, loci, k = emit.shape
    with np.errstate(divide="ignore"):
        x = np.log(init) + np.log(emit[:, 0])
        back = np.zeros((n, loci, k), np.int8)
        for j in range(1, loci):
            score = x[:, :, None] + np.log(steps[j - 1])
            back[:, j] = score.argmax(1)
            x = score.max(1) + np.log(emit[:, j])
    out = np.empty((n, loci), np.int8)
    out[:, -1] = x.argmax(1)
    for j in range(loci - 1, 0, -1):
        out[:, j - 1] = back[np.arange(n), j, out[:, j]]
    return out + 1


def sample(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray], draws: int, seeds: list) -> np.ndarray:
    """States from 1, drawn jointly: (n, loci, draws). Each individual has its own stream, so results don't depend on batches."""
    n, loci, k = emit.shape
    b = backward(emit, steps)
    out = np.empty((n, loci, draws), np.int8)
    u = np.stack([np.random.default_rng(s).random((loci, draws)) for s in seeds])
    p = init * emit[:, 0] * b[:, 0]
    c = np.cumsum(p / p.sum(1, keepdims=True), axis=1)
    out[:, 0] = (u[:, 0, :, None] > c[:, None, :-1]).sum(2)
    for j in range(1, loci):
        q = steps[j - 1][None] * (emit[:, j] * b[:, j])[:, None, :]
        c = np.cumsum(q / q.sum(2, keepdims=True), axis=2)
        rows = c[np.arange(n)[:, None], out[:, j - 1]]
        out[:, j] = (u[:, j, :, None] > rows[:, :, :-1]).sum(2)
    return out + 1


def crossings(crosstype: str, r: float, k: int) -> np.ndarray:
    """Expected share of recombinant meioses for each pair of neighbouring states."""
    if k == 2:
        return np.array([[0.0, 1], [1, 0]])
    if k == 3:
        het = 2 * r * r / ((1 - r) ** 2 + r * r)
        return np.array([[0, 1, 2], [1, het, 1], [2, 1, 0]]) / 2
    if crosstype == "4way":
        f, m = np.tile([[0.0, 1], [1, 0]], (2, 2)), np.repeat(np.repeat([[0.0, 1], [1, 0]], 2, 0), 2, 1)
        return (f + m) / 2
    return 1.0 - np.eye(k)


def pair_rf(crosstype: str, g1: np.ndarray, g2: np.ndarray, n: np.ndarray, tol: float = 1e-6, maxit: int = 10000) -> tuple[float | None, float]:
    """Recombination fraction and LOD of two markers, by EM on the table of their codes."""
    k = n_states(crosstype)
    e1, e2 = emissions(crosstype, g1, 0.0), emissions(crosstype, g2, 0.0)
    init = initial(crosstype)
    if not ((e1.max(1) > e1.min(1)) & (e2.max(1) > e2.min(1))).any():
        return None, 0.0

    def loglik(r):
        return float((n * np.log10(np.maximum(np.einsum("nu,u,uv,nv->n", e1, init, transition(crosstype, r), e2), 1e-300))).sum())

    r = 0.01
    for _ in range(maxit):
        joint = e1[:, :, None] * (init[:, None] * transition(crosstype, r))[None] * e2[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        new = float((n[:, None, None] * joint * crossings(crosstype, r, k)).sum() / n.sum())
        new = min(max(new, tol / 1000), 1 - tol / 1000)
        done = abs(new - r) < tol * (abs(new) + 100 * tol)
        r = new
        if done:
            break
    half = loglik_at_half(e1, e2, init, n)
    return r, loglik_free(crosstype, e1, e2, init, n, r) - half


def loglik_at_half(e1, e2, init, n) -> float:
    return float((n * np.log10(np.maximum((e1 @ init) * (e2 @ init), 1e-300))).sum())


def loglik_free(crosstype, e1, e2, init, n, r) -> float:
    """As ``transition``, also for r above a half."""
    if r <= 0.5:
        t = transition(crosstype, r)
    elif n_states(crosstype) == 3:
        a, b, c = (1 - r) ** 2, 2 * r * (1 - r), r * r
        t = np.array([[a, b, c], [b / 2, a + c, b / 2], [c, b, a]])
    else:
        t = transition(crosstype, 0.5)
    return float((n * np.log10(np.maximum(np.einsum("nu,u,uv,nv->n", e1, init, t, e2), 1e-300))).sum())


def log10_sum(x: np.ndarray) -> float:
    m = x.max()
    return m + math.log10(np.power(10, x - m).sum())
