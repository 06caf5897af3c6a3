"""Linear-chain conditional random fields in numpy.

Chains stand one after another in flat arrays: ``emit`` (N, S) holds the emission scores of
all positions and ``first`` where each chain begins, with N at the end. The transition
matrix T (S, S) is shared. Forward and backward go step by step through all chains of up to
``SHORT`` positions at once; longer ones run as segmented scans of products of matrices,
which take a logarithmic number of steps.
"""

from __future__ import annotations

import numpy as np

SHORT = 192


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the matrices (S, S, N) of two arrays, each scaled to a largest entry of 1."""
    out = a[:, :1] * b[:1]
    for k in range(1, a.shape[1]):
        out += a[:, k : k + 1] * b[k : k + 1]
    return out / out.max((0, 1))


def _scan(m: np.ndarray, place: np.ndarray, back: bool) -> np.ndarray:
    """Products of each position's matrix with all before it in its chain (``back``: with all after it).

    ``place`` counts the positions before (after) it in the chain.
    """
    m, step = m.copy(), 1
    rows = np.flatnonzero(place >= 1)
    while len(rows):
        m[:, :, rows] = _product(m[:, :, rows], m[:, :, rows + step]) if back else _product(m[:, :, rows - step], m[:, :, rows])
        step *= 2
        rows = rows[place[rows] >= step]
    return m


def _walk(m: np.ndarray, emit: np.ndarray, first: np.ndarray, size: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Fill ``alpha`` and ``beta`` (S, N) of the given chains, one position of all of them at a time."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for t, n in enumerate(alive):
        at = first[:n] + t
        if t:
            x = (alpha[:, None, at - 1] * m[:, :, at]).sum(0)
            alpha[:, at] = x / x.max(0)
        else:
            alpha[:, at] = emit[:, at]
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t + 1] if t + 1 < len(alive) else 0
        beta[:, first[n : alive[t]] + t] = 1
        at = first[:n] + t
        x = (m[:, :, at + 1] * beta[None, :, at + 1]).sum(1)
        beta[:, at] = x / x.max(0)


def expectations(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(P(state) at each position (N, S), and with ``pairs`` the expected counts of transitions (S, S))."""
    n, s = emit.shape
    if not n:
        return np.zeros((0, s)), np.zeros((s, s))
    size = np.diff(first)
    first, size = first[:-1][size > 0], size[size > 0]
    before = np.arange(n) - np.repeat(first, size)
    emit = np.ascontiguousarray(emit.T)
    emit = np.exp(emit - emit.max(0))
    m = np.exp(trans - trans.max())[:, :, None] * emit
    alpha, beta = np.empty((s, n), m.dtype), np.empty((s, n), m.dtype)
    _walk(m, emit, first[size <= SHORT], size[size <= SHORT], alpha, beta)
    if (size > SHORT).any():
        rows = np.flatnonzero(np.repeat(size > SHORT, size))
        heads, long_ = before[rows] == 0, np.repeat(size, size)[rows]
        own = m[:, :, rows]
        own[:, :, heads] = emit[:, rows[heads]]  # a chain's first position has no transition
        alpha[:, rows] = _scan(own, before[rows], False)[0]
        # of a position, the matrix to the one after it; its last position has none
        to = np.empty_like(own)
        to[:, :, :-1] = own[:, :, 1:]
        to[:, :, before[rows] == long_ - 1] = np.eye(s)[:, :, None]
        beta[:, rows] = _scan(to, long_ - before[rows] - 1, True).sum(1)
    p = alpha * beta
    p /= p.sum(0)
    if not pairs:
        return p.T, None
    inner = np.flatnonzero(before)
    joint = alpha[:, None, inner - 1] * m[:, :, inner] * beta[None, :, inner]
    return p.T, (joint / joint.sum((0, 1))).sum(2)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state) at each position (N, S)."""
    return expectations(emit, first, trans, False)[0]


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best path of one chain."""
    best, back = emit[0], []
    for e in emit[1:]:
        step = best[:, None] + trans
        back.append(step.argmax(0))
        best = step.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def train(features: np.ndarray, first: np.ndarray, evidence: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, enough: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(W (F, S), T (S, S)) that maximise the penalised log-likelihood of what is known about the states.

    ``evidence`` (N, S) are log-probabilities of what was observed at a position given its
    state: 0 for the known state and a very negative number for others where states are
    labelled, less where they are not. The gradient is the difference between expectations
    with and without the evidence, so states that nobody labelled are summed over. Plain
    Adam from zero weights, until no gradient is larger than ``enough`` or for ``rounds``.
    """
    f, states, share = features.shape[1], evidence.shape[1], 1 / max(len(first) - 1, 1)
    w, t = np.zeros((f, states)), np.zeros((states, states))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    features = np.ascontiguousarray(features, np.float64)
    sure = bool(((evidence > -1e8).sum(1) == 1).all())  # what is known does not depend on the weights
    for k in range(1, rounds + 1):
        emit = features @ w
        p, joint = expectations(emit, first, t)
        if k == 1 or not sure:
            known, known_joint = expectations(emit + evidence, first, t)
        gw = features.T @ (known - p) * share - decay * w
        gt = (known_joint - joint) * share - decay * t
        if max(np.abs(gw).max(), np.abs(gt).max()) < enough:
            break
        for x, g, s in ((w, gw, state[0]), (t, gt, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x += rate * (s[0] / (1 - 0.9**k)) / (np.sqrt(s[1] / (1 - 0.99**k)) + 1e-8)
    return w, t
