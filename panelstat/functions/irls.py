"""Batched binomial-logit fits on small design cells, as an Arrow function over many fits at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000  # design numbers held dense at a time


def expand(X: np.ndarray, terms: str) -> np.ndarray:
    """Columns of the linear predictor: the deltas, their sum, or the deltas with all products."""
    if terms == "base":
        return X
    if terms == "sum":
        return X.sum(axis=2, keepdims=True)
    if terms == "interaction":
        i, j = np.triu_indices(X.shape[2], k=1)
        return np.concatenate([X, X[:, :, i] * X[:, :, j]], axis=2)
    raise ValueError(f"unknown terms {terms!r}")


def _loglik(eta, n, s):
    return (s * eta - n * np.logaddexp(0.0, eta)).sum(axis=1)


def fit(X, n, s, ridge=None, max_iter=100, tol=1e-14):
    """Newton steps for G fits at once: X (G, C, P), trials n and successes s (G, C).

    Returns coefficients, information matrices, log likelihoods (without constants) and a flag per
    fit. Rank-deficient designs get the minimum-norm step; a step that lowers the objective is halved.
    """
    G, _, P = X.shape
    lam = np.zeros(P) if ridge is None else ridge
    beta = np.zeros((G, P))

    XT = X.transpose(0, 2, 1)

    def predict(b):
        return (X @ b[:, :, None])[:, :, 0]

    def objective(b):
        return _loglik(predict(b), n, s) - 0.5 * (lam * b * b).sum(axis=1)

    def information(b):
        mu = 0.5 * (1.0 + np.tanh(0.5 * predict(b)))
        w = n * mu * (1.0 - mu)
        return mu, (XT * w[:, None, :]) @ X

    current = objective(beta)
    done = np.zeros(G, dtype=bool)
    for _ in range(max_iter):
        live = ~done
        if not live.any():
            break
        mu, info = information(beta)
        grad = (XT @ (s - n * mu)[:, :, None])[:, :, 0] - lam * beta
        step = (np.linalg.pinv(info + np.diag(lam), rcond=1e-10, hermitian=True) @ grad[:, :, None])[:, :, 0]
        step[done] = 0.0
        for _ in range(30):
            new = objective(beta + step)
            worse = live & (new < current - 1e-9 * (1 + np.abs(current)))
            if not worse.any():
                break
            step[worse] *= 0.5
        beta = beta + step
        done |= np.abs(new - current) <= tol * (1 + np.abs(new))
        current = new
    _, info = information(beta)
    return beta, info, _loglik(predict(beta), n, s), done


def fit_shared(cells, n, s, start=None, max_iter=30):
    """Coefficients of many fits on the same cells (C, P) with trials and successes (G, C): plain Newton steps as matrix products.

    Fits whose steps do not settle that way, and those of designs without full rank, are made by ``fit``.
    """
    P = cells.shape[1]
    products = (cells[:, :, None] * cells[:, None, :]).reshape(len(cells), P * P)
    beta = np.zeros((len(n), P)) if start is None else np.broadcast_to(start, (len(n), P)).copy()
    live = np.arange(len(n))
    settled = np.zeros(len(n), bool)
    for _ in range(max_iter):
        if not len(live):
            break
        mu = 0.5 * (1.0 + np.tanh(0.5 * (beta[live] @ cells.T)))
        info = ((n[live] * mu * (1.0 - mu)) @ products).reshape(-1, P, P)
        sound = np.linalg.cond(info) < 1e9
        live, mu, info = live[sound], mu[sound], info[sound]
        if not len(live):
            break
        step = np.linalg.solve(info, ((s[live] - n[live] * mu) @ cells)[:, :, None])[:, :, 0]
        beta[live] += step
        done = np.abs(step).max(axis=1) <= 1e-10
        settled[live[done]] = True
        live = live[~done & (np.abs(beta[live]).max(axis=1) < 50)]
    rest = np.flatnonzero(~settled)
    if len(rest):
        beta[rest] = fit(np.broadcast_to(cells, (len(rest), *cells.shape)), n[rest], s[rest])[0]
    return beta


# most that a member may move a fit's predictors, and hold of its weakest direction, to be left out by steps from the whole fit
NEAR, LIGHT = 5e-3, 0.05


def fit_without(cells, n, s, beta, who, at, own_n, own_s, n_members, max_iter=12):
    """Fits of the cells (C, P), trials and successes (C,), without each of their members, by steps from the fit ``beta`` of all.

    A member's trials and successes are the entries (who, cell at, own_n, own_s). Its score is summed over its own cells; that of the
    whole is expanded to the third order around ``beta``, so no fit reads all cells. Returns coefficients (members, P) and which
    of them have settled: members that hold little of the information in every direction and move no predictor by more
    than NEAR, where the expansion's rest is below 1e-10 of a coefficient. The others are to be fitted by themselves.
    """
    P = cells.shape[1]
    out, settled = np.tile(beta, (n_members, 1)), np.zeros(n_members, bool)
    eta = cells @ beta
    mu = 0.5 * (1.0 + np.tanh(0.5 * eta))
    w = mu * (1.0 - mu)
    two = (cells[:, :, None] * cells[:, None, :]).reshape(len(cells), P * P)
    info = ((n * w) @ two).reshape(P, P)
    size = np.linalg.eigvalsh(info)
    if not (size[0] > 0 and size[-1] < 1e4 * size[0]):
        return out, settled
    score = (s - n * mu) @ cells
    third = (two.T @ ((n * w * (1.0 - 2.0 * mu))[:, None] * cells)).reshape(P, P * P)
    fourth = (two.T @ ((n * w * (1.0 - 6.0 * w))[:, None] * two)).reshape(P, P * P * P)

    def summed(x):
        return np.stack([np.bincount(who, c, n_members) for c in x.T], axis=1)

    i, j = np.triu_indices(P)
    upper = summed((w[:, None] * two[:, i * P + j])[at] * own_n[:, None])
    held = np.zeros((n_members, P, P))
    held[:, i, j] = held[:, j, i] = upper
    light = np.trace(held, axis1=1, axis2=2) <= LIGHT * size[0]
    inverse = np.linalg.inv(info - np.where(light[:, None, None], held, 0.0))
    x, base = cells[at], eta[at]
    delta, last = np.zeros((n_members, P)), np.full(n_members, np.inf)
    for _ in range(max_iter):
        pairs = (delta[:, :, None] * delta[:, None, :]).reshape(n_members, P * P)
        triples = (pairs[:, :, None] * delta[:, None, :]).reshape(n_members, P * P * P)
        whole = score - delta @ info - pairs @ third.T / 2.0 - triples @ fourth.T / 6.0
        own = summed((own_s - own_n * 0.5 * (1.0 + np.tanh(0.5 * (base + (x * delta[who]).sum(axis=1)))))[:, None] * x)
        step = (inverse @ (whole - own)[:, :, None])[:, :, 0]
        delta += step
        last = np.abs(step).max(axis=1)
        # far ones are not followed, so that they cannot hold up the others
        light &= np.abs(delta) @ np.abs(cells).max(axis=0) <= NEAR
        delta[~light] = 0.0
        if not (light & (last > 1e-11)).any():
            break
    settled = light & (last <= 1e-11)
    out[settled] += delta[settled]
    return out, settled


SEPARATED = 1e-8


def separated(X, n, info):
    """Which fits have no finite maximum: along some direction of the design the outcomes are told apart.

    Newton's steps then push the fitted shares of all cells that the direction moves to 0 or 1. So the information along it, relative to
    that of shares at one half or the like, falls below any bound, while a finite maximum keeps it above the inverse of the trials.
    Directions that no cell moves do not count. Covers complete and quasi-complete separation.
    """
    whole = (X.transpose(0, 2, 1) * n[:, None, :]) @ X
    size, axes = np.linalg.eigh(whole)
    moved = size > 1e-10 * np.maximum(size[:, -1:], 1e-300)
    scale = np.where(moved, 1 / np.sqrt(np.where(moved, size, 1.0)), 0.0)
    inner = axes.transpose(0, 2, 1) @ info @ axes * scale[:, :, None] * scale[:, None, :]
    inner = inner + np.eye(X.shape[2]) * ~moved[:, None, :]
    return np.linalg.eigvalsh(inner)[:, 0] < SEPARATED


def _dense(col: pa.ListArray, lo: int, hi: int):
    """Pad the cell lists of rows lo..hi-1 to one dense block."""
    part = pa.concat_arrays([col.slice(lo, hi - lo)])
    lengths = np.diff(part.offsets.to_numpy())
    flat = part.flatten()
    fields = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)], axis=1)
    g = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    c = np.arange(len(fields)) - np.repeat(starts, lengths)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=1)), 1), fields.shape[1]))
    out[g, c] = fields
    return out


def fit_batches(terms: str, ridges: list[float], n_attributes: int, sandwich: bool):
    """Arrow function: rows carrying a ``cells`` list become rows carrying a fit.

    A cell is (delta per attribute, trials, successes, trials * share squared). Without variation in
    the outcome or the design the coefficients are zero by definition. ``ridges`` are tried in turn,
    on the product terms only, for fits that do not converge.
    """

    def run(batches):
        for batch in batches:
            col = batch.column("cells")
            keep = [i for i, f in enumerate(batch.schema.names) if f != "cells"]
            lengths = np.diff(col.offsets.to_numpy())
            width = max(int(lengths.max(initial=1)), 1) * 10
            size = max(1, CHUNK // width)
            for lo in range(0, batch.num_rows, size):
                hi = min(lo + size, batch.num_rows)
                cells = _dense(col, lo, hi)
                raw, n, s, q = cells[:, :, :n_attributes], cells[:, :, -3], cells[:, :, -2], cells[:, :, -1]
                X = expand(raw, terms)
                P = X.shape[2]
                beta, info, ll, ok = fit(X, n, s)
                penalty = np.zeros(len(beta))
                for lam in ridges:
                    again = ~ok
                    if not again.any():
                        break
                    weights = np.where(np.arange(P) >= n_attributes, lam, 0.0)
                    b2, i2, l2, o2 = fit(X[again], n[again], s[again], weights)
                    beta[again], info[again], ll[again], ok[again] = b2, i2, l2, o2
                    penalty[again] = lam
                total, hits = n.sum(axis=1), s.sum(axis=1)
                flat_y = (hits == 0) | (hits == total)
                flat_x = ~(raw * (n > 0)[:, :, None]).any(axis=(1, 2))
                status = np.where(flat_y, "constant_outcome", np.where(flat_x, "constant_design", np.where(ok, "converged", "not_converged")))
                zero = flat_y | flat_x
                inverse = np.linalg.pinv(info, rcond=1e-10, hermitian=True)
                if sandwich:
                    mu = 0.5 * (1.0 + np.tanh(0.5 * (X @ beta[:, :, None])[:, :, 0]))
                    meat = (X.transpose(0, 2, 1) * (q - 2 * mu * s + mu * mu * n)[:, None, :]) @ X
                    robust = inverse @ meat @ inverse
                else:
                    robust = inverse
                lists = lambda m: pa.array(list(m.reshape(len(m), -1)), pa.list_(pa.float64()))
                head = [batch.column(i).slice(lo, hi - lo) for i in keep]
                fitted = [
                    pa.array(status), lists(np.where(zero[:, None], 0.0, beta)), lists(beta), lists(inverse),
                    lists(robust), pa.array(ll), pa.array(penalty),
                ]
                names = [batch.schema.names[i] for i in keep] + ["status", "beta", "raw_beta", "inverse", "robust", "loglik", "penalty"]
                yield pa.RecordBatch.from_arrays(head + fitted, names=names)

    return run
