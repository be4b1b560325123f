"""A small gated recurrent network with class-factored softmax, in numpy.

Targets are (class, word in class): the class is predicted from the state;
within the first ``groups`` classes the word is predicted from the state too
(``size`` words each), within the others it is left to the caller.  Training
is truncated backpropagation: gradients stay inside a window of steps, the
state is carried on to the next window of the same document.

Documents run side by side in lanes; a lane takes one document after the
other and starts each with a zero state.
"""

from __future__ import annotations

import heapq

import numpy as np

_BLOCK = 1024  # tokens whose logits are worked on at a time, so that they stay in the cache
_COUNT = np.arange(2 * _BLOCK)


def shapes(symbols: int, classes: int, groups: int, size: int, embed: int, hidden: int) -> dict[str, tuple]:
    return {"emb": (symbols, embed), "Wx": (embed, 3 * hidden), "U": (hidden, 3 * hidden), "b": (3 * hidden,),
            "Wc": (hidden, classes), "bc": (classes,), "Wo": (groups, size, hidden), "bo": (groups, size)}


def initial(sizes: dict[str, tuple], seed: int, class_bias: np.ndarray, word_bias: np.ndarray) -> dict[str, np.ndarray]:
    """Seeded weights; the output biases are the given log frequencies."""
    r = np.random.default_rng(seed)
    p = {k: (r.standard_normal(s) * (0.3 if k == "emb" else 1.0 / np.sqrt(s[0]) if k in ("Wx", "U") else 0.05)).astype(np.float32)
         for k, s in sizes.items()}
    p["b"][:] = 0
    p["bc"][:] = class_bias
    p["bo"][:] = word_bias
    return p


def pack(p: dict[str, np.ndarray], sizes: dict[str, tuple]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sizes])


def unpack(flat: np.ndarray, sizes: dict[str, tuple]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in sizes.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def lanes(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal documents out to at most ``width`` lanes of similar length.
    Returns the documents in lane order, and each lane's start and length in
    tokens, longest lane first."""
    width = max(1, min(width, len(lengths)))
    heap = [(0, k) for k in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-lengths, kind="stable"):
        load, k = heapq.heappop(heap)
        held[k].append(int(d))
        heapq.heappush(heap, (load + int(lengths[d]), k))
    total = np.array([sum(int(lengths[d]) for d in ds) for ds in held])
    order = np.argsort(-total, kind="stable")
    docs = np.array([d for k in order for d in held[k]], np.int64)
    total = total[order]
    return docs, np.r_[0, np.cumsum(total)[:-1]], total


def _run(p, ids, keep, h, store):
    """States of a window of steps: ids, keep are (steps, lanes).  With
    ``store`` also what each step started from, its two gates, its new part
    and the recurrent input of that, each (steps, lanes, ...)."""
    n, live, hid = len(ids), len(h), h.shape[1]
    # gates and new part apart; the gates' inputs are halved (exactly), as
    # sigmoid(x) = (tanh(x / 2) + 1) / 2
    half = np.array([0.5, 0.5, 1.0], np.float32)[:, None, None]
    by_part = lambda m: np.ascontiguousarray(m.reshape(len(m), 3, hid).transpose(1, 0, 2)) * half
    u_parts, x = by_part(p["U"]), by_part(p["emb"] @ p["Wx"] + p["b"]).take(ids, axis=1)
    out = np.empty((n, live, hid), np.float32)
    kept = n if store else 1  # without ``store`` each step overwrites the one before
    before, new, last = (np.empty((kept, live, hid), np.float32) for _ in range(3))
    gates, u = np.empty((2, kept, live, hid), np.float32), np.empty((3, live, hid), np.float32)
    whole = keep.all(axis=1)
    for t in range(n):
        if not whole[t]:
            h = h * keep[t][:, None]
        k = t if store else 0
        np.matmul(h, u_parts, out=u)
        g, c = gates[:, k], new[k]
        np.add(u[:2], x[:2, t], out=g)
        np.tanh(g, out=g)
        g += 1.0
        g *= np.float32(0.5)
        np.multiply(g[1], u[2], out=c)
        c += x[2, t]
        np.tanh(c, out=c)
        if store:
            before[t], last[t] = h, u[2]
        np.subtract(h, c, out=out[t])
        out[t] *= g[0]
        out[t] += c
        h = out[t]
    return out, h, (before, gates, new, last)


def _by_class(cls: np.ndarray, groups: int):
    """Positions of the targets that have a word softmax, sorted by class,
    and (class, from, to) of each run among them."""
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(groups + 1))
    runs = [(k, int(edge[k]), int(edge[k + 1])) for k in range(groups) if edge[k] < edge[k + 1]]
    return order[:edge[-1]], runs


def _tame(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether logits of ``w`` (..., hidden, words) and ``b`` stay below
    overflow, whatever the state (states lie in [-1, 1])."""
    return np.abs(w).sum(axis=-2).max(axis=-1) + b.max(axis=-1) <= 80.0


def _softmax(s: np.ndarray, w: np.ndarray, b: np.ndarray, tame: bool, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits of states ``s`` and its row sums; logits that are
    not ``tame`` are kept below overflow."""
    x = np.matmul(s, w, out=out)
    x += b
    if not tame:
        np.minimum(x, 80.0, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], np.float32)


def _blocks(n: int) -> list[slice]:
    """``n`` tokens in blocks; the last takes what is left over as well (a
    product of very few rows is summed in another order)."""
    edges = [*range(0, max(n // _BLOCK, 1) * _BLOCK, _BLOCK), n]
    return [slice(i, j) for i, j in zip(edges[:-1], edges[1:])]


def _log_softmax(s, w, b, target, tame) -> np.ndarray:
    """Log probability of ``target``."""
    out = np.empty(len(s), np.float32)
    for rows in _blocks(len(s)):
        e, sums = _softmax(s[rows], w, b, tame)
        out[rows] = e[_COUNT[:len(e)], target[rows]] / sums
    out += 1e-30
    return np.log(out, out=out)


def _softmax_gradient(s, w, b, target, n, tame, ds):
    """Gradients by weights and biases of the mean over ``n`` tokens of the
    log loss of ``target``; that by states goes to ``ds``."""
    d, scale = np.empty((len(s), len(b)), np.float32), np.empty((len(s), 1), np.float32)
    for rows in _blocks(len(s)):
        part = d[rows]
        _, sums = _softmax(s[rows], w, b, tame, part)
        part[_COUNT[:len(part)], target[rows]] -= sums
        np.divide(1.0, n * sums, out=scale[rows, 0])
        np.multiply(part @ w.T, scale[rows], out=ds[rows])
    return (s * scale).T @ d, (scale.T @ d)[0]


def _windows(start, total, steps, longest=128):
    """(token places, valid, lanes) of each window; places are (steps, lanes).
    Where only a few long lanes are left, windows are longer, up to
    ``longest``, so that they hold about as many tokens."""
    t0, width = 0, len(total)
    while width and t0 < total[0]:
        live = int(np.searchsorted(-total, -t0, side="left"))  # lanes longer than t0
        n = min(max(steps, min(longest, steps * width // live)), int(total[0]) - t0)
        at = start[None, :live] + np.arange(t0, t0 + n)[:, None]
        ok = np.arange(t0, t0 + n)[:, None] < total[None, :live]
        yield np.where(ok, at, 0), ok, live
        t0 += n


def _valid(at, ok, s):
    """Places and states of the valid steps, flat."""
    return (at.ravel(), s.reshape(-1, s.shape[2])) if ok.all() else (at[ok], s[ok])


def score(p, symbols, cls, word, first, start, total, steps=32) -> np.ndarray:
    """Natural-log probability of each token (flat, in lane order)."""
    groups, hid = len(p["Wo"]), p["U"].shape[0]
    out = np.zeros(len(symbols), np.float32)
    h = np.zeros((len(total), hid), np.float32)
    by_state = p["Wo"].transpose(0, 2, 1)
    tame, words_tame = _tame(p["Wc"], p["bc"]), _tame(by_state, p["bo"])
    for at, ok, live in _windows(start, total, steps):
        s, h, _ = _run(p, symbols[at], (~first[at]).astype(np.float32), h[:live], False)
        places, s = _valid(at, ok, s)
        c = cls[places]
        lp = _log_softmax(s, p["Wc"], p["bc"], c, tame)
        order, runs = _by_class(c, groups)
        s, w, near = s[order], word[places[order]], np.empty(len(order), np.float32)
        for k, lo, hi in runs:
            near[lo:hi] = _log_softmax(s[lo:hi], by_state[k], p["bo"][k], w[lo:hi], words_tame[k])
        lp[order] += near
        out[places] = lp
    return out


def train(p, symbols, cls, word, first, start, total, adam, rate, steps=16, clip=1.0) -> None:
    """One pass of truncated backpropagation; changes ``p`` and ``adam``."""
    groups, hid = len(p["Wo"]), p["U"].shape[0]
    h = np.zeros((len(total), hid), np.float32)
    thrice = np.tile(np.eye(hid, dtype=np.float32), 3)
    for at, ok, live in _windows(start, total, steps):
        ids, keep = symbols[at], (~first[at]).astype(np.float32)
        s, h, saved = _run(p, ids, keep, h[:live], True)
        places, flat = _valid(at, ok, s)
        c, n = cls[places], len(places)
        g = {k: np.zeros_like(v) for k, v in p.items() if k in ("Wo", "bo")}
        ds = np.empty_like(flat)
        g["Wc"], g["bc"] = _softmax_gradient(flat, p["Wc"], p["bc"], c, n, _tame(p["Wc"], p["bc"]), ds)
        order, runs = _by_class(c, groups)
        near, w, dn = flat[order], word[places[order]], np.empty((len(order), hid), np.float32)
        by_state = p["Wo"].transpose(0, 2, 1)
        tame = _tame(by_state, p["bo"])
        for k, lo, hi in runs:
            by_word, g["bo"][k] = _softmax_gradient(near[lo:hi], by_state[k], p["bo"][k], w[lo:hi], n, tame[k], dn[lo:hi])
            g["Wo"][k] = by_word.T
        ds[order] += dn
        if len(ds) == ok.size:
            back = ds.reshape(s.shape)
        else:
            back = np.zeros_like(s)
            back[ok] = ds
        before, (z, r), new, last = saved
        # what the loss by a state is multiplied with on its way to each input
        by = np.empty(ids.shape + (3 * hid,), np.float32)
        rest, to_new = 1.0 - z, new * new
        np.subtract(1.0, to_new, out=to_new)
        to_new *= rest
        to_z = before - new
        to_z *= z
        np.multiply(to_z, rest, out=by[..., :hid])
        last *= to_new
        last *= r
        np.subtract(1.0, r, out=rest)
        np.multiply(last, rest, out=by[..., hid:2 * hid])
        by[..., 2 * hid:] = to_new
        to_u = np.ones_like(by)  # and from there to the recurrent input
        to_u[..., 2 * hid:] = r
        dx = np.empty_like(by)
        du = np.empty_like(by)
        dh, back_u, whole = np.zeros((live, hid), np.float32), p["U"].T.copy(), keep.all(axis=1)
        for t in range(len(ids) - 1, -1, -1):
            dh += back[t]
            np.matmul(dh, thrice, out=dx[t])
            dx[t] *= by[t]
            np.multiply(dx[t], to_u[t], out=du[t])
            dh *= z[t]
            dh += du[t] @ back_u
            if not whole[t]:
                dh *= keep[t][:, None]
        dx, du = dx.reshape(-1, 3 * hid), du.reshape(-1, 3 * hid)
        g["U"] = before.reshape(-1, hid).T @ du
        g["b"] = dx.sum(axis=0)
        # gradients of the projected embeddings, summed by symbol
        flat_ids = ids.ravel()
        order = np.argsort(flat_ids, kind="stable")
        in_order = flat_ids[order]
        at0 = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
        summed = np.zeros((len(p["emb"]), 3 * hid), np.float32)
        summed[in_order[at0]] = np.add.reduceat(dx.take(order, axis=0), at0, axis=0)
        g["Wx"] = p["emb"].T @ summed
        g["emb"] = summed @ p["Wx"].T
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        # a window of few tokens (the end of the longest lanes) takes a small step
        _adam(p, g, adam, rate * min(1.0, 2 * n / (len(total) * steps)), min(1.0, clip / (norm + 1e-12)))


def _adam(p, g, state, rate, scale, b1=0.9, b2=0.99) -> None:
    state["t"] = t = state.get("t", 0) + 1
    step = rate * np.sqrt(1 - b2 ** t) / (1 - b1 ** t)
    for k, v in g.items():
        m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
        v = v * np.float32(scale)
        m += (1 - b1) * (v - m)
        s += (1 - b2) * (v * v - s)
        p[k] -= (step * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
