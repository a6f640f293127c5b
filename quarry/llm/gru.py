"""A gated recurrent language model in numpy with a class-factored softmax.

Words are numbered by frequency; word w belongs to class w // SIZE, and
P(w) = P(class | state) * P(w | class, state). Training is truncated
backpropagation through windows of a stream of documents; the state is carried
from window to window, forwards only, and starts anew after each end token.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, SIZE = 16, 64, 64
WORDS = CLASSES * SIZE
END, RARE = 0, 1
NAMES = ["x", "u", "v", "wc", "bc", "ww", "bw"]
PIECE = 1024       # rows of logits in one go
_ROWS = np.arange(PIECE)


def fresh(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights whose output, before any training, is the smoothed frequencies
    ``counts`` (one for each of WORDS; numbers without a word have none)."""
    rng = np.random.default_rng(seed)

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(HIDDEN)).astype(np.float32)

    mass = np.where(counts > 0, counts + 0.5, 1e-9).reshape(CLASSES, SIZE)
    mass[0, :2] += 0.5  # the end and rare words always exist
    return {
        "x": small(WORDS, 3 * HIDDEN) * 0.5, "u": small(HIDDEN, 2 * HIDDEN), "v": small(HIDDEN, HIDDEN),
        "wc": small(HIDDEN, CLASSES) * 0.1, "bc": np.log(mass.sum(1)).astype(np.float32),
        "ww": small(CLASSES, HIDDEN, SIZE) * 0.1,
        "bw": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)}


def _sigmoid(a: np.ndarray) -> None:
    """In place."""
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5


def _kept(ids: np.ndarray, kind: np.dtype) -> np.ndarray:
    """1 where the state before an input goes on, 0 where it starts anew."""
    return (ids != END)[..., None].astype(kind)


def states(p: dict, ids: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (T, B, HIDDEN) after each of the inputs ``ids`` (T, B), from ``h``."""
    x, u, v = p["x"], p["u"], p["v"]
    keep = _kept(ids, x.dtype)
    out = np.empty((*ids.shape, HIDDEN), dtype=x.dtype)
    for t in range(len(ids)):
        a = x.take(ids[t], axis=0)
        h = h * keep[t]
        gates = h @ u
        gates += a[:, :2 * HIDDEN]
        _sigmoid(gates)
        r, z = gates[:, :HIDDEN].copy(), gates[:, HIDDEN:].copy()
        rh = r * h
        n = rh @ v
        n += a[:, 2 * HIDDEN:]
        np.tanh(n, out=n)
        if trace is not None:
            trace.append((h, r, z, rh, n))
        after = out[t]
        np.subtract(h, n, out=after)
        after *= z
        after += n
        h = after
    return out


def _softmax_parts(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray,
                   e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P of entry ``at`` of each row of ``h @ w + b``, and the sums of the
    rows' exponentials, which are left in ``e``. After the product, worked off
    in pieces that stay in the processor's cache.

    States lie in (-1, 1) and weights are small, so logits stay far below what
    float32 can take; no maximum needs to be taken off.
    """
    own, total = np.empty(len(h), dtype=e.dtype), np.empty(len(h), dtype=e.dtype)
    np.matmul(h, w, out=e)
    for a in range(0, len(h), PIECE):
        some = slice(a, a + PIECE)
        logits = e[some]
        logits += b
        own[some] = logits[_ROWS[:len(logits)], at[some]]
        np.exp(logits, out=logits)
        np.add.reduce(logits, axis=1, out=total[some])
    own -= np.log(total)
    return own, total


def _slope(e: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
    e /= total[:, None]
    e.ravel()[np.arange(0, e.size, e.shape[1]) + at] -= 1
    return e


def log_likelihood(p: dict, h: np.ndarray, targets: np.ndarray, grads: dict | None = None):
    """ln P of each target from its state (N, HIDDEN). With ``grads``, adds the
    output layer's gradients of the summed loss there and returns the states'
    gradient as well."""
    order = np.argsort(targets.astype(np.int16), kind="stable")  # WORDS fit; so short a type sorts by radix
    h, sorted_targets = h.take(order, axis=0), targets[order]
    group, slot = sorted_targets // SIZE, sorted_targets % SIZE
    e = np.empty((len(h), CLASSES), dtype=np.result_type(h, p["wc"]))
    found, total = _softmax_parts(h, p["wc"], p["bc"], group, e)
    dh = None
    if grads is not None:
        d = _slope(e, total, group)
        grads["wc"] += h.T @ d
        grads["bc"] += d.sum(0)
        dh = d @ p["wc"].T
    e = np.empty((len(h), SIZE), dtype=e.dtype)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        a, b = cuts[c], cuts[c + 1]
        if a == b:
            continue
        own, at, w = h[a:b], slot[a:b], p["ww"][c]
        more, total = _softmax_parts(own, w, p["bw"][c], at, e[a:b])
        found[a:b] += more
        if grads is not None:
            d = _slope(e[a:b], total, at)
            grads["ww"][c] += own.T @ d
            grads["bw"][c] += d.sum(0)
            dh[a:b] += d @ w.T
    out = np.empty_like(found)
    out[order] = found
    if grads is None:
        return out
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


def train(p: dict, stream: np.ndarray, batch: int = 64, window: int = 16, rate: float = 0.1, epochs: int = 1) -> None:
    """Adagrad over ``stream`` (word numbers, each document closed by END),
    read as ``batch`` parallel parts in windows; changes ``p``. The last part
    is filled up from the stream's start."""
    length = -(-len(stream) // batch)
    if length < 2:
        return
    parts = np.resize(stream, length * batch).reshape(batch, length).T
    seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    for _ in range(epochs):
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        for at in range(0, length - 1, window):
            ids, targets = parts[at:at + window], parts[at + 1:at + window + 1]
            ids = ids[:len(targets)]
            trace: list = []
            hs = states(p, ids, h, trace)
            h = hs[-1]
            g = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
            _, dout = log_likelihood(p, hs.reshape(-1, HIDDEN), targets.ravel(), g)
            dout = dout.reshape(hs.shape)
            keep = _kept(ids, p["x"].dtype)
            back = np.zeros_like(h)
            da = np.empty((*ids.shape, 3 * HIDDEN), dtype=np.float32)
            for t in range(len(ids) - 1, -1, -1):
                before, r, z, rh, n = trace[t]
                both = da[t, :, :2 * HIDDEN]
                d = dout[t]
                d += back
                rest = 1 - z
                dz = before - n
                dz *= d
                dz *= z
                dz *= rest
                both[:, HIDDEN:] = dz
                dn = rest
                dn *= d
                n *= n
                dn *= np.subtract(1, n, out=n)
                da[t, :, 2 * HIDDEN:] = dn
                drh = dn @ p["v"].T
                dr = drh * before
                dr *= r
                dr *= 1 - r
                both[:, :HIDDEN] = dr
                g["v"] += rh.T @ dn
                g["u"] += before.T @ both
                d *= z
                drh *= r
                d += drh
                d += both @ p["u"].T
                d *= keep[t]
                back = d
            # Only the rows of words in the window have a gradient.
            order = np.argsort(ids.astype(np.int16), axis=None, kind="stable")
            words = ids.ravel()[order]
            starts = np.flatnonzero(np.diff(words, prepend=-1))
            rows = words[starts]
            columns = np.ascontiguousarray(da.reshape(-1, 3 * HIDDEN).take(order, axis=0).T)
            g["x"] = np.ascontiguousarray(np.add.reduceat(columns, starts, axis=1).T)
            scale = 1.0 / batch
            for k, v in p.items():
                step = g[k]
                step *= scale
                np.clip(step, -1, 1, out=step)
                if k == "x":
                    total = seen[k].take(rows, axis=0)
                    total += step * step
                    seen[k][rows] = total
                else:
                    total = seen[k]
                    total += step * step
                step *= rate
                step /= np.sqrt(total)
                if k == "x":
                    v[rows] -= step
                else:
                    v -= step


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the lane that ends first;
    lanes by falling length."""
    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        end, i = heapq.heappop(heap)
        dealt[i].append(d)
        heapq.heappush(heap, (end + int(lengths[d]), i))
    return [dealt[i] for _, i in sorted(heap, reverse=True)]


def score(p: dict, documents: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """ln P of each complete document (word numbers, END last).

    Documents follow one another in ``lanes`` that run side by side, in windows
    whose state goes on to the next and starts anew after each END: what a long
    document costs in steps is shared by all that run beside it.
    """
    documents = [np.asarray(d, dtype=np.int32) for d in documents]
    out = np.zeros(len(documents))
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    if not lengths.sum():
        return out
    dealt = lanes_of(lengths, lanes)
    order = [d for lane in dealt for d in lane]
    # What stands before a document's first word is an END, also at a lane's start.
    flat = np.concatenate([[END], *[documents[d] for d in order]]).astype(np.int32)
    owner = np.repeat(order, lengths[order])
    total = np.array([lengths[lane].sum() for lane in dealt])
    first = np.cumsum(total) - total
    h = np.zeros((len(dealt), HIDDEN), dtype=np.float32)
    for start in range(0, int(total[0]), window):
        live = int((total > start).sum())
        steps = min(window, int(total[0]) - start)
        at = first[:live] + start + np.arange(steps)[:, None]
        real = at < (first + total)[:live]
        at = np.minimum(at, len(owner) - 1)  # what stands after a lane's end is not counted
        ids = flat[at]
        if not start:
            ids[0] = END
        hs = states(p, ids, h[:live])
        h = hs[-1]
        found = at[real]
        ll = log_likelihood(p, hs[real], flat[found + 1])
        out += np.bincount(owner[found], weights=ll, minlength=len(out))
    return out
