"""A character-level bidirectional LSTM with CRF transitions, in numpy alone.

Input characters index a learned table that already holds their contribution to the gates, so a
step is one look-up and one product with the hidden state. Sequences of similar length share a
batch. The gates are piecewise linear (clipped), which costs a tenth of exact sigmoids. Training is plain back-propagation through time with Adam on the CRF's likelihood.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

LABELS = ("O", "email", "phone", "id_no", "address", "person")
K = len(LABELS)
#: Characters with an own table row; digits share one, the rest is unknown (0).
ALPHABET = "0abcçdefgğhıijklmnoöpqrsştuüvwxyzâîûABCÇDEFGĞHIİJKLMNOÖPQRSŞTUÜVWXYZÂÎÛ \n\t.,;:!?'’\"`()[]{}<>/\\|-–_*#@+=&%$^~"
MODEL = Path(__file__).with_name("pii_model.npz")


def _codes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i, c in enumerate(ALPHABET, 1):
        table[ord(c)] = i
    table[ord("0") : ord("9") + 1] = 1
    table[0xA0] = table[ord(" ")]
    return table


_TABLE = _codes()
VOCAB = len(ALPHABET) + 1


def code(text: str) -> np.ndarray:
    """Table rows of a text's characters, one per code point."""
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    x = np.zeros((len(seqs), n.max()), np.int64)
    for i, s in enumerate(seqs):
        x[i, : len(s)] = s
    return x, n


def _flip(n: np.ndarray, t: int) -> np.ndarray:
    """Positions that reverse each row's first n entries and leave the padding."""
    i = np.arange(t)[None, :]
    return np.where(i < n[:, None], n[:, None] - 1 - i, i)


class Model:
    def __init__(self, hidden: int = 20, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        h = self.hidden = hidden
        g = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"tf": g(VOCAB, 4 * h), "uf": g(h, 4 * h), "tb": g(VOCAB, 4 * h), "ub": g(h, 4 * h), "wf": g(h, K), "wb": g(h, K), "b": np.zeros(K, np.float32), "a": np.zeros((K, K), np.float32)}
        for k in ("tf", "tb"):
            self.p[k][:, h : 2 * h] += 1.5  # remember at first

    def save(self, path: Path = MODEL) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: Path = MODEL) -> Model:
        with np.load(path) as f:
            m = cls(f["uf"].shape[0])
            m.p = {k: f[k].astype(np.float32) for k in f.files}
        return m

    def _direction(self, x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = self.hidden
        n, t_max = x.shape
        # the slope and the middle of the clipped gates go into the look-ups once, not into every step
        scale = np.repeat(np.array([0.25, 1], table.dtype), [3 * h, h])
        table, u = table * scale + np.repeat(np.array([0.5, 0], table.dtype), [3 * h, h]), u * scale
        kind = table.dtype
        state, cell = np.zeros((n, h), kind), np.zeros((n, h), kind)
        out = np.empty((t_max, n, h), kind)
        one = kind.type(1)
        low = np.repeat(np.array([0, -1], kind), [3 * h, h])
        z, r = np.empty((n, 4 * h), kind), np.empty((n, 4 * h), kind)
        columns = np.ascontiguousarray(x.T)
        for t in range(t_max):
            if keep is not None:
                z = np.empty((n, 4 * h), kind)
            np.take(table, columns[t], axis=0, out=z, mode="clip")
            np.matmul(state, u, out=r)
            np.add(z, r, out=z)
            np.maximum(z, low, out=z)
            np.minimum(z, one, out=z)
            before = cell
            cell = z[:, h : 2 * h] * cell
            cell += z[:, :h] * z[:, 3 * h :]
            tc = np.minimum(np.maximum(cell, -one), one)
            if keep is not None:
                keep.append((z, before, tc, state, cell))
            state = np.multiply(z[:, 2 * h : 3 * h], tc, out=out[t])
        return out.transpose(1, 0, 2)

    def emissions(self, x: np.ndarray, n: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        p, flip = self.p, _flip(n, x.shape[1])
        hf = self._direction(x, p["tf"], p["uf"], keep and keep[0])
        hb = self._direction(np.take_along_axis(x, flip, 1), p["tb"], p["ub"], keep and keep[1])
        hb = np.take_along_axis(hb, flip[:, :, None], 1)
        self._last = (hf, hb, flip)
        return hf @ p["wf"] + hb @ p["wb"] + p["b"]

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The emissions (position, label, row), both directions in one loop; ``x`` and ``n`` as from ``pad``."""
        p, h = self.p, self.hidden
        rows, t_max = x.shape
        kind = p["tf"].dtype
        scale, mid = np.repeat(np.array([0.25, 1], kind), [3 * h, h]), np.repeat(np.array([0.5, 0], kind), [3 * h, h])
        # a row that closes every gate stands for padding: the state stays zero until the reading backward meets the text
        stop = np.full((1, 4 * h), -1e9, kind)
        table = np.concatenate([p["tf"] * scale + mid, stop, p["tb"] * scale + mid, stop])
        u = np.stack([p["uf"] * scale, p["ub"] * scale])
        c = np.where(np.arange(t_max)[:, None] < n, x.T, VOCAB)
        columns = np.stack([c, c[::-1] + VOCAB + 1], 1)
        # bounds as whole arrays: numpy's minimum and maximum are several times slower against a single number
        low, high = np.zeros((2, rows, 4 * h), kind), np.ones((2, rows, 4 * h), kind)
        low[..., 3 * h :] = -1
        least, most = np.full((2, rows, h), -1, kind), np.ones((2, rows, h), kind)
        state, cell, new = np.zeros((2, rows, h), kind), np.zeros((2, rows, h), kind), np.empty((2, rows, h), kind)
        z, r = np.empty((2, rows, 4 * h), kind), np.empty((2, rows, 4 * h), kind)
        i, f, o, g = (z[..., k * h : (k + 1) * h] for k in range(4))
        # states are weighed some steps at a time, while the cache has them
        out = np.empty((32, 2, rows, h), kind)
        e = np.empty((t_max, K, rows), kind)
        e[:] = p["b"][:, None]
        for t in range(t_max):
            at = t % len(out)
            table.take(columns[t], axis=0, out=z, mode="clip")
            np.matmul(state, u, out=r)
            np.add(z, r, out=z)
            np.maximum(z, low, out=z)
            np.minimum(z, high, out=z)
            np.multiply(cell, f, out=cell)
            np.multiply(i, g, out=new)
            np.add(cell, new, out=cell)
            np.maximum(cell, least, out=new)
            np.minimum(new, most, out=new)
            state = np.multiply(o, new, out=out[at])
            if at == len(out) - 1 or t == t_max - 1:
                past = out[: at + 1].transpose(1, 0, 3, 2)
                e[t - at : t + 1] += np.matmul(p["wf"].T, past[0])
                e[t_max - 1 - t : t_max - t + at] += np.matmul(p["wb"].T, past[1, ::-1])
        return e

    def _live(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a row's best path can hold an item at all: some run of labels could beat the path outside throughout.

        A run gains at most its places' best labels and the best transitions into, within and out of runs. The bound is
        exact: where no run exceeds nought, neither does a path of several.
        """
        a = self.p["a"] - self.p["a"][0, 0]
        enter, stay, leave = a[0, 1:].max(), a[1:, 1:].max(), a[1:, 0].max()
        run = e[:, 1:].max(1) - e[:, 0]
        for t in range(1, len(run)):
            run[t] += np.maximum(run[t - 1] + stay, enter)
        out = (run + leave > -1e-3) & (np.arange(len(run))[:, None] < n)
        # a run that the end of the row cuts off has no way out
        return out.any(0) | (run[n - 1, np.arange(len(n))] > -1e-3)

    def decode(self, seqs: list[np.ndarray], batch: int = 16_384, inner: int = 384) -> list[np.ndarray]:
        """The best label sequence of each input under the CRF."""
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        out: list = [None] * len(seqs)
        for k in range(0, len(order), batch):
            hold, live = [], []
            # states of a few hundred rows stay in the cache
            for i in range(k, min(k + batch, len(order)), inner):
                part = order[i : i + inner]
                x, n = pad([seqs[j] for j in part])
                e = self.scores(x, n)
                some = self._live(e, n)
                for r, j in enumerate(part):
                    if some[r]:
                        hold.append(e[: n[r], :, r].T.copy())
                        live.append(j)
                    else:
                        out[j] = np.zeros(n[r], np.uint8)
            for j, lab in zip(live, self._viterbi(hold) if hold else []):
                out[j] = lab
        return out

    def _viterbi(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The best path through the scores (label, length) of each input."""
        a, n = self.p["a"], np.array([x.shape[1] for x in parts])
        t_max, rows = int(n.max()), np.arange(len(parts))
        # labels first, so that each step works on whole rows of inputs; the best score of a path that ends there
        score = np.zeros((t_max, K, len(parts)), np.float32)
        for r, x in enumerate(parts):
            score[: x.shape[1], :, r] = x.T
        for t in range(1, t_max):
            score[t] += (score[t - 1][:, None, :] + a[:, :, None]).max(0)
        lab = np.zeros((len(parts), t_max), np.uint8)
        cur, into = np.zeros(len(parts), np.intp), np.ascontiguousarray(a.T)
        for t in range(t_max - 1, -1, -1):
            # which label came before is asked for the one label on the path alone
            cur = (score[t].T + np.where((t < n - 1)[:, None], into[cur], 0)).argmax(1)
            lab[:, t] = cur
        return [lab[r, : n[r]] for r in rows]

    # -- training -------------------------------------------------------------------------

    def loss(self, seqs: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, dict]:
        """Mean negative log-likelihood per character, and the gradients."""
        p, h = self.p, self.hidden
        x, n = pad(seqs)
        y, _ = pad(tags)
        keep: tuple[list, list] = ([], [])
        e = self.emissions(x, n, keep).astype(np.float64)
        hf, hb, flip = self._last
        a = p["a"].astype(np.float64)
        rows, t_max = len(seqs), x.shape[1]
        alpha, beta = np.zeros((t_max, rows, K)), np.zeros((t_max, rows, K))
        lse = lambda v, ax: v.max(ax) + np.log(np.exp(v - v.max(ax, keepdims=True)).sum(ax))
        alpha[0] = e[:, 0]
        for t in range(1, t_max):
            new = lse(alpha[t - 1][:, :, None] + a, 1) + e[:, t]
            alpha[t] = np.where((t < n)[:, None], new, alpha[t - 1])
        z = lse(alpha[-1], 1)
        for t in range(t_max - 2, -1, -1):
            new = lse(a[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where((t + 1 < n)[:, None], new, 0)
        live = np.arange(t_max)[None, :] < n[:, None]
        de = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - z[:, None, None])
        gold = np.zeros_like(de)
        np.put_along_axis(gold, y[:, :, None], 1, 2)
        total = (e * gold * live[:, :, None]).sum()
        da = np.zeros_like(a)
        for t in range(1, t_max):
            on = t < n
            if not on.any():
                break
            pair = np.exp(alpha[t - 1][on][:, :, None] + a + (e[on, t] + beta[t][on])[:, None, :] - z[on][:, None, None])
            da += pair.sum(0)
            np.add.at(da, (y[on, t - 1], y[on, t]), -1)
            total += a[y[on, t - 1], y[on, t]].sum()
        count = n.sum()
        nll = (z.sum() - total) / count
        de = ((de - gold) * live[:, :, None] / count).astype(np.float32)
        g = {"a": (da / count).astype(np.float32), "b": de.sum((0, 1)), "wf": np.einsum("bth,btk->hk", hf, de), "wb": np.einsum("bth,btk->hk", hb, de)}
        g["tf"], g["uf"] = self._through(x, de @ p["wf"].T, keep[0], p["uf"])
        xb = np.take_along_axis(x, flip, 1)
        g["tb"], g["ub"] = self._through(xb, np.take_along_axis(de @ p["wb"].T, flip[:, :, None], 1), keep[1], p["ub"])
        return float(nll), g

    def _through(self, x: np.ndarray, dh_out: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hidden
        dt, du = np.zeros((VOCAB, 4 * h), np.float32), np.zeros_like(u)
        dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            z, before, tc, state, cell = keep[t]
            i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            d = dh + dh_out[:, t]
            dc = dc + d * o * (np.abs(cell) < 1)
            # inside the linear parts the slopes are 1/4 and 1, outside they are 0
            inner = lambda v: 0.25 * ((v > 0) & (v < 1))
            dz = np.concatenate([dc * g * inner(i), dc * before * inner(f), d * tc * inner(o), dc * i * (np.abs(g) < 1)], 1).astype(np.float32)
            np.add.at(dt, x[:, t], dz)
            du += state.T @ dz
            dh, dc = dz @ u.T, dc * f
        return dt, du

    def fit(self, seqs: list[np.ndarray], tags: list[np.ndarray], *, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 0, seconds: float = 1e9, log=None) -> None:
        import time

        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort([len(s) for s in seqs], kind="stable")
        blocks = [order[i : i + batch] for i in range(0, len(order), batch)]
        step, began = 0, time.time()
        for ep in range(epochs):
            r.shuffle(blocks)
            losses = []
            left = 1 - max(ep / epochs, (time.time() - began) / seconds)
            if left <= 0:
                break
            for b in blocks:
                step += 1
                nll, g = self.loss([seqs[i] for i in b], [tags[i] for i in b])
                losses.append(nll)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale = min(1.0, 1.0 / (norm + 1e-9))
                lr = rate * max(left, 0.05) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, x in g.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.999 * v2[k] + 0.001 * x * x
                    self.p[k] -= (lr * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
            if log:
                log(f"epoch {ep} loss {np.mean(losses):.5f} after {time.time() - began:.0f} s")


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model.load()
