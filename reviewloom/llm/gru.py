"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word enters as the sum of the vectors of its features: itself, and its beginnings of 4 to 8 bytes (the character inputs, which
carry over to forms of a word not seen in training). Both directions read the window; a softmax over its words weighs the states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, STRIDE = 32, 16  # words of a window, words between the starts of two windows
INPUT, HIDDEN, ATTEND = 8, 8, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def window_starts(words: int) -> np.ndarray:
    """Starts of the overlapping windows that cover `words` words; one window if they fit, none if there are none."""
    if words <= WIDTH:
        return np.zeros(min(words, 1), np.int64)
    starts = np.arange(0, words - WIDTH, STRIDE)
    return np.append(starts, words - WIDTH)


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, features: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"E": 0.05 * rng.normal(size=(features, INPUT)).astype(np.float32)}
        for side in "fb":
            w |= {f"W{side}": draw(INPUT, 3 * HIDDEN), f"U{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "o": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        return cls(w)

    def inputs(self, side: str) -> np.ndarray:
        """What each feature adds to the gates of one direction."""
        return self.weights["E"] @ self.weights[f"W{side}"]

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States after every word. x: (words, windows, 3 HIDDEN), what the words add to the gates."""
        u, h = self.weights[f"U{side}"], np.zeros((x.shape[1], HIDDEN), x.dtype)
        out = np.empty((*x.shape[:2], HIDDEN), x.dtype)
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            g = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * HIDDEN:]))
            h = h + mask[t, :, None] * (1 - z) * (n - h)
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        w = self.weights
        inner = np.tanh(states @ w["A"] + w["a"])
        score = np.where(mask > 0, inner @ w["v"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return inner, weight, pooled, pooled @ w["o"] + w["b"]

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One number per window, from what its words add to the gates (words, windows, 3 HIDDEN) without the constant."""
        states = np.concatenate([self._read(forward + self.weights["cf"], mask, "f"), self._read(backward + self.weights["cb"], mask, "b")], axis=2)
        return self._pool(states, mask)[3]

    def gradients(self, features: np.ndarray, mask: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients. features: (words, windows, slots) rows of E, 0 for none; share: weight of each window."""
        w, slots = self.weights, features.shape[2]
        e = w["E"][features].sum(axis=2)
        kept: dict[str, list] = {"f": [], "b": []}
        sides = {s: self._read(e @ w[f"W{s}"] + w[f"c{s}"], mask, s, kept[s]) for s in "fb"}
        states = np.concatenate([sides["f"], sides["b"]], axis=2)
        inner, weight, pooled, logit = self._pool(states, mask)
        p = sigmoid(logit)
        loss = float((share * (np.logaddexp(0, logit) - labels * logit)).sum())
        d = share * (p - labels)
        grad = {"b": d.sum(keepdims=True), "o": pooled.T @ d}
        d_pooled = d[:, None] * w["o"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_inner = d_score[:, :, None] * w["v"] * (1 - inner ** 2)
        grad |= {"v": np.einsum("tb,tba->a", d_score, inner), "A": np.einsum("tbh,tba->ha", states, d_inner), "a": d_inner.sum(axis=(0, 1))}
        d_states = weight[:, :, None] * d_pooled + d_inner @ w["A"].T
        d_e = np.zeros_like(e)
        for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, d_h = w[f"U{s}"], np.zeros_like(pooled[:, :HIDDEN])
            d_u, d_x = np.zeros_like(u), np.empty((*e.shape[:2], 3 * HIDDEN), e.dtype)
            for t, h, z, r, n, g in reversed(kept[s]):
                d_h = d_h + d_states[t, :, part]
                m = mask[t, :, None]
                d_n = d_h * m * (1 - z) * (1 - n ** 2)
                d_z = -d_h * m * (n - h) * z * (1 - z)
                d_r = d_n * g * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += h.T @ d_g
                d_h = d_h * (1 - m * (1 - z)) + d_g @ u.T
            grad |= {f"U{s}": d_u, f"c{s}": d_x.sum(axis=(0, 1)), f"W{s}": np.einsum("tbi,tbg->ig", e, d_x)}
            d_e += d_x @ w[f"W{s}"].T
        d_rows = np.zeros_like(w["E"])
        flat = d_e.reshape(-1, INPUT)
        for slot in range(slots):
            rows = features[:, :, slot].ravel()
            for i in range(INPUT):
                d_rows[:, i] += np.bincount(rows, flat[:, i], len(d_rows))
        d_rows[0] = 0  # the row of no feature stays 0
        grad["E"] = d_rows
        return loss, grad


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def update(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grad.items():
            g = g.astype(self.weights[k].dtype)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            size = np.sqrt(self.second[k] / (1 - 0.99 ** self.step)) + 1e-8
            self.weights[k] -= (self.rate / (1 - 0.9 ** self.step)) * self.first[k] / size


def train(features: np.ndarray, mask: np.ndarray, document: np.ndarray, labels: np.ndarray, rows: int, *,
          epochs: int = 8, batch: int = 256, rate: float = 0.01, decay: float = 1.0, seed: int = 17) -> Network:
    """A network for windows (words, windows, slots) of labelled documents. `document` names each window's document.

    A label belongs to a document, and a document is as toxic as its worst window. The first two epochs give every window
    its document's label, weighted so that documents count alike; later epochs learn from the worst window of each
    document as the network sees it then, and from one more at random for documents labelled 0.
    """
    net, rng = Network.fresh(rows, seed), np.random.default_rng(seed)
    net.weights["E"][0] = 0
    adam = Adam(net.weights, rate)
    of_doc = labels[document]
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    per_doc = np.bincount(document, minlength=len(labels))
    for epoch in range(epochs):
        if epoch < 2:
            chosen, share = np.arange(len(document)), (1 / per_doc)[document]
        else:
            logit = predict(net, features, mask)
            order = np.lexsort((-logit, document))
            worst = order[np.r_[True, np.diff(document[order]) != 0]]
            extra = rng.permutation(np.flatnonzero(of_doc == 0))[: len(worst)]
            chosen, share = np.concatenate([worst, extra]), np.r_[np.ones(len(worst)), np.full(len(extra), 0.3)]
        share = share * balance[document[chosen]]
        shuffled = rng.permutation(len(chosen))
        size = min(batch, max(16, len(chosen) // 20))
        for at in range(0, len(chosen), size):
            some = shuffled[at: at + size]
            _, grad = net.gradients(features[:, chosen[some]], mask[:, chosen[some]], of_doc[chosen[some]].astype(np.float32),
                                    (share[some] / share[some].sum()).astype(np.float32))
            net.weights["E"] *= 1 - decay * rate  # features that only fit single documents fade
            adam.update(grad)
    worst = np.full(len(labels), -np.inf)
    np.maximum.at(worst, document, predict(net, features, mask))
    net.weights["b"] -= np.float32(cut(worst[per_doc > 0], labels[per_doc > 0]))
    return net


def cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where the two labels part best: the middle of the widest gap among those with the highest balanced accuracy. A network
    that took few steps orders documents before its scores have moved to either side of one half."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order].astype(np.float64), labels[order]
    right = np.cumsum(y == 0) / max(1, (y == 0).sum()) + 1 - np.cumsum(y == 1) / max(1, (y == 1).sum())
    gaps = np.where(np.diff(x) > 0, np.diff(x), -1.0)
    if not len(gaps) or gaps.max() < 0:
        return 0.0
    good = np.where(gaps > 0, right[:-1], -1.0)
    best = np.flatnonzero(good >= good.max() - 1e-9)
    at = best[np.argmax(gaps[best])]
    return float((x[at] + x[at + 1]) / 2)


def predict(net: Network, features: np.ndarray, mask: np.ndarray, batch: int = 512) -> np.ndarray:
    forward, backward = net.inputs("f"), net.inputs("b")
    out = []
    for at in range(0, features.shape[1], batch):
        f = features[:, at: at + batch]
        out.append(net.logits(forward[f].sum(axis=2), backward[f].sum(axis=2), mask[:, at: at + batch]))
    return np.concatenate(out) if out else np.empty(0, np.float32)
