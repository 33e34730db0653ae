"""A generative label model over categorical votes.

Every voter gives one of a few levels for an item (a candidate pair). The model is a mixture of two
classes; each voter has a distribution over its levels in each class. Items with equal votes are one
pattern, so fitting works on a table of patterns whose size is bounded by the product of the level
counts, however many items there are. Expectation maximisation learns class share and voter
distributions without labels. Voters that still depend on each other within a class are found by
their conditional mutual information; the strongest dependent pair is then modelled jointly, and so
on up to ``joint`` pairs.
"""

from __future__ import annotations

import numpy as np

#: Nats of conditional mutual information above which two voters are as good as one.
SMOOTH, TURNS, COPY = 1.0, 200, 0.25
#: Two classes can be told apart without labels only by so many views of an item, so voters aren't joined below that.
LEAST_VIEWS = 3


class LabelModel:
    def __init__(self, levels: list[int], lean: list[list[float]], share: float = 0.2, joint: int = 2, least_information: float = 0.01, anchor=None):
        """``levels``: level count of each voter; ``lean``: for each level, its initial odds for a match;
        ``anchor``: gives 1, 0 or None for a pattern of votes that is sure to be a match, a non-match, or neither."""
        self.anchor = anchor
        self.levels, self.lean, self.share, self.joint, self.least = levels, lean, share, joint, least_information
        self.groups: list[tuple[int, ...]] = [(i,) for i in range(len(levels))]

    def _views(self, votes: np.ndarray) -> int:
        """Groups of voters that say more than one thing."""
        return sum(len(np.unique(code)) > 1 for code, _ in self._codes(votes))

    def _join(self, a: int, b: int) -> None:
        self.groups = [g for g in self.groups if g not in ((a,), (b,))] + [(a, b)]

    def _codes(self, votes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        out = []
        for g in self.groups:
            code, size = np.zeros(len(votes), np.int64), 1
            for v in g:
                code = code * self.levels[v] + votes[:, v]
                size *= self.levels[v]
            out.append((code, size))
        return out

    def _fit(self, votes: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        codes, p = self._codes(votes), start
        # Pseudo-counts follow the voters' margins, so a joint table isn't pulled to uniform.
        for _ in range(TURNS):
            tables = []
            for code, size in codes:
                margin = np.bincount(code, n, size) + 1e-9
                margin = margin / margin.sum()
                t = np.stack([np.bincount(code, n * w, size) for w in (1 - p, p)]) + SMOOTH * margin * size * 0.1 + 1e-6
                tables.append(t / t.sum(1, keepdims=True))
            share = float((n * p).sum() / n.sum())
            share = min(0.99, max(1e-4, share))
            z = np.full(len(votes), np.log(share / (1 - share)))
            for (code, _), t in zip(codes, tables):
                z += np.log(t[1][code]) - np.log(t[0][code])
            new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            new = np.where(self.fixed >= 0, self.fixed, new)
            done = np.abs(new - p).max() < 1e-6
            p = new
            if done:
                break
        self.tables, self.share = tables, share
        return p

    def _dependence(self, votes: np.ndarray, n: np.ndarray, p: np.ndarray, a: int, b: int) -> float:
        """Mutual information of two voters given the class, in nats."""
        total = 0.0
        for w in (n * p, n * (1 - p)):
            mass = w.sum()
            if mass < 1:
                continue
            t = np.zeros((self.levels[a], self.levels[b]))
            np.add.at(t, (votes[:, a], votes[:, b]), w)
            t /= mass
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
            m = t > 0
            total += mass / n.sum() * float((t[m] * np.log(t[m] / e[m])).sum())
        return total

    def fit(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Posterior of each pattern. ``votes``: patterns by voters; ``n``: items of each pattern."""
        if not len(votes):
            self.tables = []
            return np.zeros(0)
        sure = [self.anchor(v) if self.anchor else None for v in votes]
        self.fixed = np.array([-1.0 if x is None else float(x) for x in sure])
        z = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for v, odds in enumerate(self.lean):
            z += np.log(np.asarray(odds, float))[votes[:, v]]
        p = 1 / (1 + np.exp(-z))
        # Near copies would pull the classes to themselves, so they are joined before anything is learned.
        for _ in range(self.joint):
            single = [g[0] for g in self.groups if len(g) == 1]
            found = sorted(((self._dependence(votes, n, p, a, b), a, b) for i, a in enumerate(single) for b in single[i + 1 :]), reverse=True)
            if not found or found[0][0] < COPY or self._views(votes) <= LEAST_VIEWS:
                break
            self._join(*found[0][1:])
        p = self._fit(votes, n, p)
        for _ in range(self.joint):
            single = [g[0] for g in self.groups if len(g) == 1]
            found = sorted(((self._dependence(votes, n, p, a, b), a, b) for i, a in enumerate(single) for b in single[i + 1 :]), reverse=True)
            if not found or found[0][0] < self.least or self._views(votes) <= LEAST_VIEWS:
                break
            self._join(*found[0][1:])
            p = self._fit(votes, n, p)
        return p

    def accuracies(self) -> list[dict]:
        """For each group of voters its level distributions in both classes."""
        return [{"voters": g, "non_match": t[0].tolist(), "match": t[1].tolist()} for g, t in zip(self.groups, self.tables)]
