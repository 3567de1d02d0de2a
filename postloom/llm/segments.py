"""Semi-Markov segmentation: whole segments are scored, and the best segmentation is found by dynamic programming."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

#: A segment: label, first place, place after its end.
Segment = tuple[str, int, int]
Features = Callable[[str, str, int, int], list[str]]


class SemiMarkov:
    """A linear model over segmentations of a sequence of symbols.

    ``features(symbols, label, i, j)`` names what holds of a segment as a whole; a segment also has a feature for each symbol in it and one
    for the label before it. Features that begin with "!" are rules, whose weights stay. ``after`` lists the label pairs that may follow each other, '^' stands for the beginning and '$' for the end.
    """

    def __init__(self, labels: Sequence[str], after: set[tuple[str, str]], features: Features, weights: dict[str, float], longest: dict[str, int]):
        self.labels, self.after, self.features, self.longest = list(labels), after, features, longest
        self.weights = defaultdict(float, weights)

    def _named(self, symbols: str, before: str, label: str, i: int, j: int) -> list[str]:
        return [f"{label}:{s}" for s in symbols[i:j]] + [f"{before}>{label}"] + ([f"{label}>$"] if j == len(symbols) else []) + self.features(symbols, label, i, j)

    def decode(self, symbols: str) -> list[Segment]:
        n, w = len(symbols), self.weights
        if not n:
            return []
        best: list[dict[str, tuple]] = [{"^": (0.0, None, None)}, *({} for _ in range(n))]
        sums = {y: [0.0] for y in self.labels}
        for y, s in sums.items():
            for c in symbols:
                s.append(s[-1] + w.get(f"{y}:{c}", 0.0))
        for i in range(n):
            for y in self.labels:
                come = [(score + w.get(f"{b}>{y}", 0.0), b) for b, (score, _, _) in best[i].items() if (b, y) in self.after]
                if not come:
                    continue
                score, before = max(come)
                for j in range(i + 1, min(n, i + self.longest.get(y, n)) + 1):
                    total = score + sums[y][j] - sums[y][i] + sum(w.get(f, 0.0) for f in self.features(symbols, y, i, j)) + (w.get(f"{y}>$", 0.0) if j == n else 0.0)
                    if y not in best[j] or total > best[j][y][0]:
                        best[j][y] = (total, i, before)
        y = max((y for y in best[n] if (y, "$") in self.after), key=lambda y: best[n][y][0])
        segments, j = [], n
        while y != "^":
            _, i, before = best[j][y]
            segments.append((y, i, j))
            j, y = i, before
        return segments[::-1]

    def train(self, examples: Sequence[tuple[str, list[Segment]]], rounds: int = 5, decode: Callable[[str, dict[str, float]], list[Segment]] | None = None) -> None:
        """Averaged structured perceptron from the weights at hand. ``decode`` may stand in for the own, slower search."""
        total: dict[str, float] = defaultdict(float)
        step = 1
        for _ in range(rounds):
            wrong = 0
            for symbols, truth in examples:
                found = self.decode(symbols) if decode is None else decode(symbols, self.weights)
                step += 1
                if found == truth:
                    continue
                wrong += 1
                for segments, sign in ((truth, 1.0), (found, -1.0)):
                    before = "^"
                    for y, i, j in segments:
                        for f in self._named(symbols, before, y, i, j):
                            if f[0] == "!":
                                continue
                            self.weights[f] += sign
                            total[f] += sign * step
                        before = y
            if not wrong:
                break
        for f, t in total.items():
            self.weights[f] -= t / step
