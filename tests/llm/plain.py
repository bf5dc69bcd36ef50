"""Plain versions of operators, for comparison."""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash

from corpusloom.llm import url_filter


class PlainUrls:
    """The URL filter one URL at a time: same features, same gradient steps."""

    def __init__(self, epochs: int = url_filter.EPOCHS, rate: float = 12.0, penalty: float = 1e-3):
        examples = [(self.features(*self.split(u)), y) for u, y in url_filter.LABELLED_URLS]
        self.bias, self.weights = 0.0, np.zeros(url_filter.BUCKETS)
        for _ in range(epochs):
            step, up = np.zeros_like(self.weights), 0.0
            for x, y in examples:
                error = y - self._p(x)
                step[x] += error / math.sqrt(len(x))
                up += error
            self.weights = self.weights * (1 - penalty) + rate * step / len(examples)
            self.bias += rate / 8 * up / len(examples)

    @staticmethod
    def split(url: str | None) -> tuple[str, str]:
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path

    @staticmethod
    def features(host: str, path: str) -> np.ndarray:
        grams = {
            mark + text[i : i + n]
            for text, mark in ((host, "h"), (path, "p"))
            for n in url_filter.GRAM_SIZES
            for i in range(len(text) - n + 1)
        }
        signed = [int(np.uint64(xxhash.xxh64_intdigest(g.encode(), 42)).astype(np.int64)) for g in grams]
        return np.array(sorted({h % url_filter.BUCKETS for h in signed}), int)

    def _p(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-(self.bias + self.weights[x].sum() / math.sqrt(max(len(x), 1)))))

    def score(self, url: str | None) -> float:
        return self._p(self.features(*self.split(url)))

    @staticmethod
    def rule(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        for rule, verdict in url_filter.RULES:
            name, slash, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
                if best[0] is None or len(rule) > len(best[0]):
                    best = (rule, verdict)
        return best


def spark_hash(*texts: str) -> int:
    """xxhash64 of several strings, each seeded by the one before, as a signed number."""
    seed = 42
    for text in texts:
        seed = xxhash.xxh64_intdigest(text.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def buckets_of(text: str | None, sizes: tuple[int, ...], bits: int) -> list[int]:
    """The bucket of every character n-gram of a text, one after the other."""
    codes = [ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in f" {(text or '').lower()} "]
    out = []
    for size in sizes:
        for i in range(len(codes) - size + 1):
            h = codes[i] + size * 7919
            for c in codes[i + 1 : i + size]:
                h = (h * 0x9E3779B1 + c) % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32
            h ^= h >> 13
            out.append(h >> (32 - bits))
    return out


class PlainLanguage:
    """Language identification one feature and one class at a time."""

    def __init__(self, rows: list[tuple[str, str]], settings, bits: int):
        self.s, self.bits = settings, bits
        kept = {(spark_hash("language", t), lang): t for t, lang in rows}
        order = sorted(kept)
        self.langs = sorted({lang for _, lang in order})
        counts = [self.counts(kept[k]) for k in order]
        labels = [self.langs.index(lang) for _, lang in order]
        seen: dict[int, int] = {}
        for c in counts:
            for b in c:
                seen[b] = seen.get(b, 0) + 1
        self.default = math.log(1 + len(counts)) + 1
        self.idf = {b: math.log((1 + len(counts)) / (1 + n)) + 1 for b, n in seen.items()}
        vectors = [self.scaled(c) for c in counts]
        held = [len(order) >= settings.least_calibrated and i % 5 == 4 for i in range(len(order))]
        self.z: dict = {}
        self.n: dict = {}
        for _ in range(settings.epochs):
            for x, y, h in zip(vectors, labels, held, strict=True):
                if not h:
                    self.learn({**x, "bias": 1.0}, y)
        logits = [(self.logits(x), y) for x, y, h in zip(vectors, labels, held, strict=True) if h]
        self.temperature = self.calibrated(logits) if logits else 1.0

    def counts(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        for b in buckets_of(text, self.s.sizes, self.bits):
            found[b] = found.get(b, 0) + 1
        return found

    def scaled(self, counts: dict[int, int]) -> dict[int, float]:
        x = {b: (1 + math.log(n)) * self.idf.get(b, self.default) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()} if norm else x

    def weight(self, key, c: int) -> float:
        z = self.z.get((key, c), 0.0)
        if abs(z) <= self.s.l1:
            return 0.0
        root = math.sqrt(self.n.get((key, c), 0.0))
        return -math.copysign(abs(z) - self.s.l1, z) / ((self.s.beta + root) / self.s.alpha + self.s.l2)

    def logits(self, x: dict) -> list[float]:
        x = {**x, "bias": 1.0}
        return [math.fsum(self.weight(b, c) * v for b, v in x.items()) for c in range(len(self.langs))]

    @staticmethod
    def shares(z: list[float]) -> list[float]:
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    def learn(self, x: dict, y: int) -> None:
        old = {(b, c): self.weight(b, c) for b in x for c in range(len(self.langs))}
        p = self.shares([math.fsum(old[b, c] * v for b, v in x.items()) for c in range(len(self.langs))])
        for b, v in x.items():
            for c in range(len(self.langs)):
                g = v * (p[c] - (c == y))
                n = self.n.get((b, c), 0.0)
                moved = (math.sqrt(n + g * g) - math.sqrt(n)) / self.s.alpha
                self.z[b, c] = self.z.get((b, c), 0.0) + g - moved * old[b, c]
                self.n[b, c] = n + g * g

    def calibrated(self, logits: list) -> float:
        """The best of a fine grid of temperatures."""
        def loss(t: float) -> float:
            return -sum(math.log(max(self.shares([v / t for v in z])[y], 1e-12)) for z, y in logits)

        return min((math.exp(i / 200) for i in range(-800, 801)), key=loss)

    def predict(self, text: str | None, temperature: float) -> tuple[str, float]:
        p = self.shares([v / temperature for v in self.logits(self.scaled(self.counts(text)))])
        k = max(range(len(p)), key=lambda c: (p[c], -c))
        return self.langs[k], p[k]


class PlainToxicity:
    """The toxicity classifier one text and one feature at a time, on all labelled texts."""

    def __init__(self, rows: list[tuple[str | None, int]], settings, bits: int):
        self.s, self.bits = settings, bits
        grams = [set(buckets_of(t, settings.sizes, bits)) for t, _ in rows]
        n = [sum(y == 0 for _, y in rows), sum(y == 1 for _, y in rows)]
        count: dict[int, list[int]] = {}
        for found, (_, y) in zip(grams, rows, strict=True):
            for b in found:
                count.setdefault(b, [0, 0])[y] += 1
        scored = []
        for b, (neg, pos) in count.items():
            if max(neg, pos) >= settings.least_texts:
                ratio = math.log(((pos + 1) / (n[1] + 2)) / ((neg + 1) / (n[0] + 2)))
                scored.append((-abs(ratio) / math.sqrt(1 / (pos + 1) + 1 / (neg + 1)), b, ratio))
        self.ratio = {b: r for _, b, r in sorted(scored)[: settings.features]}
        texts = [[b for b in found if b in self.ratio] for found in grams]
        share = 1 / len(rows)
        w = {b: 0.1 for b in self.ratio}
        w["bias"] = math.log(max(n[1] * share, 1e-9) / max(n[0] * share, 1e-9))
        m, v = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
        for step in range(1, settings.steps + 1):
            g = {b: (settings.penalty * x if b != "bias" else 0.0) for b, x in w.items()}
            for found, (_, y) in zip(texts, rows, strict=True):
                z = w["bias"] + sum(w[b] * self.ratio[b] for b in found)
                error = share * (1 / (1 + math.exp(-min(max(z, -30), 30))) - y)
                g["bias"] += error
                for b in found:
                    g[b] += self.ratio[b] * error
            for b in w:
                m[b] = 0.9 * m[b] + 0.1 * g[b]
                v[b] = 0.99 * v[b] + 0.01 * g[b] * g[b]
                w[b] -= 0.05 * (m[b] / (1 - 0.9**step)) / (math.sqrt(v[b] / (1 - 0.99**step)) + 1e-8)
        self.w = w

    def score(self, text: str | None) -> float:
        found = set(buckets_of(text, self.s.sizes, self.bits)) & self.ratio.keys()
        return 1 / (1 + math.exp(-(self.w["bias"] + sum(self.w[b] * self.ratio[b] for b in found))))
