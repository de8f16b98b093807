"""Plain formulas on lists, written for the tests alone."""

import math
import re
from collections import Counter


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def grams(tokens, n):
    return [" ".join(tokens[i : i + k]) for i in range(len(tokens)) for k in range(1, n + 1) if i + k <= len(tokens)]


class Stats:
    def __init__(self, texts, n):
        self.docs = [grams(words(t), n) for t in texts]
        self.counts = [Counter(d) for d in self.docs]
        self.n = len(texts)
        self.df = Counter(t for c in self.counts for t in c)
        self.cf = Counter(t for d in self.docs for t in d)
        self.total = sum(self.cf.values())

    def tf(self, i, t):
        return self.counts[i][t] / len(self.docs[i])

    def idf(self, t):
        return math.log(self.n / (1 + self.df[t]))

    def smooth(self, t):
        return math.log(1 + self.n / (1 + self.df[t]))

    def ridf(self, t):
        return math.log(self.df[t] / (1 + self.n * (1 - math.exp(-self.cf[t]))))

    def each(self, score):
        return {(f"doc_{i}", t): score(i, t) for i, c in enumerate(self.counts) for t in c}

    def containing(self, i, t):
        return [o for o in self.counts[i] if o != t and t in o]

    def contained(self, i, t):
        return [o for o in self.counts[i] if o != t and o in t]
