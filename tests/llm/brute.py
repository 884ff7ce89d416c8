"""Plain versions to compare with."""

import hashlib
from collections import Counter


def repeats(texts: list[str], length: int) -> list[tuple[int, int, int, str]]:
    """Bytes, removed bytes, removed runs and hash of what is left, per text."""
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def katz(docs: dict[int, str], held: dict[int, bool]):
    """Per document: tokens, known tokens, base score, score. And the probability of a token after another."""
    import math

    from marginalia.llm.katz import DISCOUNTED, discounts

    split = {i: [*(w.decode() for w in t.encode().lower().split()), "\n"] for i, t in docs.items()}
    train = [t for i, t in split.items() if not held[i]]
    words = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(words.values()), len(words)

    def factor(counts):
        of = Counter(counts.values())
        d = discounts([of[r] for r in range(1, DISCOUNTED + 2)])
        return lambda r: d[r] if r <= DISCOUNTED else 1.0

    d1, d2 = factor(words), factor(pairs)
    n1 = n if any(c <= DISCOUNTED for c in words.values()) else max(n + 1, 1)
    unknown = 1 - sum(d1(c) * c for c in words.values()) / n1
    uni = lambda w: d1(words[w]) * words[w] / n1 if w in words else unknown
    after = {}
    for (a, b), c in pairs.items():
        after.setdefault(a, {})[b] = c

    weights = {}

    def weight(a):
        if a not in weights:
            seen = after[a]
            total = sum(seen.values()) + all(c > DISCOUNTED for c in seen.values())
            left = 1 - sum(d2(c) * c for c in seen.values()) / total
            weights[a] = total, left / (1 - sum(uni(w) for w in seen))
        return weights[a]

    def probability(a, b):
        if a not in after:
            return uni(b)
        total, rest = weight(a)
        return d2(after[a][b]) * after[a][b] / total if b in after[a] else rest * uni(b)

    out = {
        i: (
            len(t),
            sum(w in words for w in t),
            sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t),
            sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *t], t, strict=False)),
        )
        for i, t in split.items()
    }
    return out, probability, words, after
