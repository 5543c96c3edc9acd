"""Plain loops that say what operators should give, sharing no code with them."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def longest_common(a, b):
    """Length of the longest common subsequence, by the table of all pairs of what differs between equal ends."""
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[head:], b[head:]
    tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))  # noqa: B905
    return head + tail + _table(a[: len(a) - tail], b[: len(b) - tail])


def _table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = left[j] + 1 if x == y else max(left[j + 1], row[j])
    return row[-1]


def leaks(docs, items, theta=0.6, overlap=0.8):
    """(doc, item) pairs: each item against each window of each document."""
    bags = {i: tokens(t) for i, t in items}
    n, mean = len(items), max(1.0, sum(map(len, bags.values())) / max(1, len(items)))
    holders = Counter(w for b in bags.values() for w in set(b))
    found = set()
    for i, text in items:
        item = bags[i]
        if not item:
            continue
        weight = {}
        for w, c in Counter(item).items():
            idf = math.log(1 + (n - holders[w] + 0.5) / (holders[w] + 0.5))
            weight[w] = idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item) / mean))
        whole = sum(weight.values())
        asked = len(tokens(text[: text.rindex("?")])) if "?" in text else 0
        cut = asked if 0 < asked < len(item) else max(1, len(item) * 3 // 4)
        stride = 64
        while stride < len(item):
            stride *= 4
        for d, body in docs:
            words = tokens(body)
            for at in range(0, max(1, len(words) - stride) if words else 0, stride):
                window = words[at : at + 2 * stride]
                if sum(weight.get(w, 0.0) for w in set(window)) < theta * whole - 1e-9:
                    continue
                if len(item) < 8:
                    hit = any(window[k : k + len(item)] == item for k in range(len(window)))
                else:
                    q, a = item[:cut], item[cut:]
                    hit = longest_common(q, window) >= overlap * len(q) and (not a or longest_common(a, window) >= overlap * len(a))
                if hit:
                    found.add((d, i))
                    break
    return found


@functools.cache
def runs(text, width=5):
    """A text's runs of words, each with the number of its occurrence, in order and as a set."""
    w = tokens(text)
    if not w:
        return [], frozenset()
    seen, out = Counter(), []
    for k in range(max(1, len(w) - width + 1)):
        run = tuple(w[k : k + width])
        out.append((run, seen[run]))
        seen[run] += 1
    return out, frozenset(out)


def alike(a, b, least=0.8):
    """Whether two texts' runs in common order are at least that share of all runs of both."""
    if a == b:
        return True
    (x, own), (y, other) = runs(a), runs(b)
    most = max(len(x), len(y))
    if min(len(x), len(y)) < least * most or len(own & other) < least * most:
        return False
    n = longest_common(x, y)
    return n >= least * (len(x) + len(y) - n) - 1e-9


def classes(docs):
    """The smallest position of each document's class, by all pairs."""
    own = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if own[i] != own[j] and alike(docs[i], docs[j]):
                low, high = sorted((own[i], own[j]))
                own = [low if x == high else x for x in own]
    return own


def statistics(text):
    """The quality classifier's statistics, from their names, with Python's simplest means."""
    w = (text or "").split()
    if not w:
        return [0.0] * 14
    n, lines = len(w), text.split("\n")
    share = lambda some: len(list(some)) / n
    per_line = n / len(lines)
    return [
        math.log(1 + n),
        len("".join(w)) / n,
        share(x for x in w if len(x) > 14),
        share(set(w)),
        share(k for k in range(1, n) if w[k] == w[k - 1]),
        share(x for x in w if x.isupper()),
        share(c for c in text if c == "."),
        share(c for c in text if c == ","),
        share(c for c in text if c == "|"),
        share(c for c in text if c in "#$%&*@~^=<>{}[]_\\"),
        share(c for c in text if c in "!?"),
        sum(c in "0123456789" for c in text) / len(text),
        len(set(lines)) / len(lines),
        per_line / (1 + per_line),
    ]


def quality(model, text):
    """A rule model's score of a text, rule by rule."""
    s, total = statistics(text), model.intercept
    for rule, weight in zip(model.rules, model.weights, strict=True):
        if all(s[f] > t if above else s[f] <= t for f, above, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))
