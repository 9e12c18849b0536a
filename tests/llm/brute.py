"""Plain single-process versions of what the queries return, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def op1(docs):
    out = {}
    for i, text in docs:
        w = words(text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        out[i] = (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w),
        )
    return out


def op2(docs, bench, span=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    at = defaultdict(set)
    for item, text in bench:
        w = cut(text)
        for k in range(max(1, len(w) - span + 1)) if w else ():
            at[tuple(w[k : k + span])].add(item)
    sizes = {len(x) for x in at}
    out = {}
    for i, text in docs:
        w = cut(text)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := at.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        names = sorted(str(x) for x in items if x is not None)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def op7(docs, radius=2):
    prints = {}
    for i, text in docs:
        w = words(lowered(text))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    of = {}
    todo = defaultdict(list)
    for i, f in prints.items():
        todo[f].append(i)
    keys = list(todo)
    seen = set()
    for f in keys:
        if f in seen:
            continue
        group, stack = [], [f]
        seen.add(f)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in keys:
                if y not in seen and (x ^ y).bit_count() <= radius:
                    seen.add(y)
                    stack.append(y)
        least = min(i for x in group for i in todo[x])
        for x in group:
            for i in todo[x]:
                of[i] = least
    return {i: (f"{prints[i]:016x}", of[i]) for i in prints}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def op8_base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text, re.ASCII) if ok(m.group())]


def op6_base(docs):
    tokens = {i: [*words(lowered(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        for i, t in tokens.items()
    }


def op6_next(train, depth):
    """Probability of a byte after a context, by context-tree weighting over dicts, from its definition."""
    from collections import defaultdict
    from functools import cache
    from math import exp, lgamma, log

    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(byte):
        place = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield place, bit
            place = 2 * place + bit

    for text in train:
        padded = b"\n" * depth + text
        for at in range(depth, len(padded)):
            for place, bit in decisions(padded[at]):
                for d in range(depth + 1):
                    node = padded[at - d : at], place
                    counts[node][bit] += 1
                    if d < depth:
                        kids[node].add((padded[at - d - 1 : at], place))

    @cache
    def own(node):
        a, b = counts[node]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)

    def lower(node):
        return sum(map(inside, kids[node]))

    @cache
    def inside(node):
        if len(node[0]) == depth:
            return own(node)
        x, y = own(node), lower(node)
        top = max(x, y)
        return log(0.5) + top + log(exp(x - top) + exp(y - top))

    def one(context, place):
        mix, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            node = context[len(context) - d :], place
            if node not in counts:
                break
            a, b = counts[node]
            last = (b + 0.5) / (a + b + 1)
            share = 1.0 if d == depth else 1 / (1 + exp(min(700.0, lower(node) - own(node))))
            mix, left = mix + left * share * last, left * (1 - share)
        return mix + left * last

    def probability(context, byte):
        p = 1.0
        for place, bit in decisions(byte):
            x = one(context, place)
            p *= x if bit else 1 - x
        return p

    return probability


def op6_score(train, texts, depth):
    from math import log10

    p = op6_next(train, depth)
    out = {}
    for k, text in texts.items():
        padded = b"\n" * depth + text
        out[k] = sum(log10(p(padded[at - depth : at], padded[at])) for at in range(depth, len(padded)))
    return out


def best_fit_decreasing(lengths, capacity):
    """How many sequences plain best-fit needs, longest first."""
    from bisect import bisect_left, insort

    rooms: list[int] = []
    n = 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        if at == len(rooms):
            n, room = n + 1, capacity
        else:
            room = rooms.pop(at)
        insort(rooms, room - x)
    return n


def near(docs, bench, distance=8, n_terms=2, min_words=3):
    """doc_id -> number of items whose rarest terms all stand within ``distance`` positions."""
    from collections import Counter
    from itertools import product

    words = {i: _words(t) for i, t in docs}
    count = Counter(w for own in words.values() for w in own)
    out = {}
    for i, own in words.items():
        found = set()
        for item, text in bench:
            w = _words(text)
            if len(w) < min_words:
                continue
            rare = sorted(set(w), key=lambda x: (count[x], x))[:n_terms]
            places = [[k for k, x in enumerate(own) if x == r] for r in rare]
            if any(max(p) - min(p) <= distance for p in product(*places)):
                found.add(item)
        out[i] = len(found)
    return out


def _words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
