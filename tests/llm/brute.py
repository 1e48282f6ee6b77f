"""Plain versions of the operators for small fixtures."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict


def components(ids, links) -> dict:
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abdeghilnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


def shingles(text: str | None, size: int) -> set:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    if len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_links(sets: list[set], percent: int) -> list[tuple[int, int]]:
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                out.append((i, j))
    return out


def copied(texts: list[bytes], length: int, keep_first: bool) -> list[list[bool]]:
    seen: Counter = Counter()
    for b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    first: set = set()
    marks = []
    for b in texts:
        mark = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in first if keep_first else seen[s] > 1:
                mark[i : i + length] = [True] * length
            first.add(s)
        marks.append(mark)
    return marks


def spans(mark: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, m in enumerate([*mark, False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            out.append((start, i))
            start = None
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(found)


def phrases(text: str | None, table: dict[str, str]) -> tuple[int, list[tuple[int, str]]]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in table.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Sharing out the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    excess, open_ = share * sum(sizes.values()), set(names)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def groups(pairs) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
