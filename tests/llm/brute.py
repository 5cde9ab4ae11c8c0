"""The contracts' results by plain loops over small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring(rows: list[tuple], window: int) -> dict:
    """By id (ids unique): words, removed words, digest of what stays."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            run = tuple(own[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[key] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, size: int) -> set:
    own = words(lower(text))
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()


def near(rows: list[tuple], size: int, percent: int) -> dict:
    """By id (ids unique): shingles and smallest id that links reach."""
    sets, root = {k: shingles(t, size) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    common = Counter((a, b) for held in where.values() for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def quality(text) -> tuple:
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    times = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if times[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
