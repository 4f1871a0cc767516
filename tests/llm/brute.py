"""Plain Python versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash

SF = "/root/testdata/sf0.001"
_LOWER = {k: k + 32 for k in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def components(nodes, links) -> dict:
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, size: int) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return []
    return [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def simhash(text: str | None, size: int = 3) -> int:
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def share(children: dict, budget: int) -> dict:
    """children: name -> (capacity, weight). Fill in order of capacity over weight, the rest by weight."""
    left, weight, out = budget, sum(w for _, w in children.values()), {}
    order = sorted(children, key=lambda n: (children[n][0] / children[n][1], n))
    for k, n in enumerate(order):
        cap, w = children[n]
        if cap / w * weight > left:
            return out | {m: math.floor(children[m][1] * left / weight) for m in order[k:]}
        out[n] = cap
        left, weight = left - cap, weight - w
    return out


def mixture(rows, weights, total_share, max_epochs, seed):
    """rows: (id, lang, source, text). Taken (id, epoch) pairs, sorted."""
    leaves: dict = {}
    for i, lang, source, text in rows:
        digits = re.search(r"([0-9]{1,9})$", source or "-")
        n = len([w for w in re.split(r"[ \t\n\r]+", text or "") if w])
        name = i if i is not None else "-" + hashlib.md5((text or "").encode()).hexdigest()
        leaves.setdefault((f"d{int(digits[1]) % 4 if digits else 0}", lang or "-", source or "-"), []).append((i, n, name))
    tokens = {leaf: sum(n for _, n, _ in docs) for leaf, docs in leaves.items()}
    cap = lambda *p: sum(t * max_epochs for leaf, t in tokens.items() if leaf[: len(p)] == p)
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    at = lambda *p: sorted({leaf[len(p)] for leaf in tokens if leaf[: len(p)] == p})
    budget, out = min(math.floor(sum(tokens.values()) * total_share), cap()), []
    for d, b in share({d: (cap(d), weight("domain", d)) for d in at()}, budget).items():
        for g, c in share({g: (cap(d, g), weight("lang", g)) for g in at(d)}, b).items():
            for s, x in share({s: (cap(d, g, s), weight("source", s)) for s in at(d, g)}, c).items():
                n = tokens[d, g, s]
                whole = min(max_epochs, x // n) if n else max_epochs
                out += [(i, e) for e in range(whole) for i, _, _ in leaves[d, g, s]]
                if whole < max_epochs:
                    run = 0
                    for _, size, i in sorted(((hashlib.md5(f"{seed}:{whole}:{name}".encode()).hexdigest(), k, i) for i, k, name in leaves[d, g, s]), key=lambda x: x[:2]):
                        run += size
                        if run <= x - whole * n:
                            out.append((i, whole))
    return sorted(out, key=str)


def digest(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
