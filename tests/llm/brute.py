"""Plain versions of what the operators find, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def quality(text):
    """Words, their characters, symbols, repeated lines, repeated words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, links):
    """The smallest id reachable from each place, by place; None only where all ids are None."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[find(i)].append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [least[find(i)] for i in range(len(ids))], [find(i) for i in range(len(ids))]


def near(values, bits=3):
    return [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]


def shingles(text, n=5):
    words = TOKEN.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def contained(docs, items, share=0.8):
    """``{(doc id, item id): (shared, size)}`` with the largest share of rows with one id."""
    found = {}
    for item, item_text in items:
        wanted = shingles(item_text)
        for doc, text in docs:
            shared = len(wanted & shingles(text))
            if wanted and shared >= math.ceil(share * len(wanted)):
                found[doc, item] = max(found.get((doc, item), (0, 0)), (shared, len(wanted)))
    return found


def dedup_lines(docs, least=50, line_words=8, many=20):
    """Cleaned texts of ``[(id, text)]`` in the given order, which is that of the ids."""
    placed, seen, gone = [], set(), defaultdict(set)
    for d, (_, text) in enumerate(docs):
        lines = (text or "").split("\n")
        placed.append([(i, x) for i, x in enumerate(lines) if x.encode().split()])
    for d, lines in enumerate(placed):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b][1].encode().split())
                if words >= least:
                    run = tuple(x for _, x in lines[a : b + 1])
                    if run in seen:
                        gone[d].update(i for i, _ in lines[a : b + 1])
                    seen.add(run)
                    break
    places = defaultdict(list)
    for d, lines in enumerate(placed):
        for i, line in lines:
            if len(line.encode().split()) >= line_words:
                places[line].append((d, i))
    for found in places.values():
        if len(found) >= many:
            for d, i in found[1:]:
                gone[d].add(i)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(docs)]


def mix_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by source, limited ones taken out round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, budget = {}, list(names), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / total > most * sizes[s]]
        if not over:
            goal |= {s: budget * weight[s] / total for s in left}
            break
        for s in over:
            goal[s] = most * sizes[s]
        budget -= sum(goal[s] for s in over)
        left = [s for s in left if s not in goal]
    return goal
