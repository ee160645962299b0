"""Plain versions of the set joins."""

import re


def lower(x):
    return x.translate({c: c + 32 for c in range(65, 91)})


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    having = {}
    for at, (_, s) in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(at)
    pairs = {(x, y) for found in having.values() for x in found for y in found if x < y}
    links = [(sets[x][0], sets[y][0]) for x, y in pairs if 100 * len(sets[x][1] & sets[y][1]) >= 80 * len(sets[x][1] | sets[y][1])]
    low = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(low[i], low[j])
            changed |= low[i] != least or low[j] != least
            low[i] = low[j] = least
    return sorted((i, len(s), low[i]) for i, s in sets)


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        x = word.findall(lower(item or ""))
        for window in [x[i : i + 13] for i in range(len(x) - 12)] if len(x) >= 13 else [x] * bool(x):
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)
