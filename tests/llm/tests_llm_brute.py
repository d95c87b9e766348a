"""Plain versions of the dedup steps, for small tables."""


def brute_keep(rows):
    """Of rows with equal text (A-Z lower-cased) that with the largest id."""
    best = {}
    for r in rows:
        key = (r["text"] or "").encode().lower()
        if key not in best or r["doc_id"] > best[key]["doc_id"]:
            best[key] = r
    return list(best.values())


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                parent[max(a, b)] = min(a, b)
    return [(i, top(i)) for i in ids]
