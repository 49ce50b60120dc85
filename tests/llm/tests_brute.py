"""Groups of near copies by comparing all pairs of a small table."""


def kept_of_groups(rows, width=5, least=0.8):
    def shingles(text):
        w = [x.lower() for x in (text or "").split()]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and common >= least * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i for i in ids if top(i) == i}
