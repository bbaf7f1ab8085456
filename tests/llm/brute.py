"""Brute-force versions to test against."""
import re

WS = r"[^\x20\x09-\x0D]+"
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(WS, (text or "").translate(TO_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(docs):
    """{doc_id: (set size, smallest id reachable)} of (doc_id, text) rows; pairs that share no shingle are not tried."""
    sets = {d: shingle_set(t) for d, t in docs}
    at = {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    done = set()
    for ds in at.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
