"""Plain versions of the operators, over Python dicts and lists."""

from __future__ import annotations

import hashlib
import html
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text) -> list[str]:
    return WORD.findall(text or "")


def groups(nodes, links) -> dict:
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def substring_dedup(docs: list[tuple], window: int) -> dict:
    """(n_words, n_removed, sha256) of each document."""
    first: dict = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, size: int = 5) -> set:
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}


def near_duplicates(docs: list[tuple], percent: int = 85) -> dict:
    """(n_shingles, component_id) of each document."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    found = groups(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def targets(sizes: list[tuple], weights=(5, 2, 1), most: int = 3) -> dict:
    """Target of each source, by sharing what is above the cap again and again."""
    own: dict = {}
    for source, size in sizes:
        own[source] = own.get(source, 0) + size
    order = sorted((s for s in own if s is not None)) + ([None] if None in own else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = float(sum(own.values())), set()
    while True:
        left = total - sum(most * own[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        out = {s: float(most * own[s]) if s in capped else left * weight[s] / share for s in order}
        above = {s for s in order if s not in capped and out[s] > most * own[s]}
        if not above:
            return out
        capped |= above


def article_text(page: str) -> str:
    """The text of the page's article element, by plain patterns."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def cut_cost(odds, edges, content) -> float:
    return sum(max(o, 0) if not c else max(-o, 0) for o, c in zip(odds, content, strict=True)) + sum(w for u, v, w in edges if content[u] != content[v])


def least_cut(odds, edges) -> float:
    """The cost of the best of all labellings."""
    return min(cut_cost(odds, edges, c) for c in itertools.product((False, True), repeat=len(odds)))


def alignment(docs: list[tuple], encode_a, encode_b, bytes_a: list[bytes], bytes_b: list[bytes]) -> list[tuple]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each document, token by token."""
    whole, count = [], {}
    for i, text in docs:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(bytes_a[x] for x in a) != want or b"".join(bytes_b[x] for x in b) != want:
            a, b = [], []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(out)
        links = []
        k = 0
        for low, high, x in spans[0]:
            while k < len(spans[1]) and spans[1][k][1] <= low:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < high:
                links.append((x, spans[1][j][2]))
                j += 1
        cuts = sorted({h for _, h, _ in spans[0]} & {h for _, h, _ in spans[1]})
        written, low = [], 0
        for cut in cuts:
            written.append("|".join(",".join(str(x) for s, e, x in side if low < e <= cut) for side in spans) if len(cuts) < 400 else None)
            low = cut
        if cuts and len(cuts) >= 400:
            parts = [[[] for _ in cuts], [[] for _ in cuts]]
            for side, part in zip(spans, parts, strict=True):
                g = 0
                for _, e, x in side:
                    while cuts[g] < e:
                        g += 1
                    part[g].append(str(x))
            written = [",".join(p) + "|" + ",".join(q) for p, q in zip(*parts, strict=True)]
        for link in links:
            count[link] = count.get(link, 0) + 1
        whole.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(written).encode()).hexdigest() if cuts else ""))
    best: dict = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, na, nb, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest) for i, na, nb, g, links, digest in whole]
