"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, links):
    """Smallest id reachable of each id."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    return {i: top(i) for i in ids}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(docs):
    """doc_id: (n_shingles, component_id) of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(u, v) for k, u in enumerate(ids) for v in ids[k + 1 :] if sets[u] and sets[v] and 4 * min(len(sets[u]), len(sets[v])) >= 3 * max(len(sets[u]), len(sets[v])) and 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])]
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def linked_vectors(rows, threshold=0.93):
    """vec_id: (n_links, component_id) of (vec_id, embedding, label) rows."""
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, n = [], {i: 0 for i, _, _ in rows}
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    comp = components([i for i, _, _ in rows], links)
    return {i: (n[i], comp[i]) for i, _, _ in rows}


def quality(rows, max_rate=0.5):
    """doc_ids that stay, of (doc_id, source, text) rows."""
    failed, hosts = {}, {}
    for d, s, t in rows:
        w = WORD.findall(t or "")
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = {}
        for x in wins:
            seen[x] = seen.get(x, 0) + 1
        inside = {i + k for i, x in enumerate(wins) if seen[x] > 1 for k in range(5)}
        failed[d] = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        if s is not None:
            hosts.setdefault(s, []).append(failed[d])
    if not hosts:
        return {d for d, _, _ in rows if not failed[d]}
    rates = [sum(v) / len(v) for v in hosts.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    spread = mean * (1 - mean)
    between = max(1e-6, var - spread * sum(1 / len(v) for v in hosts.values()) / len(hosts))
    k = min(1000.0, max(2.0, spread / between - 1))
    ok = {h: (sum(v) + mean * k) / (len(v) + k) <= max_rate for h, v in hosts.items()}
    return {d for d, s, _ in rows if not failed[d] and ok.get(s, True)}


def line_key(line):
    return line.strip(WS).translate(LOWER)


def dedup_lines(rows):
    """doc_id: text without repeated lines, of (doc_id, text) rows."""
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = line_key(x)
            if len(k) >= 10:
                first[k] = min(d, first.get(k, d))
    return {d: "\n".join(x for x in (t or "").split("\n") if len(line_key(x)) < 10 or first[line_key(x)] == d) for d, t in rows}


def _mixed(x):
    """The 64-bit mixing step of the keyed hashes, on plain integers."""
    x = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) % (1 << 64)
    return x ^ (x >> 29)


def agenda(chunk, key, rate, p):
    """Piece ids of a chunk: every neighbouring pair is looked at anew before each merge."""
    symbols = [(int(p.char[ord(c)]), i, i + 1) for i, c in enumerate(chunk)]

    def skipped(start, mid, end):
        c = _mixed(start * 0x9E3779B97F4A7C15 % (1 << 64))
        c = _mixed((c + mid * 0xC2B2AE3D27D4EB4F) % (1 << 64))
        c = _mixed((c + end * 0x165667B19E3779F9) % (1 << 64))
        return (_mixed(_mixed((key + c) % (1 << 64))) >> 11) < rate * 2**53

    while True:
        best = min(
            (
                (int(p.rank_of[m]), i)
                for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                if (m := p.merge.get((a[0], b[0]))) is not None and not (rate > 0 and skipped(a[1], b[1], b[2]))
            ),
            default=None,
        )
        if best is None:
            break
        a, b = symbols[best[1] : best[1] + 2]
        symbols[best[1] : best[1] + 2] = [(p.merge[a[0], b[0]], a[1], b[2])]
    return [i for s, start, _ in symbols for i in ([s] if s < 1 << 20 else [p.byte_id[x] for x in chunk[start].encode()])]


def mix(docs, weights=(5, 2, 1), epochs=3, quantum=256, cut=True):
    """(target by source, words taken by doc_id) of (doc_id, source, text): all packets of all passes in one sorted list.

    Without ``cut`` the budget ends nothing, and every packet is taken.
    """
    size = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d] for d, x, _ in docs if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, full = sum(own.values()), set()
    while len(full) < len(sources):
        level = (total - sum(epochs * own[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and weight[s] * level >= epochs * own[s]}
        if not more:
            break
        full |= more
    target = {s: epochs * own[s] if s in full else weight[s] * level for s in sources}
    packets = []
    for s in sources:
        key = lambda d: hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:15]
        line = sorted((d for d, x, _ in docs if x == s), key=lambda d: (key(d), d is not None, d or 0))
        done = 0
        for epoch in range(epochs):
            for d in line:
                for k, at in enumerate(range(0, size[d], quantum)):
                    words = min(quantum, size[d] - at)
                    done += words
                    packets.append((done / target[s], s is not None, s or "", key(d), d is not None, d or 0, epoch, k, d, words))
    left, taken = total, dict.fromkeys(size, 0)
    for *_, d, words in sorted(packets):
        n = min(words, left) if cut else words
        taken[d] += n
        left -= n
    return target, taken
