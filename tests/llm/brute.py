"""Plain versions of the operators' contracts, over lists of (doc_id, text)."""

import hashlib
import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[j:] for j in range(5)]))


def components(rows):
    """{doc_id: (set size, component)}; rows without an id stand alone."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            both = len(x & y)
            if both and 100 * both >= 85 * len(x | y):
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(rows, width=50):
    """{row number: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - width + 1):
            w = b[a : a + width]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < key(i):
                hit[a : a + width] = b"\1" * width
        spans = sum(1 for k in range(len(hit)) if hit[k] and (k == 0 or not hit[k - 1]))
        out.append((i, len(b), sum(hit), spans, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return sorted(out, key=str)


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(len(words), 10)
        for p in range(len(words) - n + 1) if n and item is not None else ():
            windows[tuple(words[p : p + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                owners = windows.get(tuple(words[p : p + n]))
                if owners:
                    hit |= set(range(p, p + n))
                    found |= owners
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def runs(words, length=24, times=3):
    """[(start, stop, smallest period)] of maximal runs, by start and period."""
    best, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, times * q):
                best[i, j + q] = min(q, best.get((i, j + q), q))
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def simhash(text, size=3):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, radius=2):
    """[(doc_id, fingerprint in hex, component)] of every row."""
    prints = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and bin(a ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g) if i is not None else None) for (i, _), p, g in zip(rows, prints, group)), key=str)


def trie(sequences):
    """Rows of the trie of {conv_id: [(role, text)]}, by building every prefix."""
    members = defaultdict(list)
    for conv in sorted(sequences):
        for d in range(len(sequences[conv]) + 1):
            members[tuple(sequences[conv][:d])].append(conv)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[c] for c in below) or 1
        last = len(prefix[-1][1]) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * last + sum(saved[c] for c in below)
    rows = []
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(sequences[c]) == len(prefix))
        above = members[prefix[:-1]][0] if prefix else None
        rows.append((convs[0], len(prefix), above, len(convs), len(children[prefix]), leaves[prefix], saved[prefix], sha(ends)))
    return sorted(rows, key=str)


def rebuilt(rows):
    """{conv_id: turns} as the registered query builds them from (conv_id, turn, role, text)."""
    import zlib

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def random_tokens(text, fdr=0.01, reject=4.0, least=20):
    """[(start, stop)] of the tokens that the battery of randomness tests reports, from its description."""
    import math
    import string

    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    encodings = [
        digits, digits + "abcdef", digits + "ABCDEF", lower, upper + "234567", digits + lower, digits + upper, digits + upper + lower,
        upper + lower + digits + "+/", upper + lower + digits + "-_", upper + lower + digits + "+/-_=",
    ]
    kind = lambda c: 0 if c in lower else 1 if c in upper else 2 if c in digits else 3
    tested = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or ""):
        if len(m[0]) < least:
            continue
        body = m[0].rstrip("=")
        n = len(body)
        letters = next((e for e in encodings if set(body) <= set(e)), None)
        if n < 2 or letters == digits:
            continue
        size = len(letters)
        counts = [body.count(c) for c in letters]
        chi2 = size / n * sum(c * c for c in counts) - n
        changes = sum(kind(a) != kind(b) for a, b in zip(body, body[1:]))
        places = [letters.index(c) + 1 for c in body]
        mean = sum(places) / n
        spread = sum(x * x for x in places) - n * mean * mean
        r = sum((x - mean) * (y - mean) for x, y in zip(places, places[1:])) / spread if spread > 1e-9 else 1.0
        free = size - 1
        uniform = ((chi2 / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
        shares = [sum(kind(c) == k for c in letters) / size for k in range(4)]
        rate = 1 - sum(x * x for x in shares)
        runs = (changes - (n - 1) * rate) / math.sqrt((n - 1) * max(rate * (1 - rate), 0.05))
        z1 = (free + (n - 1) * (size * 0.075 - 1) - chi2) / (size * math.sqrt((n - 1) / n * 2 * 0.075))
        z2 = (changes - (n - 1) * 0.1) / math.sqrt((n - 1) * 0.09)
        z3 = (0.5 - r) * math.sqrt(n)
        z = max(-12.0, min(12.0, (z1 + z2 + z3) / math.sqrt(3) if rate > 1e-12 else z1))
        p = 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))
        tested.append((m.start(), m.end(), n >= least and uniform <= reject and abs(runs) <= reject, p))
    ps = sorted(p for _, _, ok, p in tested if ok)
    limit = max((p for k, p in enumerate(ps) if p <= fdr * (k + 1) / len(tested)), default=-1.0)
    return [(a, b) for a, b, ok, p in tested if ok and p <= limit]
