"""Plain-Python versions of the operators' contracts, one text at a time."""

import base64
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def secrets(t):
    rules = [("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
    out = []
    for k, (name, rx) in enumerate(rules):
        for m in re.finditer(rx, t or "", re.I if name == "assign" else 0):
            if len(m[2] if name == "assign" else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), name))
    return [(n, a, b) for a, _, b, n in sorted(out)]


def luhn(x):
    t = 0
    for i, ch in enumerate(reversed(x)):
        v = int(ch)
        t += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return t % 10 == 0


def personal(t):
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def ok(k, m):
        n = re.sub("[^0-9]", "", m)
        return (k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 16 <= len(n) <= 19 and luhn(n)
                or k == "phone" and 8 <= len(n) <= 15)

    return [(k, m.start(), m.end()) for k, rx in rules for m in re.finditer(rx, t or "") if ok(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def contamination(docs, bench):
    """{doc_id: (n_words, n_hit, item ids)}"""
    windows = {}
    for i, t in bench:
        w = BENCH_WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w, items = BENCH_WORD.findall(lower(t)), set()
        hit = [0] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    items |= found
                    hit[k:k + n] = [1] * n
        out[i] = (len(w), sum(hit), sorted(str(x) for x in items if x is not None))
    return out


def fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=2):
    """fps: {id: fingerprint}; {id: least reachable id}"""
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 3000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if hit is None else len(hit)


def sha1_base32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()
