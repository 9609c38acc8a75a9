"""Plain Python versions of the operators, row by row and pair by pair."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op1(docs, tokenizer, end):
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def op2(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op5(docs, seed, alpha):
    """Copies of each document, by its source's rate; rates are drawn in parts of at most 8."""
    chars = defaultdict(float)
    for _, source, text in docs:
        chars[source] += len(text or "")
    total = sum(chars.values())
    weight = sum(c**alpha for c in chars.values() if c)
    out = {}
    for doc, source, _ in docs:
        n = 1
        if chars[source]:
            rate = chars[source] ** alpha / weight * total / chars[source]
            parts, n = max(1, math.ceil(rate / 8)), 0
            for part in range(1, parts + 1):
                u = int(hashlib.md5(f"{seed}:{part}:{doc}".encode()).hexdigest()[:13], 16) / 2**52
                term = whole = math.exp(-rate / parts)
                k = 0
                while u >= whole and k < 48:
                    k += 1
                    term *= rate / parts / k
                    whole += term
                n += k
        if n:
            out[doc] = n
    return out


def fingerprint(text):
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op6(docs):
    fps = {doc: fingerprint(text) for doc, text in docs}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    group = components(ids, links)
    return [(d, f"{fps[d]:016x}", group[d]) for d in ids]


def op7(docs, window=13):
    first = {}
    words = {doc: SPACED.findall(text or "") for doc, text in docs}
    for doc in sorted(words):
        w = words[doc]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), doc)
    out = []
    for doc, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op8(vectors, least=0.93):
    good = {v: e for v, e, label in vectors if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    labels = {v: label for v, _, label in vectors}
    ids, links = sorted(good), []
    norm = {v: math.sqrt(sum(x * x for x in good[v])) for v in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if labels[a] == labels[b] and sum(x * y for x, y in zip(good[a], good[b], strict=True)) / (norm[a] * norm[b]) >= least:
                links.append((a, b))
    group = components([v for v, _, _ in vectors], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(v, n[v], group[v], group[v] == v) for v in sorted(group)]


def op4(pages):
    data = {p: (html or "").encode() for p, html in pages}
    digest = {p: hashlib.sha1(b).hexdigest() for p, b in data.items()}
    best = defaultdict(int)
    for p, d in digest.items():
        best[d] = max(best[d], p)
    out = []
    for p, b in data.items():
        again = len(b) >= 1000 and best[digest[p]] != p
        out.append((p, len(b), digest[p], "revisit" if again else "response", best[digest[p]] if again else None))
    return sorted(out)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def rebuilt(rows):
    """Turns (role, text) of every rebuilt conversation, from (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = original.get(c - math.fmod(c, 100), [])[:h] + own[h:]
    return out


def op11(convs):
    """Nodes of the trie of {conv_id: turns}, subtree by subtree."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    out = []
    for key, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(convs[c]) == len(key))))
        up = min(members[key[:-1]]) if key else None
        out.append((min(found), len(key), up, len(found), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def periodic(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words, least=24):
    """(start, length, period) of every run, from all periods; a stretch counts for its smallest one."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i < len(words) - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(least, 3 * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def op12(docs):
    out = []
    for doc, text in docs:
        words = periodic(doc, SPACED.findall(text or ""))
        found = runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        spelled = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(spelled), sha(kept)))
    return out


def op13(vectors, k=20):
    good = [(v, e) for v, e in vectors if v is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = []
    for q, asked in good:
        if q % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(asked, e, strict=True)), v) for v, e in good if v != q and len(e) == len(asked)]
            out += [(q, r, v, -s) for r, (s, v) in enumerate(sorted(scored)[:k], 1)]
    return out
