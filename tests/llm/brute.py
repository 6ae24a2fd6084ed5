"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def decontamination(docs, items, n=13):
    """docs, items: (id, text). -> {doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base kinds."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        x = re.sub("[^0-9]", "", m[0])
        if 16 <= len(x) <= 19 and luhn(x):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def revealing(texts, smooth, disclosure, chars=120, near=6):
    """{place of a text: {"term:start:end"}} of words near mentions of emails alone, scored over all texts."""
    import math

    term = re.compile(r"[^\W_]{3,}")
    known, of_term, both, places = defaultdict(set), defaultdict(set), defaultdict(set), []
    for d, t in enumerate(texts):
        t = t or ""
        for w in term.findall(t.lower()):
            of_term[w].add(d)
        spans = [(a, b) for _, a, b in personal(t)]
        for a, b in spans:
            value = t[a:b].lower()
            entities = [("v", value), ("g", value.partition("@")[2])]
            left, right = max(0, a - chars), min(len(t), b + chars)
            before = [(m.start() + left, m.end() + left) for m in term.finditer(t[left:a])][-near:]
            after = [(m.start() + b, m.end() + b) for m in term.finditer(t[b:right])][:near]
            before = [x for x in before if x[0] > left or left == 0]
            after = [x for x in after if x[1] < right or right == len(t)]
            for x, y in before + after:
                if not any(x < q and p < y for p, q in spans):
                    for e in entities:
                        both[e, t[x:y].lower()].add(d)
                        places.append((d, x, y, e))
            for e in entities:
                known[e].add(d)
    n, out = len(texts), {d: set() for d in range(len(texts))}
    for d, x, y, e in places:
        w = texts[d][x:y].lower()
        p = len(known[e]) / n
        given = (len(both[e, w]) + smooth * p) / (len(of_term[w]) + smooth)
        if p < 1 and math.log2(given / p) >= disclosure * -math.log2(p):
            out[d].add(f"term:{x}:{y}")
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def ring(keys, shards, virtual_nodes, slack, places):
    """{key: shard}: every key by itself, round by round, to the next node clockwise that has room."""
    import struct

    import xxhash

    taken = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            p = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % places
            while p in taken:
                p = (p + 1) % places
            taken[p] = s
    nodes = sorted(taken)
    fair = int(len(keys) * (1 + slack)) if slack else len(keys)
    room = [fair // shards + (s < fair % shards) for s in range(shards)]

    def placed(k):
        h = xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest()
        return h % places, h - (1 << 64) * (h >= 1 << 63), k

    waiting = sorted(((next((i for i, p in enumerate(nodes) if p >= x[0]), 0), *x) for x in map(placed, keys)))
    out, d = {}, 0
    while waiting:
        left = []
        for x in waiting:
            s = taken[nodes[(x[0] + d) % len(nodes)]]
            if room[s]:
                room[s] -= 1
                out[x[3]] = s
            else:
                left.append(x)
        waiting, d = left, d + 1
    return out


def language(text, net, window, widths, filters):
    """(language, score): every filter at every place of every window, one after the other."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    raw, total = text.encode(), [0.0] * len(net.langs)
    parts = [raw[i : i + window] for i in range(0, len(raw), window)]
    for part in parts:
        part = part + bytes(window - len(part))
        pooled = []
        for g, w in enumerate(widths):
            for f in range(filters):
                best = max(sum(float(net.tables[w][k][part[i + k]][f]) for k in range(w)) for i in range(window - w + 1))
                pooled.append(max(0.0, best + float(net.bias[g * filters + f])))
        z = [sum(p * float(net.dense[j][c]) for j, p in enumerate(pooled)) + float(net.offset[c]) for c in range(len(net.langs))]
        e = [math.exp(x - max(z)) for x in z]
        total = [t + x / sum(e) for t, x in zip(total, e)]
    best = max(range(len(total)), key=lambda c: (total[c], -c))
    return net.langs[best], total[best] / len(parts)


def hosts(rows, sure, least):
    """rows: (doc_id, text, host) -> {doc_id: (host_failed, host_rate)}"""
    count, fails = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        if host is not None:
            w, chars, symbols, dup, repeat = quality(text)
            lines = sum(bool(SPACED.search(x)) for x in (text or "").split("\n"))
            found = {"short": w < 20, "repeated": 100 * repeat > 30 * w, "symbols": 10 * symbols > w, "dup": 10 * dup > 3 * lines, "odd": w > 0 and (chars < 2 * w or chars > 15 * w)}
            count[host] += 1
            for k, v in found.items():
                fails[k][host] += v
    n, verdict = sum(count.values()), {h: (False, 0.0) for h in count}
    for f in fails.values():
        p = sum(f.values()) / n
        seen = sum(count[h] * (f[h] / count[h] - p) ** 2 for h in count)
        noise = n - sum(c * c for c in count.values()) / n - (len(count) - 1)
        rho = min(1, max(0, (seen / (p * (1 - p)) - (len(count) - 1)) / noise)) if 0 < p < 1 and noise > 0 else 0
        for h, c in count.items():
            if rho == 0:
                rate, failed = p, False
            else:
                weight = 1 / rho - 1
                a, b = p * weight + f[h], (1 - p) * weight + c - f[h]
                rate = a / (a + b)
                doubt = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
                failed = rate - sure * doubt > p + (p * (1 - p) * rho) ** 0.5 and rate >= least
            verdict[h] = (verdict[h][0] or failed, max(verdict[h][1], round(rate, 9)))
    return {d: verdict.get(h, (False, None)) for d, _, h in rows}


def safe(x):
    return re.sub(r"<(\\*)\|", r"<\1\\|", x)


def safe_role(x):
    return re.sub(r"\|(\\*)>\n", "|\\1\\\\>\n", safe(x))


def snapshots(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, copies, rendered)}"""
    key = lambda x: (x is not None, x or 0)
    word = lambda x: (x is not None, x or "")
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((key(t), word(r), word(x), r, x))
    lists = {c: tuple((r, x) for *_, r, x in sorted(v, key=lambda y: y[:3])) for c, v in convs.items()}
    copies = defaultdict(list)
    for c, v in lists.items():
        copies[v].append(c)
    shorter = {v[:k] for v in copies for k in range(1, len(v))}
    return {min(c for c in ids if c is not None) if any(c is not None for c in ids) else None: (len(v), len(ids), "".join(f"<|{safe_role(r or '')}|>\n{safe(x or '')}\n" for r, x in v)) for v, ids in copies.items() if v not in shorter}


def license_base(text):
    """(n_words, n_base, first, last, base_labels)"""
    w = alnum_words(text)
    found = []
    for phrase, label in ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")):
        found += [(i, label) for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def shingles(text, n=5):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing the pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    done = set()
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def crc(text):
    return zlib.crc32((text or "").encode())


def license_rules(text, rules):
    """Detections of all rules, each run over the whole text, and what is left when each is compared with each."""
    found = {(m.start(), m.end(), label, level, sure) for label, p, level, sure in rules for m in re.finditer(p, text or "", re.ASCII)}
    order = sorted(found, key=lambda x: (x[0], -x[1], -x[3], x[2]))
    kept = [x for i, x in enumerate(order) if not any(y[1] >= x[1] and y[3] >= x[3] for y in order[:i])]
    return sorted((a, b, label, sure) for a, b, label, _, sure in kept)
