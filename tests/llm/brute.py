"""Slow, plain versions of the contracts, over Python lists."""

import hashlib
import re


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def near(docs, n=2):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    from collections import Counter, defaultdict

    sets = {i: shingle_set(t, n) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        links += [(i, j) for j, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
    comp = roots(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text):
    spans = [("assign", *m.span()) for m in re.finditer(ASSIGN, text or "") if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


PARTS = r"[\x20\x09-\x0D()<>\[\]{}\"'`,;:=|]+"


def contexts(docs, support, confident):
    """doc_id -> context spans: the graph of instances and the one or two words on either side, scored until nothing changes."""
    from collections import Counter, defaultdict
    from math import prod

    totals, edges, found = Counter(), Counter(), defaultdict(list)
    seeds = set()
    tokens = lambda s: [w for w in re.split(PARTS, s.lower()) if w]
    for i, text in docs:
        text = text or ""
        words = tokens(text)
        totals.update(words), totals.update(" ".join(p) for p in zip(words, words[1:], strict=False))
        base = [(a, b) for _, a, b in personal(text)]
        other = [(m.start(), m.start() + len(m[0].rstrip(".!?"))) for m in re.finditer(PARTS.replace("[", "[^", 1), text) if re.search("[0-9@]", m[0])]
        other = [(a, b) for a, b in other if b - a >= 6 and ("@" in text[a:b] or len(re.sub("[^0-9]", "", text[a:b])) >= 4) and not any(a < d and c < b for c, d in base)]
        for kind, spans in ((True, base), (False, other)):
            for a, b in spans:
                value = text[a:b]
                if kind:
                    seeds.add(value)
                else:
                    found[i].append((a, b, value))
                left = tokens(text[:a]) if re.search(PARTS + "$", text[:a]) else []
                right = tokens(text[b:]) if re.match(PARTS, text[b:]) else []
                near = [" ".join(left[-n:]) for n in (1, 2) if len(left) >= n] + [">" + " ".join(right[:n]) for n in (1, 2) if len(right) >= n]
                edges.update((p, value) for p in near)
    degree = Counter(p for p, _ in edges)
    edges = {e: n for e, n in edges.items() if degree[e[0]] >= support}
    score = {v: float(v in seeds) for _, v in edges}
    good = {}
    while True:
        sums, known = Counter(), Counter()
        for (p, v), n in edges.items():
            sums[p] += n * score[v]
            known[p] += score[v] >= confident
        before, good = good, {p: min(0.999, sums[p] / totals[p.removeprefix(">")]) for p in sums if known[p] >= support and sums[p] / totals[p.removeprefix(">")] >= confident}
        score = {v: 1.0 if v in seeds else 1 - prod(1 - good.get(p, 0) for p, w in edges if w == v) for v in score}
        if len(before) == len(good):
            break
    return {i: [(a, b) for a, b, v in found[i] if v not in seeds and score.get(v, 0) >= confident] for i, _ in docs}


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)
