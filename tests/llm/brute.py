"""Plain Python versions of the operators' contracts, for small inputs."""

import base64
import hashlib
import math
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def decontamination(docs, items, n=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}; spans, too."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UPPER))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for k in range(len(w)):
            for s in sizes:
                if k + s <= len(w) and (x := windows.get(tuple(w[k:k + s]))):
                    hit.update(range(k, k + s))
                    found |= x
        found.discard(None)
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeated_words(docs, n=13):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (math.inf if d is None else d):
                gone.update(range(k, k + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(docs, n=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row"""
    raw = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in raw:
        for k in range(len(b) - n + 1):
            first[b[k:k + n]] = min(first.get(b[k:k + n], math.inf), math.inf if d is None else d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k:k + n]] < (math.inf if d is None else d):
                gone[k:k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return out


def base_scores(docs, held=10):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    counts, texts = {}, []
    for d, t in docs:
        is_held = zlib.crc32(str(d).encode()) % held == 0
        tokens = [*SPACED.findall((t or "").translate(UPPER)), None]
        texts.append((d, is_held, tokens))
        if not is_held:
            for x in tokens:
                counts[x] = counts.get(x, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    return {d: (h, len(x), sum(y in counts for y in x), total,
                sum(math.log10((counts.get(y, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for y in x)) for d, h, x in texts}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def shingles(text, n=5):
    w = SPACED.findall(text or "")
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(nodes, links):
    """{node: smallest node reachable}"""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def ctw_scores(docs, depth, held=10):
    """{doc_id: log10 probability} by the weighting's definition, node by node."""
    end = 0xFF
    nodes = {}  # (context, decisions with a leading 1) -> [zeros, ones]
    kids = {}

    def path(raw):
        seq = [end] * depth + list(raw.translate(bytes(UPPER.get(c, c) for c in range(256)))) + [end]
        for i in range(depth, len(seq)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = seq[i] >> k & 1
                yield tuple(seq[i - depth:i]), prefix, bit
                prefix = prefix << 1 | bit

    for d, t in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % held:
            for context, prefix, bit in path((t or "").encode()):
                for n in range(depth + 1):
                    key = (context[depth - n:], prefix)
                    nodes.setdefault(key, [0, 0])[bit] += 1
                    if n:
                        kids.setdefault((context[depth - n + 1:], prefix), set()).add(key)
    own, mixed = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        a, b = nodes[key]
        own[key] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(key[0]) == depth:
            mixed[key] = own[key]
        else:
            x, y = math.log(0.5) + own[key], math.log(0.5) + sum(mixed[c] for c in kids[key])
            mixed[key] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
    out = {}
    for d, t in docs:
        total = 0.0
        for context, prefix, bit in path((t or "").encode()):
            p, rest, deepest = 0.0, 1.0, None
            chain = [(context[depth - n:], prefix) for n in range(depth + 1)]
            chain = [k for k in chain if k in nodes]
            for n, key in enumerate(chain):
                a, b = nodes[key]
                one = (b + 0.5) / (a + b + 1)
                stop = 1.0 if n == len(chain) - 1 else math.exp(math.log(0.5) + own[key] - mixed[key])
                p += rest * stop * one
                rest *= 1 - stop
            if not chain:
                p = 0.5
            total += math.log10(p if bit else 1 - p)
        out[d] = total
    return out


def vector_links(rows, cosine=0.9):
    """[(vec_id, n_links, component_id)] by comparing all pairs."""
    def sound(v):
        return v is not None and any(x != 0 for x in v if x is not None) and all(x is not None and math.isfinite(x) for x in v)

    good = [k for k, (i, v) in enumerate(rows) if i is not None and sound(v)]
    links = []
    for x, a in enumerate(good):
        for b in good[x + 1:]:
            u, v = rows[a][1], rows[b][1]
            if len(u) == len(v) and sum(p * q for p, q in zip(u, v)) / math.sqrt(sum(p * p for p in u)) / math.sqrt(sum(q * q for q in v)) >= cosine:
                links.append((a, b))
    root = components(range(len(rows)), links)
    least = {}
    for k in good:
        least[root[k]] = min(least.get(root[k], math.inf), rows[k][0])
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return [(i, count[k], least[root[k]] if k in good else i) for k, (i, _) in enumerate(rows)]


def jaccard_links(rows, n=5, num=4, den=5):
    """[(doc_id, n_links, component_id)] by comparing all pairs of rows."""
    sets = [shingles(t, n) if i is not None else frozenset() for i, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = components(range(len(rows)), links)
    least, count = {}, [0] * len(rows)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], math.inf), i)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return [(i, count[k], i if i is None else least[root[k]]) for k, (i, _) in enumerate(rows)]
