"""The operators' contracts in plain Python, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def captures(pages):
    first, out = {}, {}
    for page, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault((html or "").encode(), page)
    for page, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        head = first[body]
        out[page] = (len(body), digest, "response" if head == page else "revisit", None if head == page else head)
    return out


def line_key(line):
    return line.strip("\x20\t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(docs, least=10):
    """doc -> lines kept; documents are in their order."""
    holders, out = {}, []
    for number, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            holders.setdefault(line_key(line), number)
    for number, (doc, text) in enumerate(docs):
        lines = (text or "").split("\n")
        out.append((doc, len(lines), [x for x in lines if len(line_key(x)) < least or holders[line_key(x)] == number]))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def jaccard(docs, n, percent):
    """(size, component) per document number."""
    sets = [grams(t, n) for _, t in docs]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = roots(range(len(sets)), links)
    return [(len(s), root[i]) for i, s in enumerate(sets)]


def repeats(docs, length=100):
    """(bytes, removed, spans, kept) per document, documents in their order."""
    seen, out = set(), []
    for _, text in docs:
        body = (text or "").encode()
        mark = bytearray(len(body))
        for i in range(len(body) - length + 1):
            window = body[i : i + length]
            if window in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for run in bytes(mark).split(b"\0") if run)
        out.append((len(body), sum(mark), spans, bytes(b for b, m in zip(body, mark) if not m)))
    return out


def pieces(ids, capacity):
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    raw = [b"".join(i.to_bytes(4, "little") for i in ids[a:b]) for a, b in zip(edges, edges[1:])]
    return [(n, a, len(r) // 4, zlib.crc32(r)) for n, (a, r) in enumerate(zip(edges, raw))]


def loads(rows):
    """sequence -> (offset, length) pairs."""
    out = defaultdict(list)
    for row in rows:
        out[row.sequence_id].append((row.offset, row.length))
    return out
