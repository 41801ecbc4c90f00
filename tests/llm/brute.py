"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_vectors(rows, cosine=0.98):
    """rows: (vec_id, embedding, label) -> vec_id: (n_links, component)."""
    by = defaultdict(list)
    for vec, e, label in rows:
        ok = label is not None and vec is not None and e is not None and len(e) and all(x is not None for x in e)
        if ok:
            x = np.array(e, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                by[label, len(x)].append((vec, x))
    count, links = Counter(), []
    for group in by.values():
        ids = [v for v, _ in group]
        m = np.array([x for _, x in group])
        n = np.linalg.norm(m, axis=1)
        near = (m @ m.T) / (n[:, None] * n[None]) >= cosine
        for i, j in zip(*np.nonzero(near), strict=True):
            if i != j:
                count[ids[i]] += 1
                links.append((ids[i], ids[j]))
    comp = components({r[0] for r in rows if r[0] is not None}, links)
    return {v: (count[v], comp[v]) for v in comp}


def shingles(text, size):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_documents(rows, size, percent):
    """rows: (doc_id, text) -> doc_id: component."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = Counter()
    for i, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            both[i, j] = n
    links = [(sets[i][0], sets[j][0]) for (i, j), n in both.items() if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n)]
    return components({d for d, _ in rows}, links), {d: len(s) for d, s in sets}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    out.sort()
    spelt = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == x for _, k, _ in out) for x in range(3)], hashlib.sha256(spelt.encode()).hexdigest()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    hits, labels = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                hits.append(i)
                labels.add(label)
    return len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def line_dedup(rows, lead=3, percent=80, min_docs=3, min_tokens=5, long_tokens=50, long_docs=2):
    """rows: (doc_id, text), unique doc_id -> doc_id: text without recurring lines, of any length."""

    def parse(line):
        tokens = line.split()
        numbers = [bool(re.search("[0-9]", t)) for t in tokens]
        if any(numbers) and (2 * sum(numbers) > len(tokens) or all(numbers[:lead])):
            return False, tuple(tokens)
        return True, tuple("<*>" if n else t for t, n in zip(tokens, numbers, strict=True))

    held, leaves = defaultdict(set), defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            p = parse(line)
            if p[1]:
                held[p].add(d)
                if p[0] and len(p[1]) >= min_tokens:
                    leaves[len(p[1]), p[1][:lead]].add(p)
    links = []
    for group in leaves.values():
        group = sorted(group)
        for i, p in enumerate(group):
            links += [(p, q) for q in group[:i] if 100 * sum(x == y for x, y in zip(p[1], q[1], strict=True)) >= percent * len(p[1])]
    template = components(held, links)
    docs = defaultdict(set)
    for p, at in held.items():
        docs[template[p]] |= at
    first = {m: min(at) for m, at in docs.items() if len(at) >= (long_docs if len(m[1]) >= long_tokens else min_docs)}
    keep = lambda d, line: not (p := parse(line))[1] or first.get(template[p], d) == d
    return {d: t if t is None else "\n".join(x for x in t.split("\n") if keep(d, x)) for d, t in rows}


def redact(text, spans, mark="[SECRET]"):
    """``text`` with spans (start, end) written over; those that overlap are one."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def check_packing(rows, ids, window=4096):
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset) hold each
    id of each document once, in gapless sequences; the fill is returned."""
    import zlib

    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(map(len, ids.values())) / (window * len(seq)) if seq else 1.0


def sql_on(docs, sql):
    """Rows that SQL gives over documents of (doc_id, text, source) rows."""
    import duckdb
    import pyarrow as pa

    table = pa.table({"doc_id": [d for d, _, _ in docs], "text": [t for _, t, _ in docs], "source": [s for _, _, s in docs]})
    con = duckdb.connect()
    con.register("documents", table)
    return con.sql(sql).to_arrow_table().to_pylist()
