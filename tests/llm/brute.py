"""Plain Python versions of the operators, and documents to compare them on."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\f\r"
EDGES = ".,;:!?\"'()[]{}<>*_-«»“”„¿¡…"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, personal data, odd characters, empty and null ones."""
    rng = random.Random(seed)
    syllables = ["the", "of", "and", "ti", "on", "re", "é", "ä", "ing", "st", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    shared = [line(25) for _ in range(3)]
    rows = []
    for i in range(n):
        text = "\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        kind = i % 10
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        if kind == 2 and rows:
            text = (rng.choice(rows)[1] or "").replace("a", "o", 1)
        if kind in (3, 4):
            text += "\n" + rng.choice(shared) + "\n" + line(5)
        if kind == 5:
            text = rng.choice(["", None, " \t\n", "Ünḯ 日本語 😀 x y \U0001f9ea", "a  b\t c\x0bd\x1ce", "İSTANBUL ǅ ß ﬁ"])
        if kind == 6:
            text += f" me{i}@mail.example.com 4111 1111 1111 1111, +1 (555) 010-{i:04d}, 10.0.0.{i}"
        rows.append((i, text, rng.choice(["en", "fr", None]), "src0" if i % 3 == 0 else f"src{i}", 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def decontaminated(rows, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    sizes, out = {len(w) for w in windows}, {}
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit.update(range(k, k + size))
                    found |= own
        out[doc] = (len(hit), sorted(map(str, found)))
    return {d: v for d, v in out.items() if v[0]}


def simhash(text, width, seed=42):
    raw = (text or "").encode().lower().split()
    shingles = [b" ".join(raw[k : k + width]) for k in range(max(1, len(raw) - width + 1))] if raw else []
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def near(rows, distance, width, seed=42):
    prints = {d: simhash(t, width, seed) for d, t, *_ in rows}
    return prints, components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def removed_lines(rows, least=20, edits=1):
    places = defaultdict(list)
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line.strip(SPACE)) >= least:
                places[line.strip(SPACE)].append((doc, k))
    gone = defaultdict(set)
    for line, own in places.items():
        first = min(own)
        late = edits and any(min(p) < first for other, p in places.items() if other != line and one_edit(line, other))
        for doc, k in own:
            if late or (doc, k) != first:
                gone[doc].add(k)
    return gone


def without_repeats(rows, length=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t, *_ in sorted(rows, key=lambda r: r[0])]
    for doc, b in data:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], doc)
    out = {}
    for doc, b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < doc:
                mark[p : p + length] = b"\1" * length
        out[doc] = (len(b), sum(mark), bytes(mark).count(b"\0\1") + (mark[:1] == b"\1"), bytes(x for x, m in zip(b, mark, strict=True) if not m))
    return out


def base_counts(text):
    own = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = defaultdict(list)
    for k in range(len(own) - 4):
        windows[tuple(own[k : k + 5])].append(k)
    repeated = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(5)}
    n = len(own)
    return (n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def verdicts(rows, rules, vocabulary, common, classes):
    """Which documents the quality rules keep: base counts, and distances from summed histograms."""
    histograms = {}
    for doc, text, lang, *_ in rows:
        t = text or ""
        own = re.findall("[^\x20\x09-\x0d]+", t)
        counts = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.strip(EDGES)) for w in own)
        by_word = [counts[w] for w in vocabulary]
        by_class = [len(re.findall(p, t)) for p in classes.values()] + [len(t.encode()) - len(t)]
        letters = sum(map(len, own))
        histograms[doc] = (by_word + [len(own) - sum(by_word)], by_class + [max(0, letters - sum(by_class))], len(own), letters, lang)
    references = {}
    for lang in common:
        used = [h for h, r in zip(histograms.values(), rows, strict=True) if h[4] == lang and h[2] >= rules.word_guard and not base_counts(r[1])[5]]
        if used:
            references[lang] = [np.sum([h[i] for h in used], axis=0) / max(1, np.sum([h[i] for h in used])) for i in (0, 1)]

    def distance(counts, q):
        p = np.array(counts) / max(1, sum(counts))
        m = (p + q) / 2
        return np.sqrt(max(0, sum(0.5 * (x * np.log2(x / z) if x else 0) for v in (p, q) for x, z in zip(v, m, strict=True))))

    kept = set()
    for doc, text, *_ in rows:
        words_, chars, n, letters, lang = histograms[doc]
        known = references and (lang is None or lang in references)
        far = known and n >= rules.word_guard and min(distance(words_, r[0]) for r in references.values()) > rules.max_word_distance
        odd = known and letters >= rules.char_guard and min(distance(chars, r[1]) for r in references.values()) > rules.max_char_distance
        if not (base_counts(text)[5] or far or odd):
            kept.add(doc)
    return kept


def alike_groups(rows, similarity=0.8, width=5):
    """The smallest doc_id reachable over texts whose shingle sets are as similar, pair by pair."""
    sets = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode().lower().split()
        sets[doc] = {b" ".join(raw[k : k + width]) for k in range(max(1, len(raw) - width + 1))} if raw else set()
    return components(sets, lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


def near_items(rows, items, n=10, slop=2):
    """For each doc_id, the items with a window whose two rarest terms are in place but for ``slop`` words."""
    texts = {d: words(t) for d, t, *_ in rows}
    counts = Counter(w for own in texts.values() for w in own)
    out = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            window = w[k : k + size]
            if all(counts[x] for x in window):
                rarest = sorted((counts[x], at, x) for at, x in enumerate(window))
                (_, a, x), (_, b, y) = rarest[0], rarest[min(1, size - 1)]
                for doc, own in texts.items():
                    for p in [p for p, z in enumerate(own) if z == x]:
                        spots = range(max(0, p + b - a - slop), p + b - a + slop + 1) if size > 1 else [p]
                        if any(q < len(own) and own[q] == y for q in spots):
                            out[doc].add(str(item))
    return {d: sorted(v) for d, v in out.items()}


def pipeline(rows, items, rules, vocabulary, common, classes):
    """doc_id and text that the filtering stages keep."""
    good = verdicts(rows, rules, vocabulary, common, classes)
    rows = [r for r in rows if r[0] in good]
    gone = removed_lines(rows)
    rows = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), *rest) for d, t, *rest in rows]
    groups = alike_groups(rows)
    rows = [r for r in rows if groups[r[0]] == r[0]]
    hit = decontaminated(rows, items)
    return {r[0]: r[1] for r in rows if r[0] not in hit}
