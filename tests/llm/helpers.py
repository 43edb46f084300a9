"""Small odd inputs and brute-force versions for the llm operators."""

from __future__ import annotations

import hashlib
import random
import re
import string

CLASHING = "block bigint, bucket string, rank int, _id string, _text string, data string, node int, _block string"


def prose(rnd: random.Random, words: int) -> str:
    vocabulary = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "Theta", "iota", "kappa", "x", "日本"]
    return " ".join(rnd.choice(vocabulary) + str(rnd.randint(0, 400)) for _ in range(words))


def odd_documents(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, blank, short, long and repeated rows."""
    rnd = random.Random(seed)
    rows: list[tuple] = []
    originals = [prose(rnd, rnd.randint(5, 120)) for _ in range(30)]
    passage = prose(rnd, 60)
    for i, t in enumerate(originals):
        rows.append((i, t))
        if i % 3 == 0:
            rows.append((100 + i, t))
        if i % 4 == 0:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            rows.append((200 + i, " ".join(w)))
        if i % 5 == 0:
            rows.append((300 + i, prose(rnd, 10) + "\n" + passage + "\n" + prose(rnd, 10)))
    rows += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "one two"), (405, "One  TWO\n"), (None, originals[0])]
    rows += [(406, "ab" * 40000), (407, "ab" * 30), (408, "zz " * 3000), (1, originals[1]), (1, originals[1]), (None, None)]
    rows += [(-7, originals[2] + " tail"), (409, "a\nb\nc\nd"), (410, "x\na\nb\nc\ny\na\nb"), (411, "it's they're 'll <|endoftext|> !")]
    return rows


def document_frame(spark, rows):
    """The rows with extra columns whose names clash with those inside the operators."""
    data = [(i, t, 1, "b", 2, "i", "t", "d", 3, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, " + CLASHING)


def brute_suffix(rows, window: int):
    first: dict[bytes, int] = {}
    for i, t in rows:
        if i is None:
            continue
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            w = b[j : j + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if i is not None and first[b[j : j + window]] < i:
                cover[j : j + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, words: int) -> frozenset:
    lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1))


def components(items, linked) -> dict:
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def brute_jaccard(rows, words: int, upper: int, lower: int):
    sets = [shingles(t, words) for _, t in rows]
    ids = [i for i, _ in rows]
    live = [k for k in range(len(rows)) if ids[k] is not None and sets[k]]
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in live:
        for b in live:
            if a < b and lower * len(sets[a] & sets[b]) >= upper * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets)), key=repr)


def _lengths(least: int, most: int) -> list[int]:
    """The lengths that doubling passes: powers of two below ``least``, then ``least`` times them."""
    out = [n for n in (1 << k for k in range(30)) if n < least]
    return out + [n for n in (least << k for k in range(30)) if n <= most]


def brute_lines(rows, least: int, long_bytes: int | None = None, whole_copies: bool = False):
    split = {r: (t or "").split("\n") for r, (_, t) in enumerate(rows)}
    places = sorted((i, j, r) for r, (i, _) in enumerate(rows) if i is not None for j in range(len(split[r])))
    lengths = _lengths(least, max(map(len, split.values()), default=1))
    first: dict[tuple, tuple] = {}
    for i, j, r in places:
        for n in {1, *lengths}:
            if j + n <= len(split[r]):
                first.setdefault(tuple(split[r][j : j + n]), (i, j, r))
    first_text: dict[str, int] = {}
    for i, j, r in places:
        first_text.setdefault("\n".join(split[r]), i)
    runs: dict[int, set] = {r: set() for r in split}
    for i, j, r in places:
        lines = split[r]
        later = [n for n in lengths if n >= least and j + n <= len(lines) and first[tuple(lines[j : j + n])][:2] < (i, j)]
        if later:
            _, at, other = first[tuple(lines[j : j + max(later)])]
            n = max(later)
            while j + n < len(lines) and at + n < len(split[other]) and lines[j + n] == split[other][at + n]:
                n += 1
            runs[r].add((j, j + n))
        if long_bytes is not None and len(lines[j].encode()) >= long_bytes and first[(lines[j],)][:2] < (i, j):
            runs[r].add((j, j + 1))
        if whole_copies and rows[r][1] and len(lines) < least and first_text["\n".join(lines)] < i:
            runs[r].add((0, len(lines)))
    out = []
    for r, (i, t) in enumerate(rows):
        spans = [b - a for a, b in runs[r] if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in runs[r])]
        gone = [any(a <= j < b for a, b in runs[r]) for j in range(len(split[r]))]
        kept = "\n".join(x for x, g in zip(split[r], gone) if not g) if spans else (t or "")
        out.append((i, len(gone), sum(gone), len(spans), max(spans, default=0), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
