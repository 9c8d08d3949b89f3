"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def backoff(texts, alpha=0.4):
    grams = [Counter(tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in map(words, texts)]
    total = sum(grams, Counter())
    n_all = sum(len(words(t)) for t in texts)
    out = []
    for t, own in zip(texts, grams):
        w = words(t)
        c, rest, score, level = (lambda g, own=own: total[g] - own[g]), n_all - len(w), 0.0, Counter()
        for i, x in enumerate(w):
            weight = 1.0
            for k in range(min(i, 2), -1, -1):
                g = tuple(w[i - k:i + 1])
                if c(g) > 0:
                    score += math.log(weight * c(g) / (c(g[:-1]) if k else rest))
                    level[k + 1] += 1
                    break
                if k:
                    weight *= alpha
            else:
                score += math.log(weight / (rest + 1))
                level[0] += 1
        out.append((len(w), score if w else None, level[3], level[2], level[1], level[0]))
    return out


def substring(rows, width=13):
    first = {}
    rank = lambda i: (i is None, i)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if key not in first or rank(i) < rank(first[key]):
                first[key] = i
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if rank(first[tuple(w[k:k + width])]) < rank(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def rotate(rows, size=64, context=8, limit=256):
    """rows: (conv, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, role or "unknown", text or ""))
    out = []
    for conv, turns in talks.items():
        speakers = sorted({r for _, r, _ in turns if r != "system"}) or [None]
        pieces = defaultdict(list)
        for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())):
            pieces[None if t[0] is None else t[0] // size].append(t)
        for piece, whole in pieces.items():
            told = pieces.get(piece - 1, []) if piece is not None else []
            told = [t for t in told if t[0] % size >= size - context] if len(told) <= limit else []
            for part in range(-(-len(whole) // limit)):
                own = whole[part * limit: (part + 1) * limit]
                before = told if part == 0 else []
                for me in speakers:
                    text, spans = "", []
                    for k, (_, role, body) in enumerate(before + own):
                        name = "system" if role == "system" else "assistant" if role == me else f"user name={role}"
                        text += f"<|im_start|>{name}\n"
                        start = len(text)
                        text += f"{body}<|im_end|>"
                        if role == me and k >= len(before):
                            spans.append(f"{start}-{len(text)}")
                        text += "\n"
                    out.append((conv, piece, part, me, text, ",".join(spans), len(spans), len(own), len(before)))
    return out


def shingle_set(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def suffix(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def segmentations(lex, text, n):
    """The n best (score, ids) of a text, by dynamic programming over whole lists."""
    s = "▁" + text.replace(" ", "▁") if text else ""
    table = [[(0.0, ())]]
    for i in range(1, len(s) + 1):
        found = []
        for k in range(1, min(lex.longest, i) + 1):
            p = s[i - k:i]
            if p in lex.id_of:
                edge = (lex.score[lex.id_of[p]], (lex.id_of[p],))
            elif k == 1:
                edge = (lex.floor, tuple(lex.unknown_ids(p)))
            else:
                continue
            found += [(a + edge[0], x + edge[1]) for a, x in table[i - k]]
        table.append(sorted(found, key=lambda z: -z[0])[:n])
    return table[-1]
