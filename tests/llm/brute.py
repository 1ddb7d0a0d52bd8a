"""Plain versions of the operators, over lists of (id, text)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(w, n=5):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def measures(text):
    w, t = words(text), text or ""
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep), "n_stutter": sum(a == b for a, b in zip(w, w[1:])), "n_upper": sum("A" <= c <= "Z" for c in t),
        "n_letters": sum(c.isascii() and c.isalpha() for c in t), "n_letter_words": sum(any(c.isascii() and c.isalpha() or ord(c) >= 128 for c in x) for x in w),
        "n_insults": sum(x.translate(LOW) in ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron") for x in w),
    }


def fails(m):
    return [
        m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 15 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        10 * m["n_dup_lines"] > 3 * m["n_lines"], 10 * m["n_stutter"] > 3 * m["n_words"], 10 * m["n_upper"] > 3 * m["n_letters"], 10 * m["n_letter_words"] < 7 * m["n_words"],
        m["n_insults"] >= 2 and 200 * m["n_insults"] >= m["n_words"],
    ]


def near(rows, percent=85):
    """id -> component."""
    sets = [(i, shingles(words((t or "").translate(LOW)))) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, r in sets[a + 1 :]:
            both = len(s & r)
            if s and r and 100 * both >= percent * (len(s) + len(r) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def repeated(rows, length, units, first=False):
    """For each row, which of its units a repeated window covers."""
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        u = units(t)
        for a in range(len(u) - length + 1):
            seen[tuple(u[a : a + length])].append((k, a))
    gone = [[False] * len(units(t)) for _, t in rows]
    for v in seen.values():
        for k, a in (v[1:] if first else v) if len(v) > 1 else []:
            gone[k][a : a + length] = [True] * length
    return gone


def cut_words(text, gone):
    out, last = [], 0
    spans = [m.span() for m in WORD.finditer(text or "")]
    for (a, _), nxt, g in zip(spans, [s for s, _ in spans[1:]] + [len(text or "")], gone):
        if g:
            out.append(text[last:a])
            last = nxt
    return "".join(out) + text[last:] if any(gone) else text


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def plain(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").translate(LOW)).split()


def leaks(rows, items, threshold=0.6, overlap=0.8, segment=64):
    """Pairs of ids, by scoring every passage against every entry."""
    from tidegrid.llm.leaks import parts_of

    entries = []
    for i, t in items:
        w = plain(t)
        for part in range(-(-len(w) // segment)):
            own = w[part * segment : (part + 1) * segment]
            entries.append((i, Counter(w[-segment:] if part and len(own) < segment else own)))
    df = Counter(t for _, e in entries for t in e)
    mean = sum(sum(e.values()) for _, e in entries) / max(1, len(entries))
    weighed = []
    for i, e in entries:
        n = sum(e.values())
        x = {t: math.log1p((len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for t, f in e.items()}
        weighed.append((i, {t: v / sum(x.values()) for t, v in x.items()}))
    parts = {i: [(min(5, len(plain(p.decode()))), shingles(plain(p.decode()))) for p in parts_of(t)] for i, t in items}
    out = set()
    for d, t in rows:
        w = plain(t)
        hits = defaultdict(list)
        for p in range(max(1, -(-len(w) // segment))):
            have = set(w[p * segment : (p + 2) * segment])
            for i, x in weighed:
                if sum(v for k, v in x.items() if k in have) >= threshold - 1e-9:
                    hits[i].append(p)
        for i, ps in hits.items():
            near = w[max(0, (min(ps) - 1) * segment) : (max(ps) + 3) * segment]
            if all(not sh or sum(s in {tuple(near[k : k + n]) for k in range(len(near) - n + 1)} for s in sh) / len(sh) >= overlap for n, sh in parts[i]):
                out.add((d, i))
    return out
