"""Plain versions of the corpus operators, quadratic where need be, for small inputs."""

import hashlib
import random
from collections import Counter, defaultdict


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def substring(rows, width=20):
    seen, out = set(), []
    for d, t in order(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def without_repeats(rows, width=20):
    """(doc_id, text without repeated words, whether it had words); untouched texts stay as they are."""
    seen, out = set(), []
    for d, t in order(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        out.append((d, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t, bool(w)))
    return out


def suffix(rows, span=50):
    seen, out = set(), []
    for d, t in order(rows):
        b = (t or "").encode()
        gone, mine = [False] * len(b), set()
        for i in range(len(b) - span + 1):
            k = b[i : i + span]
            if k in seen:
                gone[i : i + span] = [True] * span
            else:
                mine.add(k)
        seen |= mine
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def jaccard(rows):
    sets, inverted, root = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in inverted[g])
        for g in s:
            inverted[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def corpus(n=120, seed=1, vocabulary=400):
    """Random texts with exact and near copies, shared passages, very short and very long ones."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 17 == 0 else f"w{i}" for i in range(vocabulary)]
    say = lambda k: [r.choice(words) for _ in range(k)]
    passage, out = say(60), []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.2:
            t = list(r.choice(out))
        elif out and kind < 0.5:
            t = [r.choice(words) if r.random() < r.choice([0.01, 0.03, 0.08]) else w for w in r.choice(out)]
        elif kind < 0.6:
            t = say(r.randint(0, 12))
        else:
            t = say(r.randint(20, 200))
        if r.random() < 0.3:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 20) : r.randint(30, 60)] + t[at:]
        out.append(t)
    out.append(say(3000) + passage)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


#: Missing and empty texts, blanks, ties and repeated rows.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "one two"), (904, "one two"), (905, "ONE two")]
