"""Small corpora with planted copies, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgéñü") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed=1, n=120):
    """Random texts, exact copies, near copies, shared passages, short, blank and null texts."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    line = lambda a, b: " ".join(rng.choice(vocab) for _ in range(rng.randint(a, b)))
    passages = [line(13, 70) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.1:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            w = words(rng.choice(out))
            for _ in range(max(1, len(w) // rng.choice([15, 25, 40, 60]))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        elif kind < 0.6:
            out.append("\n".join([line(3, 60), rng.choice(passages), line(3, 60)]))
        else:
            out.append("\n".join(line(1, 40) for _ in range(rng.randint(1, 6))))
    out += [None, "", " \t\n", "one", "one", "two words", rng.choice(vocab) * 3, "a b c d", "a b c d", "A B c D"]
    out += ["x y " * 60, ("loop " * 30).strip(), ("loop " * 31).strip()]
    return out


def shingles(text, n=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, linked)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def covered_words(rows, run):
    """{doc: set of word positions covered by runs that a smaller doc_id has}."""
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - run + 1):
            k = tuple(w[p:p + run])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = {q for p in range(len(w) - run + 1) if first[tuple(w[p:p + run])] < i for q in range(p, p + run)}
    return out


def word_edits(item, part):
    """Least edits of item against any run of part."""
    row = [0] * (len(part) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(part):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (v != w)))
        row = new
    return min(row)
