"""Small document tables with the awkward cases, and plain re-statements of what the operators compute."""

import re
from collections import Counter, defaultdict
from itertools import combinations

DOCS = "doc_id long, text string, lang string, keep_id string, n long"
WORD = re.compile("[^\x20\x09-\x0D]+")

BASE = ("the quick brown fox jumps over the lazy dog and then it runs to the river of the town "
        "where all the people are with their dogs in the evening sun of a long warm day")


def awkward(spark, extra=()):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, extra columns named like results."""
    rows = [
        (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n"),
        (None, BASE), (None, "only without id"), (7, "one"), (8, "One"), (9, BASE + " indeed"),
        (10, " ".join(f"w{i % 977}x{i}" for i in range(20_000))), *extra]
    return spark.createDataFrame([(i, t, "en", "k", i) for i, t in rows], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def near_documents(n=60, seed=5):
    """Families of texts with a few changed words, chains of them, and a passage that many share."""
    import random

    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "elo", "iti", "oru", "umi")]
    passage = [rnd.choice(words) for _ in range(40)]
    out, i = [], 0
    while i < n:
        text = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        if rnd.random() < 0.4:
            text = passage + text[: rnd.randint(5, 60)]
        for _ in range(rnd.randint(1, 6)):
            out.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    return out


def shingles(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if len(words) >= width:
        return frozenset(tuple(words[a:a + width]) for a in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(docs, width, up, down):
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, found in sets.items():
        for g in found:
            lists[g].append(i)
    common = Counter(p for v in lists.values() for p in combinations(v, 2))
    for (a, b), n in common.items():
        if down * n >= up * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
