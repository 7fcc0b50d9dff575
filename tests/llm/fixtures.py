"""Small tables with every awkward row, and plain-Python counterparts of the operators."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string, score string, n_words string"


def prose(rng, n, vocabulary=400, lang="en"):
    mark = {"en": "th", "fr": "é", "de": "ß"}[lang]
    words = [mark + "".join(rng.choice("abcdefghijklmno") for _ in range(2 + i % 5)) for i in range(vocabulary)]
    out = [rng.choice(words) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += "."
    return " ".join(out)


def messy_rows(seed=1, n=40):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(60, 200), lang=("en", "fr", "de")[i % 3])
        if i % 5 == 0:
            text = text + "\n" + passage + "\n" + prose(rng, 30)
        rows.append((i, text, ("en", "fr", "de")[i % 3], f"s{i % 4}"))
    base = rows[3][1]
    edited = base.split(" ")
    edited[len(edited) // 2] = "CHANGED"
    rows += [
        (n, base, "en", "s0"), (n + 1, " ".join(edited), "en", "s0"),  # an exact and a near copy
        (n + 2, None, "en", "s1"), (n + 3, "", "en", "s1"), (n + 4, " \n\t ", None, None), (n + 5, "one two", "fr", "s2"),
        (n + 6, "one two", "fr", "s2"), (n + 7, "a " * 3000, "en", "s3"), (n + 8, "日本語 текст 😀 <|endoftext|> x", None, "s3"),
        (n + 9, prose(rng, 3000), "en", None), (None, prose(rng, 80), "de", "s1"), (n + 10, "x" * 700, "en", "s2"),
    ]
    rows += [rows[5], rows[5]]  # wholly repeated rows
    return [(*r, None if r[1] is None else len(r[1]), "a", "b", "c", "d") for r in rows]


def messy(spark, n=40):
    return spark.createDataFrame(messy_rows(n=n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def order_key(row):
    """Nulls first."""
    return (row[0] is not None, row[0] or 0)


def substring_brute(rows, width=20):
    """{(doc_id, text): number of removed words}, kept words, by all windows in order."""
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (order_key(r), r[1] or ""))
    seen, out = {}, {}
    for doc in distinct:
        ws = words(doc[1])
        keep = [True] * len(ws)
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            if w in seen:
                keep[s : s + width] = [False] * width
            else:
                seen[w] = (doc, s)
        out[doc] = (len(ws), [w for w, k in zip(ws, keep) if k])
    return out


def shingles(text, k=5):
    ws = words(text)
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)}


def near_classes_brute(rows, similarity=0.8):
    """{(doc_id, text): class id} by comparing all pairs."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (order_key(r), r[1] or ""))
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and (docs[a][1] == docs[b][1] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = lambda g: min((d[0] for d in g if d[0] is not None), default=None)
    return {d: least(g) for g in groups.values() for d in g}
