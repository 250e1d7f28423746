"""MinHash classes against brute force, and edge cases."""

import random

from tessera.llm.near_dup import Banding, keep_one, near_duplicates, shingle_set


def brute(rows, words, percent):
    sets = [shingle_set((t or "").encode(), words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u, v = set(sets[i].tolist()), set(sets[j].tolist())
            if u and v and 100 * len(u & v) >= percent * len(u | v):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def made(seed, groups=12, size=6):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 400)}"
            rows.append((n, " ".join(t)))
            n += 1
    return rows


def test_components_match_brute_force(documents):
    for seed, words in ((1, 2), (2, 5)):
        rows = made(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), Banding(words=words)).collect()}
        assert got == brute(rows, words, 80)


def test_leftover_classes_are_compared(documents):
    # near copies of one base, from light to heavy edits: the first id is the heaviest and links with few
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for n in range(60):
        t = list(base)
        for at in rng.sample(range(120), max(0, 14 - n // 3)):
            t[at] = f"e{n}_{at}"
        rows.append((n, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), Banding(words=2)).collect()}
    assert got == brute(rows, 2, 80)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (None, "one"), (8, "x y z"), (4, "one")]
    got = sorted(near_duplicates(documents(rows), Banding(words=2)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 6, 7, 8)] == [0, 0, 0, 1, 1, 2, 1]
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[1].component_id == 1 and by[1].kept and by[2].component_id == 2
    assert by[None].component_id is None or by[None].kept
    assert near_duplicates(documents([]), Banding()).count() == 0


def test_keep_one_keeps_columns_and_one_of_each(documents):
    text = " ".join(f"w{k}" for k in range(40))
    docs = documents([(3, text), (2, text + " end"), (2, text + " end"), (9, "other words here now then"), (None, text)])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 9), (True, 0)]
