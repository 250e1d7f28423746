"""Line and sentence dedup against a plain pass in rank order that shares no code with it."""

import random

from tessera.llm.line_dedup import without_repeats

ENOUGH = 8


def plain_pieces(text):
    """[(start, end, words)] of sentences, character by character; a line end is a piece of its own, without words."""
    out, start, k = [], 0, 0
    while k < len(text):
        if text[k] == "\n":
            out += [(start, k, text[start:k].lower().split()), (k, k + 1, None)]
            start = k = k + 1
        elif text[k] in ".!?。！？…":
            while k < len(text) and text[k] in ".!?。！？…":
                k += 1
            while k < len(text) and text[k].isspace() and text[k] != "\n":
                k += 1
            out.append((start, k, text[start:k].lower().split()))
            start = k
        else:
            k += 1
    out.append((start, len(text), text[start:].lower().split()))
    return [p for p in out if p[2] is None or p[2]]


def size(words):
    return len(words) + sum("\u4e00" <= c <= "\u9fff" for w in words for c in w)


def plain_units(text):
    every = plain_pieces(text)
    own = [p for p in every if p[2]]
    spans = set()
    for i in range(len(own)):
        for j in range(i, len(own)):
            if sum(size(p[2]) for p in own[i : j + 1]) >= ENOUGH:
                spans.add((i, j))
                break
        for j in range(i, -1, -1):
            if sum(size(p[2]) for p in own[j : i + 1]) >= ENOUGH:
                spans.add((j, i))
                break
    line = []
    for p in [*every, (0, 0, None)]:
        if p[2] is None:
            if line and sum(size(q[2]) for q in line) >= ENOUGH:
                spans.add((own.index(line[0]), own.index(line[-1])))
            line = []
        else:
            line.append(p)
    return [(own[i][0], own[j][1], tuple(w for p in own[i : j + 1] for w in p[2])) for i, j in spans]


def brute(rows):
    first, out = {}, {}
    for doc_id, text in rows:
        for start, _, words in plain_units(text or ""):
            first[words] = min(first.get(words, (1 << 60, 0)), (doc_id, start))
    for doc_id, text in rows:
        gone = set()
        for start, end, words in plain_units(text or ""):
            if first[words] != (doc_id, start):
                gone.update(range(start, end))
        keep = []
        for k, c in enumerate(text or ""):
            if c == "\n" and k not in gone and k - 1 in gone:
                begin = k - 1
                while begin - 1 in gone:
                    begin -= 1
                if begin == 0 or text[begin - 1] == "\n":
                    continue
            if k not in gone:
                keep.append(c)
        out[doc_id] = "".join(keep) if text is not None else None
    return out


LINE = "One two three four five six seven eight nine ten."
TAIL = "Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen."
PASSAGE = f"{LINE} {TAIL} And so it goes on and on and on for a while."


def test_matches_brute_force(documents):
    rows = [(1, f"{LINE}\nmine alone it is and stays so here now"), (2, f"start of mine {PASSAGE} end of mine"), (3, f"{LINE}\n{LINE}\nshort"), (4, PASSAGE), (5, f"{PASSAGE}\n  {LINE.upper()}")]
    got = {r.doc_id: r.text for r in without_repeats(documents(rows)).collect()}
    assert got == brute(rows)
    assert LINE in got[1] and LINE in got[2] and TAIL in got[2] and TAIL not in got[4] and got[3] == "short"


def test_short_sentences_go_with_their_passage(documents):
    long = "This sentence has words enough to be a unit."
    rows = [(1, f"Mine alone. {long} Short one. And two. {TAIL} Ends here."), (2, f"before it {long} Short one. And two. {TAIL} Ends so."), (3, f"Other start. {long} Not that. {TAIL} Ends here.")]
    got = {r.doc_id: r.text for r in without_repeats(documents(rows)).collect()}
    assert got == brute(rows)
    assert got[1] == rows[0][1] and "Not that." in got[3] and "Ends so." in got[2] and TAIL not in got[2] and "And two." not in got[2]


def test_passages_of_short_lines_and_of_ideographs_go(documents):
    short = "\n".join(f"line {k} is short" for k in range(20))
    han = "天地玄黄宇宙洪荒。日月盈昃辰宿列张。寒来暑往秋收冬藏。"
    rows = [(1, f"mine\n{short}\nend"), (2, f"other start of it\n\n{short}\nother end"), (3, f"甲乙。{han}丙丁。"), (4, f"戊己{han}庚"), (5, "ha.\n" * 30)]
    got = {r.doc_id: r.text for r in without_repeats(documents(rows)).collect()}
    assert got == brute(rows)
    assert got[1] == rows[0][1] and got[2] == "other start of it\n\nother end" and got[3] == rows[2][1]
    assert "寒来暑往" not in got[4] and got[5].startswith("ha.") and len(got[5]) < 40


def test_random_texts_match_brute_force(documents):
    rng = random.Random(7)
    stock = [" ".join(rng.choice(["a", "bb", "C", "dd"]) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "", "?"]) for _ in range(25)]
    rows = [(i, "".join(rng.choice(stock) + rng.choice([" ", "\n", "\n\n", " "]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    got = {r.doc_id: r.text for r in without_repeats(documents(rows)).collect()}
    assert got == brute(rows)


def test_offsets_rebuild_the_text(documents):
    rows = [(1, PASSAGE), (2, f"ü before it all\n{PASSAGE}\nafter")]
    for r in without_repeats(documents(rows)).collect():
        text = dict(rows)[r.doc_id]
        assert "".join(text[s.start : s.end] for s in r["_lh_kept"]) == r.text


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, LINE), (3, LINE), (None, LINE), (4, "a b"), (5, "a b"), (6, LINE + "\r\n" + LINE)]
    found = without_repeats(documents(rows))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in found.collect())
    assert got == [((False, 1), None), ((False, 2), ""), ((False, 3), LINE), ((False, 3), LINE), ((False, 4), "a b"), ((False, 5), "a b"), ((False, 6), ""), ((True, 0), "")]
    assert found.columns[:-1] == documents(rows).columns
    assert without_repeats(documents([])).count() == 0


def test_long_document(documents):
    text = "\n".join(f"line number {k} holds words enough to be a unit" for k in range(20_000))
    assert {r.doc_id: len(r.text) for r in without_repeats(documents([(1, text), (2, text)])).collect()} == {1: len(text), 2: 0}
