"""Suffix, MinHash, paragraph and line dedup against brute force and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest

from pulselake.llm._store import components
from pulselake.llm.lines import _radius, edit_distance, fuzzy_lines, gram_bitmaps, line_parts, most_grams, normal_form, similar, without_fuzzy_lines
from pulselake.llm.near import Banding, drop_near_duplicates, estimated_jaccard, minhashes, near_duplicates, odd_sketches
from pulselake.llm.paragraphs import repeated_paragraphs, tuned, without_repeats
from pulselake.llm.passages import least_within, shared_passages
from pulselake.llm.substrings import refined, remove_repeats
from pulselake.llm._text import text_shingles

DOC = "doc_id long, text string"


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}é"[: rnd.randint(2, 6)] for _ in range(n))


def letters(rnd, n):
    """Words without a likeness."""
    return " ".join("".join(rnd.choice("bcdéfghjklmnpqrstvz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    marks = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                marks[i][s : s + length] = b"\x01" * length
    return raw, marks


def test_suffix_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(0, 260)) for _ in range(40)]
    texts = base + [b[:500] + prose(rnd, 30) + b[500:] for b in base[:15]] + base[:6] + [None, "", "é" * 700, "ab" * 400, base[0][100:420]]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    raw, marks = brute_removed(texts, 200)
    for i, (b, m) in enumerate(zip(raw, marks)):
        runs = [(x.start(), x.end()) for x in re.finditer(b"\x01+", bytes(m))]
        assert [(s.start, s.end) for s in got[i].spans] == runs
        assert bytes(got[i].kept) == bytes(np.frombuffer(b, np.uint8)[~np.frombuffer(bytes(m), bool)]) if b else bytes(got[i].kept) == b""
        assert got[i].n_bytes == len(b)


def test_suffix_dedup_crowded_anchor_by_window_counts(spark, monkeypatch):
    import pulselake.llm.substrings as s

    monkeypatch.setattr(s, "CROWDED", 1)
    rnd = random.Random(6)
    line = prose(rnd, 60)
    texts = [prose(rnd, 40) + line + prose(rnd, 40) for _ in range(12)]
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    raw, marks = brute_removed(texts, 200)
    assert any(map(any, marks))
    for i, (b, m) in enumerate(zip(raw, marks)):
        assert got[i] == bytes(x for x, y in zip(b, m) if not y)


def test_refinement_finds_every_repeated_window():
    rnd = random.Random(1)
    buf = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(900)), np.uint8)
    off = np.array([0, 300, 301, 900])
    windows = {}
    for a, b in zip(off, off[1:]):
        for s in range(a, b - 16 + 1):
            windows.setdefault(bytes(buf[s : s + 16]), []).append(s)
    with np.errstate(over="ignore"):
        assert sorted(refined(buf, off, 16)) == sorted(s for v in windows.values() if len(v) > 1 for s in v)


def test_suffix_dedup_odd_tables(spark):
    assert remove_repeats(spark.createDataFrame([], DOC)).count() == 0
    long = "x y" * 100
    rows = [(None, long, "a"), (None, long, "b"), (1, None, "c"), (1, None, "c")]
    got = remove_repeats(spark.createDataFrame(rows, DOC + ", spans string")).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, 0, 0] and sorted(r.n_bytes for r in got) == [0, 0, 300, 300]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sets


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rnd = random.Random(k)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one two"]
    for _ in range(12):
        b = prose(rnd, 120).split()
        texts.append(" ".join(b))
        for _ in range(rnd.randint(0, 9)):
            c = list(b)
            for _ in range(rnd.randint(0, 8)):
                c[rnd.randrange(len(c))] = "zz"
            texts.append("\n".join([" ".join(c[:50]), " ".join(c[50:])]))
    roots, sets = brute_components(texts, k, 80)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC), Banding(shingle=k)).collect()}
    for i, r in enumerate(roots):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (r, len(sets[i]), r == i)


def test_crowded_bucket_loses_no_link(spark, monkeypatch):
    import pulselake.llm.near as near

    monkeypatch.setattr(near, "BLOCK", 16)
    rnd = random.Random(9)
    base = prose(rnd, 100).split()
    texts = []
    for _ in range(60):
        c = list(base)
        for _ in range(rnd.randint(4, 14)):
            c[rnd.randrange(100)] = f"q{rnd.randrange(9999)}"
        texts.append(" ".join(c))
    roots, _ = brute_components(texts, 2, 80)
    assert len(set(roots)) > 1
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC), Banding(shingle=2)).collect()}
    assert [got[i] for i in range(60)] == roots


def test_near_duplicates_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    t = "a b c d e f g h"
    rows = [(None, t, 1), (3, t, 1), (3, t, 1), (3, "other words stand here for once", 1), (None, None, 1)]
    got = near_duplicates(spark.createDataFrame(rows, DOC + ", component_id int")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    left = drop_near_duplicates(spark.createDataFrame(rows, DOC + ", n int")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [(3, t), (3, rows[3][1]), (None, None)])) and left[0].n == 1


def test_near_duplicates_are_dropped_by_row_not_by_id(spark):
    rnd = random.Random(13)
    a, b, c, d, e = (prose(rnd, 80, 9000) for _ in range(5))
    rows = [(1, a), (None, a + " tail"), (None, b), (None, None), (None, ""), (7, c), (7, c + " tail"), (7, d), (2, e), (7, e + " tail")]
    left = [(r.doc_id, r.text) for r in drop_near_duplicates(spark.createDataFrame(rows, DOC)).collect()]
    both_c = [x for x in left if x[1] in (c, c + " tail")]
    want = [(1, a), (None, b), (None, None), (None, ""), (7, d), (2, e)]
    assert len(both_c) == 1 and sorted(map(str, set(left) - set(both_c))) == sorted(map(str, want)) and len(left) == 7


def test_odd_sketch_estimates_similarity():
    import pyarrow as pa

    rnd = random.Random(2)
    a = [f"x{i}" for i in range(400)]
    b = a[:360] + [f"y{i}" for i in range(40)]
    with np.errstate(over="ignore"):
        h, off = text_shingles(pa.array([" ".join(a), " ".join(b)]), 1)
        k = odd_sketches(minhashes(h, off, 100))
    differ = int(np.bitwise_count(k[0] ^ k[1]).sum())
    assert abs(estimated_jaccard(differ, 100) - 360 / 440) < 0.15 and rnd


def test_components_agree_in_both_ways(spark):
    rnd = random.Random(4)
    e = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)] + [(7, 7)]
    df = spark.createDataFrame(e + [(None, 3)], "a long, b long")
    one, many = (sorted(map(tuple, components(df, most).collect())) for most in (1000, 5))
    assert one == many and (1030, 1000) in one and (7, 7) not in one or (7, 7) in many
    assert components(df.limit(0)).count() == 0


def test_repeated_paragraphs(spark):
    rnd = random.Random(3)
    p = [prose(rnd, 60) for _ in range(6)]
    near = p[0].split()
    near[5] = "changed"
    short = "too short to count"
    rows = [(1, f"{p[0]}\n{p[1]}\n{short}"), (2, f"{p[2]}\n{' '.join(near)}"), (3, f"{short}\n{p[3]}\n{p[1]}"), (4, None), (5, ""), (6, f"{p[4]}\n{p[4]}")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], DOC + ", pos string")
    got = {(r.doc_id, r.pos): (tuple(r.component), r.repeated, r.removed) for r in repeated_paragraphs(docs).collect()}
    assert got[(1, 0)] == ((1, 0), True, False) and got[(2, 1)] == ((1, 0), True, True)
    assert got[(3, 2)] == ((1, 1), True, True) and got[(6, 1)] == ((6, 0), True, True) and got[(2, 0)] == ((2, 0), False, False)
    assert (1, 2) not in got and not any(d in (4, 5) for d, _ in got)
    left = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert left == {1: rows[0][1], 2: p[2], 3: f"{short}\n{p[3]}", 4: None, 5: "", 6: p[4]}
    assert repeated_paragraphs(docs.limit(0)).count() == 0


def test_short_paragraphs_are_compared(spark):
    five, nine = "one two three four five", "this line of nine words stands in two texts"
    docs = spark.createDataFrame([(1, f"{five}\n{nine}"), (2, f"{nine}\nsix words stand here only once"), (3, five)], DOC)
    got = {(r.doc_id, r.pos): (r.repeated, r.removed) for r in repeated_paragraphs(docs).collect()}
    assert got == {(1, 0): (True, False), (1, 1): (True, False), (2, 0): (True, True), (2, 1): (False, False), (3, 0): (True, True)}


def test_paragraphs_equal_brute_force(spark):
    """Every pair of paragraphs, by the Jaccard similarity of their five-word shingles; texts that repeat, near copies and crowds of one passage."""
    rnd = random.Random(17)
    passage = letters(rnd, 14)
    lines = []
    for _ in range(25):
        w = letters(rnd, rnd.choice([5, 6, 9, 20, 60, 120])).split()
        lines.append(" ".join(w))
        for _ in range(rnd.randint(0, 4)):
            c = list(w)
            for _ in range(rnd.randint(0, 1 + len(w) // 40)):
                c[rnd.randrange(len(c))] = "changed"
            lines.append(" ".join(c))
    lines += [f"{letters(rnd, 3)} {passage} {letters(rnd, 2)}" for _ in range(30)] + ["four words are here", ""]
    rnd.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = rnd.randint(1, 4)
        docs.append((len(docs), "\n".join(lines[at : at + n])))
        at += n
    flat = [((i, pos), x) for i, t in docs for pos, x in enumerate(t.split("\n")) if len(words(x)) >= 5]
    roots, _ = brute_components([x for _, x in flat], 5, 80)
    got = {(r.doc_id, r.pos): (tuple(r.component), r.repeated, r.removed) for r in repeated_paragraphs(spark.createDataFrame(docs, DOC)).collect()}
    order = [u for u, _ in flat]
    least = {r: min(order[i] for i in range(len(order)) if roots[i] == r) for r in set(roots)}
    assert got == {u: (least[r], roots.count(r) > 1, u != least[r]) for u, r in zip(order, roots)}
    assert any(x[2] for x in got.values())


def test_passages_equal_brute_force(spark):
    """Passages at any place of a line and over its end, next to each other, in one text twice; runs one word too short; repeated rows and ids."""
    rnd = random.Random(11)
    passages = [letters(rnd, n).split() for n in (50, 51, 51, 52, 60, 130, 300)] + [["la"] * 70, ["a", "b"] * 40]
    docs = []
    for i in range(160):
        words = letters(rnd, rnd.choice([0, 3, 40, 200])).split()
        for _ in range(rnd.randrange(3)):
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(passages)
        docs.append((i, "".join(w + rnd.choice("  \n \t") for w in words)))
    docs += [(5, docs[9][1]), docs[7], (None, docs[12][1]), (None, docs[12][1]), (900, None), (901, ""), (902, docs[6][1].upper() if docs[6][1].isascii() else docs[6][1])]
    folded = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    holders = {}
    for i, _, w in folded:
        for at in range(len(w) - 50):
            holders.setdefault(tuple(w[at : at + 51]), set()).add(i)
    want = set()
    for i, t, w in folded:
        inside = set()
        for at in range(len(w) - 50):
            if len(holders[tuple(w[at : at + 51])]) > 1:
                inside.update(range(at, at + 51))
        if inside:
            # runs that only touch are one
            want.add((str(i), sum(x - 1 not in inside for x in inside), len(inside)))
    got = shared_passages(spark.createDataFrame(docs, DOC).repartition(5)).collect()
    assert {(str(r.doc_id), r.n_passages, r.n_words) for r in got} == want and len(want) > 60
    assert len(got) == len({(r.doc_id, r.txt) for r in got})
    assert shared_passages(spark.createDataFrame(docs[:1], DOC)).count() == 0 and shared_passages(spark.createDataFrame([], DOC)).count() == 0
    v = np.array([rnd.randrange(1000) for _ in range(200)], np.uint64)
    assert all(least_within(v, k).tolist() == [min(v[i : i + k]) for i in range(len(v) - k + 1)] for k in (1, 2, 3, 31, 44))


def test_words_said_over_and_over_meet_once(spark, monkeypatch):
    """A text that says one pair of words a thousand times sends its windows once, not once a place."""
    seen = []
    docs = spark.createDataFrame([(1, "la li " * 1000), (2, "la li " * 900 + "end")], DOC)
    real = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a: (seen.append(df.count()), real(df, *a))[1])
    got = {r.doc_id: (r.n_passages, r.n_words) for r in shared_passages(docs).collect()}
    assert got == {1: (1, 2000), 2: (1, 1800)} and seen and seen[0] < 50


def test_passage_inside_other_paragraphs(spark):
    """Over 50 words in two paragraphs that are otherwise unlike count as repeated; a short line that many documents have is alike, but no such passage."""
    from pulselake.llm import queries

    rnd = random.Random(5)
    same, short = letters(rnd, 55), letters(rnd, 8)
    docs = spark.createDataFrame([(1, f"{letters(rnd, 90)} {same}\n{short}"), (2, f"{letters(rnd, 30)} {same} {letters(rnd, 60)}"), (3, f"{letters(rnd, 70)}\n{short}"), (4, None)], DOC)
    got = {r.doc_id: (r.n_units, r.n_alike, r.n_repeated, r.n_repeated_words, r.n_removed) for r in queries._with_passages(docs, queries._by_document(docs, repeated_paragraphs(docs))).collect()}
    assert got == {1: (2, 1, 1, 55, 0), 2: (1, 0, 1, 55, 0), 3: (2, 1, 0, 0, 1), 4: (0, 0, 0, 0, 0)}


def test_paragraphs_odd_tables(spark):
    """Null and repeated ids, repeated rows, ties, a very long paragraph, clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, long, 1), (2, long + " tail", 1), (2, "one two three four five six", 1), (2, "one two three four five six", 1), (9, "One TWO three four five six", 2), (7, None, 1), (8, " \n", 1)]
    got = sorted((str(r.doc_id), r.pos, str(r.component.id), r.removed) for r in repeated_paragraphs(spark.createDataFrame(rows, DOC + ", removed int")).collect())
    assert len(got) == 5 and [g for g in got if g[0] == "9"] == [("9", 0, "2", True)] and sum(g[3] for g in got) == 2
    left = without_repeats(spark.createDataFrame(rows, DOC + ", removed int"))
    assert left.columns == ["doc_id", "text", "removed"] and left.count() == len(rows)


def test_band_tuning():
    h = tuned(80, 0.9995, 3)
    assert 1 - (1 - 0.8**3) ** h.bands >= 0.9995 and h.rows == 3


def test_edit_distance_is_exact():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    rnd = random.Random(8)
    x = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(18))) for _ in range(800)]
    y = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(18))) for _ in range(800)]
    for n in (63, 64, 65, 130, 300, 1500):
        for _ in range(12):
            t = [rnd.choice("abcdefgh 漢") for _ in range(n)]
            x.append("".join(t))
            for _ in range(rnd.randrange(n // 3)):
                t[rnd.randrange(len(t))] = rnd.choice(["", "z", "yy"])
            y.append("".join(t))
    d = [plain(a, b) for a, b in zip(x, y)]
    assert d == [edit_distance(a, b) for a, b in zip(x, y)]
    for percent in (50, 80, 95):
        with np.errstate(over="ignore"):
            assert similar(x, y, percent).tolist() == [k <= max(len(a), len(b)) * (100 - percent) // 100 for a, b, k in zip(x, y, d)]


def changed(rnd, w, vocabulary):
    """One to three words of a line replaced, put in, left out or mistyped."""
    w = list(w)
    for _ in range(rnd.randint(1, 3)):
        i, how = rnd.randrange(len(w)), rnd.randrange(6)
        if how <= 2:
            w[i] = rnd.choice(vocabulary)
        elif how == 3:
            w.insert(i, rnd.choice(vocabulary))
        elif how == 4 and len(w) > 1:
            del w[i]
        else:
            w[i] = w[i][: len(w[i]) // 2] + rnd.choice("xyz") + w[i][len(w[i]) // 2 + 1 :]
    return w


@pytest.mark.parametrize("n", [2, 3, 5, 8, 12, 15, 20, 31, 40, 80])
def test_candidates_of_fuzzy_lines_reach_a_recall_of_nine_tenths(n):
    """All pairs at edit similarity 0.8 of a line and its changed copy, by number of words: blocks and SimHash screen against the edit distance alone."""
    rnd = random.Random(n)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 300:
        a = [vocabulary[int(3000 * rnd.random() ** 2)] for _ in range(n)]
        x, y = " ".join(a), " ".join(changed(rnd, a, vocabulary))
        if x != y and edit_distance(x, y) <= max(len(x), len(y)) * 20 // 100:
            pairs.append((x, y))
    with np.errstate(over="ignore"):
        parts = [line_parts([p[i] for p in pairs]) for i in (0, 1)]
    keys = [[set(p[6][p[7][i] : p[7][i + 1]].tolist()) for i in range(len(pairs))] for p in parts]
    near = np.bitwise_count(parts[0][5].view(np.uint64) ^ parts[1][5].view(np.uint64)) <= _radius(np.minimum(parts[0][2], parts[1][2]))
    with np.errstate(over="ignore"):
        bits = [gram_bitmaps([p[i] for p in pairs]) for i in (0, 1)]
    apart = np.maximum(bits[0][1], bits[1][1]) - np.bitwise_count(bits[0][0] & bits[1][0]).sum(1)
    near &= apart <= most_grams(np.maximum(parts[0][2], parts[1][2]), 80)
    found = [bool(a & b) and bool(ok) for a, b, ok in zip(*keys, near)]
    print(n, "words: recall", np.mean(found))
    assert np.mean(found) >= 0.9


def brute_lines(norm):
    root = list(range(len(norm)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(norm)):
        for j in range(i):
            if norm[i] and norm[j] and edit_distance(norm[i], norm[j]) <= max(len(norm[i]), len(norm[j])) * 20 // 100:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(norm))]


def test_fuzzy_lines_equal_brute_force(spark):
    rnd = random.Random(12)
    base = [letters(rnd, 40) for _ in range(10)]
    lines = []
    for b in base:
        lines.append(b)
        for _ in range(rnd.randint(0, 4)):
            c = b.split()
            c[rnd.randrange(40)] = f"n{rnd.randrange(10)}"
            lines.append(" ".join(c).upper() + rnd.choice(["", ".", " !"]))
    lines += ["page 12 of 90 here", "Page 77 of 13 here!", "x", "X.", "...", "the meeting on tuesday will begin at the old office", "the meeting on thursday will begin at the old offices"]
    docs = spark.createDataFrame([(i, f"{x}\n", "k") for i, x in enumerate(lines)] + [(900, None, ""), (901, "", None)], DOC + ", pos string")
    norm = [" ".join(re.findall(r"[^\W_]+", re.sub("[1-9]", "0", x.lower()))) for x in lines]
    assert norm == [normal_form(x) for x in lines]
    root = brute_lines(norm)
    got = {r.doc_id: r.component[0] for r in fuzzy_lines(docs).collect()}
    assert got == {i: root[i] for i in range(len(lines)) if norm[i]}
    assert len(set(got.values())) < len(got)
    left = {r.doc_id: r.text for r in without_fuzzy_lines(docs).collect()}
    assert left[0] == lines[0] + "\n" and left[900] is None and left[lines.index("Page 77 of 13 here!")] == "" and left[lines.index("X.")] == ""
    assert fuzzy_lines(docs.limit(0)).count() == 0


def test_crowded_block_of_lines_loses_no_link(spark, monkeypatch):
    """Two hundred lines share one passage, many of them are alike, some are not."""
    import pulselake.llm.near as near

    monkeypatch.setattr(near, "BLOCK", 32)
    rnd = random.Random(21)
    kinds = [letters(rnd, 12) for _ in range(9)]
    lines = [f"{k} posted by the editor on the front page" + rnd.choice(["", " today", " again"]) for k in kinds for _ in range(12)] + [letters(rnd, 14) + " posted by the editor on the front page" for _ in range(60)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], DOC)
    root = brute_lines([normal_form(x) for x in lines])
    assert len(set(root)) == 69
    assert {r.doc_id: r.component[0] for r in fuzzy_lines(docs).collect()} == dict(enumerate(root))


def test_alike_lines_with_unlike_simhashes_are_linked(spark):
    """A letter in most words changed, some words in a row whole: similar by edits, a block in common, SimHashes far apart."""
    rnd = random.Random(31)
    pairs = []
    while len(pairs) < 12:
        a = ["".join(rnd.choice("bcdfghjklmnpqrstvz") for _ in range(rnd.randint(7, 10))) for _ in range(20)]
        b = [w if 7 <= i < 13 else w[:3] + "a" + w[4:] for i, w in enumerate(a)]
        x, y = " ".join(a), " ".join(b)
        with np.errstate(over="ignore"):
            parts = line_parts([x, y])
        keys = [set(parts[6][parts[7][i] : parts[7][i + 1]].tolist()) for i in (0, 1)]
        if keys[0] & keys[1] and int(np.bitwise_count(parts[5].view(np.uint64)[0] ^ parts[5].view(np.uint64)[1])) > _radius(np.array([len(x)]))[0]:
            assert edit_distance(x, y) <= len(x) * 20 // 100
            pairs.append((x, y))
    got = {r.doc_id: r.component[0] for r in fuzzy_lines(spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], DOC)).collect()}
    assert got == {i: i // 2 * 2 for i in range(2 * len(pairs))}


def test_windows_tell_apart_only_what_is_apart():
    from pulselake.llm.lines import LONG_LINE, _code_points, surely_apart

    rnd = random.Random(8)
    x, y = [], []
    for n in (1, 5, 12, 30, 60, 90, 250):
        for _ in range(60):
            a = letters(rnd, n)
            c = list(a)
            for _ in range(rnd.randint(0, max(1, len(a) // 3))):
                at = rnd.randrange(len(c) + 1)
                c[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "\u0451", "\U0001f600", " "])
                c = c or ["q"]
            b = "".join(c) if rnd.random() < 0.8 else letters(rnd, n // 2 + 1) + a[len(a) // 3 :]
            x.append(a), y.append(b)
    (dx, ox), (dy, oy) = _code_points(x), _code_points(y)
    n, m = np.diff(ox), np.diff(oy)
    most = np.maximum(n, m) * 20 // 100
    near = np.abs(n - m) <= most
    true = np.array([edit_distance(a, b) for a, b in zip(x, y)]) <= most
    with np.errstate(over="ignore"):
        apart = surely_apart(dx, ox[:-1], n, dy, oy[:-1], m, most) & near
        assert not (apart & true).any() and apart.sum() > 50 and (n > LONG_LINE).any()
        assert (similar(x, y, 80) == true).all()


def test_pieces_tell_apart_only_what_is_apart():
    """Changed copies within and beyond the threshold, other alphabets and unlike lengths: none that is near is ruled out, unlike lines of one vocabulary nearly all are."""
    from pulselake.llm.lines import _classes, _code_points, in_pieces_apart

    rnd = random.Random(18)
    x, y = [], []
    for n in (1, 3, 8, 20, 60, 90, 250):
        for kind in range(120):
            a = letters(rnd, n) if kind % 5 else "".join(rnd.choice("\u0430\u0431\u0451\u4e2d ab") for _ in range(5 * n))
            c = list(a)
            for _ in range(rnd.randint(0, max(1, len(a) // 4))):
                at = rnd.randrange(len(c) + 1)
                c[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "\u0451", "\U0001f600", " ", "ab"])
                c = c or ["q"]
            cut = rnd.randint(0, len(c) // 5)
            x.append(a), y.append("".join(c[cut:] + (c[:cut] if kind % 3 == 0 else [])) or "q")
    (dx, ox), (dy, oy) = _code_points(x), _code_points(y)
    n, m = np.diff(ox), np.diff(oy)
    most = np.maximum(n, m) * 20 // 100
    true = np.array([edit_distance(a, b) for a, b in zip(x, y)]) <= most
    c, oy = _classes(np.concatenate([dx, dy])), oy + len(dx)
    with np.errstate(over="ignore"):
        apart = in_pieces_apart(c, ox[:-1], n, oy[:-1], m, most)
        assert not (apart & true).any() and true.sum() > 100
        assert not (in_pieces_apart(c, oy[:-1], m, ox[:-1], n, most) & true).any()
        words = [letters(rnd, 1) for _ in range(400)]
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(55, 65))) for _ in range(60)]
        d, off = _code_points(lines)
        i, j = np.triu_indices(60, 1)
        n = np.diff(off)
        most = np.maximum(n[i], n[j]) * 20 // 100
        close = np.abs(n[i] - n[j]) <= most
        assert in_pieces_apart(_classes(d), off[i], n[i], off[j], n[j], most)[close].mean() > 0.9


def test_few_unlike_lines_of_a_block_are_compared(monkeypatch):
    """Of the pairs of a crowded bucket only those that pieces leave open reach the comparison; the links are those of the edit distance."""
    import pyarrow as pa

    from pulselake.llm import lines as module

    rnd = random.Random(19)
    words = [letters(rnd, 1) for _ in range(70)]
    texts = [" ".join(rnd.sample(words, 64)) for _ in range(80)]
    texts += [f"{t} again" for t in texts[:7]]
    n = len(texts)
    ints = lambda v: pa.array(v, pa.int64())
    bucket = pa.table({"key": ints([5] * n), "node": ints(range(n)), "root": ints(range(n)), "n": ints([len(t) for t in texts]), "s0": ints([0] * n), "bands": pa.array([[5]] * n, pa.list_(pa.int64())), "text": texts, "i": ints([0] * n), "j": ints([0] * n), "own": ints([0] * n)})
    compared, within = [], module.within
    monkeypatch.setattr(module, "within", lambda d, c, x0, *rest: compared.append(len(x0)) or within(d, c, x0, *rest))
    with np.errstate(over="ignore"):
        got = {(a, b) for r in module.true_links(iter([bucket]), 80) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())}
    assert got == {(i, 80 + i) for i in range(7)}
    assert sum(compared) < 500, sum(compared)  # of 3 741 pairs


def test_open_links_grow_with_members_not_with_pairs(spark):
    """One bucket of 60 nodes that are all alike and of different roots: 59 links join them, not 1 770."""
    from pyspark.sql import functions as F

    from pulselake.llm.near import Banding, open_links, shingle_sets

    how = Banding(shingle=2, bands=1, rows=1)
    words = [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(words + [f"x{i}"])) for i in range(60)] + [(99, "quite another text")], "node long, text string")
    members = shingle_sets(texts, how).select(F.lit(5).cast("long").alias("key"), F.lit(61).cast("long").alias("m"), "node", F.col("node").alias("root"), F.lit(40).cast("long").alias("n"), F.array(F.lit(5).cast("long")).alias("bands"), "shingles")
    got = open_links(members, how).collect()
    assert len(got) == 59 and len({x for r in got for x in (r.a, r.b)}) == 60 and 99 not in {x for r in got for x in (r.a, r.b)}


def test_fuzzy_lines_odd_tables(spark):
    """Repeated rows and ids, null ids, ties, clashing column names and a very long text."""
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(None, "one line of a few words here", 1), (3, "one line of a few words here", 1), (3, "one line of a few words here", 1), (5, long, 2), (4, long + " more", 2), (6, "\n \n\t", 3)]
    got = sorted(((str(r.doc_id), r.pos, str(r.component.id), r.removed) for r in fuzzy_lines(spark.createDataFrame(rows, DOC + ", component int")).collect()))
    assert [g[:3] for g in got] == [("3", 0, "None"), ("3", 0, "None"), ("4", 0, "4"), ("5", 0, "4"), ("None", 0, "None")] or [g[:3] for g in got] == [("3", 0, "3"), ("3", 0, "3"), ("4", 0, "4"), ("5", 0, "4"), ("None", 0, "3")]


def test_hash_of_text_is_sha256_of_kept_bytes(spark):
    r = remove_repeats(spark.createDataFrame([(1, "é b")], DOC)).selectExpr("sha2(kept, 256) as h").first()
    assert r.h == hashlib.sha256("é b".encode()).hexdigest()


def test_band_of_diagonals_tells_what_is_beyond():
    """Many pairs at once, bands of one to six words, all classes and pairs at the very limit: as the edit distance says."""
    from pulselake.llm.lines import _classes, _code_points, beyond

    rnd = random.Random(12)
    for n in (3, 64, 200, 330, 700, 1700):
        x, y = [], []
        for _ in range(40):
            a = [rnd.choice("abc é0") for _ in range(n)]
            b = list(a)
            for _ in range(rnd.randrange(max(2, n // 3))):
                i = rnd.randrange(len(b) + 1)
                b[i : i + rnd.randrange(3)] = rnd.choice(["", "a", "bc", "ééé"])
            x.append("".join(min(a, b, key=len))), y.append("".join(max(a, b, key=len)))
        (dx, ox), (dy, oy) = _code_points(x), _code_points(y)
        c, d = _classes(np.concatenate([dx, dy])), np.array([edit_distance(a, b) for a, b in zip(x, y)])
        for most in (np.diff(oy) * 20 // 100, d, np.maximum(0, d - 1)):
            with np.errstate(over="ignore"):
                assert (beyond(c, ox[:-1], np.diff(ox), oy[:-1] + len(dx), np.diff(oy), most) == (d > most)).all()


def test_shared_blocks_equal_brute_force(spark):
    """Keys that two marks have, once for each mark, however often and in however many rows a mark has them."""
    from pulselake.llm.lines import shared_blocks

    rnd = random.Random(5)
    of = {m: sorted({rnd.randrange(900) for _ in range(6)}) for m in range(200)}
    rows = [(m - 100, of[m]) for m in of for _ in range(1 + (m % 7 == 0) * 5)] + [(7_000, []), (7_001, [10**14, 10**14 + 1])]
    got = [(r.mark, r.key) for r in shared_blocks(spark.createDataFrame(rows, "mark long, bands array<long>").repartition(5)).collect()]
    want = {(m - 100, k) for m in of for k in of[m] if sum(k in v for v in of.values()) > 1}
    assert len(got) == len(set(got)) and set(got) == want
    assert shared_blocks(spark.createDataFrame([], "mark long, bands array<long>")).count() == 0


def test_scan_hands_on_wanted_lines_only(spark):
    """Of 4 000 lines the 40 wanted ones come, in normal form; not another one of the same id and position."""
    from pyspark.sql import functions as F

    from pulselake.llm.lines import line_signatures, wanted_lines

    rnd = random.Random(6)
    rows = [(i if i else None, "\n".join(letters(rnd, 6).upper() + "  12!" for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame([*rows, *rows[:20], (5, "\n".join(["quite another line"] * 40))], "doc_id long, text string")
    sig = line_signatures(spark.createDataFrame(rows, docs.schema), "doc_id", "text", 1)
    wanted = sig.where("uid.id % 10 = 5 and uid.pos < 4 or uid.id is null and uid.pos = 39").select((F.coalesce("uid.id", F.lit(0)) * 100 + F.col("uid.pos")).alias("node"), "uid", "set_key").cache()
    found = wanted_lines(docs, wanted, "doc_id", "text")
    assert {r.node: r.text for r in found.collect()} == {(i or 0) * 100 + p: normal_form(t.split("\n")[p]) for i, t in rows for p in range(40) if (i and i % 10 == 5 and p < 4) or (i is None and p == 39)}
    assert found.count() == 41
