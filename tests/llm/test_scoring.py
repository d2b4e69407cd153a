"""Quality, toxicity, mixing, sharding, decontamination, HTML and the pipeline."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm.boost import fit_trees
from pulselake.llm.decontam import find_leaks, greedy_tiles
from pulselake.llm.html import Page, decode, extract, extract_pages, features, main_text, trained, training_pages
from pulselake.llm.mixing import apply_rates, fit_domains, fit_rates, label_domain, mix, posteriors
from pulselake.llm.quality import clean_lines, line_fault, profile
from pulselake.llm.sharding import RemainingTree, best_fit_runs, pack
from pulselake.llm.toxicity import ToxicityModel, drop_toxic, fit_toxicity, folded, hits_of, score_toxicity

DOC = "doc_id long, text string"


def test_quality_counts():
    p = profile("a b c a b c\nx\nx\n \n")
    assert (p["n_words"], p["word_chars"], p["n_dup_lines"], p["n_repeat_words"]) == (8, 8, 1, 6)
    assert p["base_failed"] and not p["kept"]
    good = "\n".join(f"Sentence number {i} tells that {i * 7} things went {i + 3} ways today." for i in range(12))
    assert profile(good)["kept"] and profile(good)["clean_text"] == good
    nav = good + "\n" + "\n".join(" | ".join(f"item{i}{j}" for j in range(30)) for i in range(8))
    assert not profile(nav)["base_failed"] and not profile(nav)["kept"]
    assert profile(None)["n_words"] == 0 and profile("#*$%&|<>")["n_symbols"] == 8
    assert profile("a\x1cb\x85c")["n_words"] == 1


def test_line_rules_judge_whole_words_and_every_end():
    fault = lambda x: line_fault(x)
    assert fault("The catalog in the drawer was red.") is None and fault("She put the log in the fire.") is None and fault("They reread more of it than he did.") is None
    assert [fault(x) for x in ("Log in", "Lire la suite.", "Alle Rechte vorbehalten.", "© 2020 Tous droits réservés.", "Política de privacidad.")] == ["menu", "menu", "boilerplate", "boilerplate", "boilerplate"]
    assert fault("A long line of many words that goes on and on and then has no end mark") == "punctuation" and fault("Home | News | Sport | Wetter |") == "navigation"
    assert fault("Unesous licence ici.") is None and fault("He said: “yes”") is None and fault("{ } { } x") == "symbols"


def test_quality_odd_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 60000, 3)], DOC + ", kept int")
    got = clean_lines(df).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [0, 0, 0, 60000] and not any(r.kept for r in got)
    assert clean_lines(df.limit(0)).count() == 0


def test_folding_and_exceptions():
    assert folded("  1D10T, Ídіот!") == " idiot idiot " and folded(None) == " " and folded("") == " "
    m = ToxicityModel({" idiot ": 2.0, " scum": 3.0}, (" idiot proof ",))
    got = hits_of(folded("idiot proof scumbag idiot"), m.matcher())
    assert [(p, w) for _, p, w in got] == [(" scum", 3.0), (" idiot ", 2.0)]


def toxic_corpus(n=300):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rnd.choice('abcdefg')}{rnd.choice('hijklm')}r" for _ in range(rnd.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blorfish", "b1orfing", "zugnak"]))
        elif i % 4 == 1:
            words.insert(0, "zugnak tower")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_learns_stems_words_and_exceptions(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame([(*x, "toxic") for x in docs] + [(None, None, ""), (5000, "", ""), (5000, "", "")], DOC + ", score string")
    y = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(d, y)
    rows = score_toxicity(d, model).collect()
    assert len(rows) == len(docs) + 3
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.score < 0.5 for r in rows if r.doc_id in (None, 5000))
    left = drop_toxic(d, model)
    assert left.columns == d.columns and left.count() == sum(r.score < 0.5 for r in rows)
    nothing = fit_toxicity(d, y.where("toxic = 0"))
    assert {r.score < 0.5 for r in score_toxicity(d, nothing).collect()} == {True}
    assert score_toxicity(d.limit(0), model).count() == 0


def test_toxicity_model_does_not_hang_on_partitions(spark):
    docs, labels = toxic_corpus(200)
    d = spark.createDataFrame(docs + docs[:90] + [(1, "zugnak of another text")], DOC)
    y = spark.createDataFrame(labels + labels[:20], "doc_id long, quality int, toxic int")
    models = [fit_toxicity(d.repartition(n), y.repartition(3)) for n in (1, 4, 16)]
    assert models[0] == models[1] == models[2] and models[0].weights and models[0].slope > 0
    bounded = [fit_toxicity(d.repartition(n), y, most=60) for n in (2, 5)]
    assert bounded[0] == bounded[1]


def test_spared_stretches_equal_a_plain_test():
    rnd = random.Random(3)
    m = ToxicityModel({" ab ": 1.0, " b": 0.5, " cab": 2.0}, (" ab b ", " b ab ", " a cab ", " cab cab "))
    for _ in range(300):
        s = " " + " ".join(rnd.choice(["a", "b", "ab", "cab", "cabs"]) for _ in range(rnd.randint(1, 14))) + " "
        spared = [(i, i + len(p) - 1) for p in m.exceptions for i in range(len(s)) if s.startswith(p, i)]
        want = [(i, *max(((p, w) for p, w in m.weights.items() if s.startswith(p, i)), key=lambda x: x[1])) for i in range(len(s)) if any(s.startswith(p, i) for p in m.weights) and not any(a <= i < b for a, b in spared)]
        assert hits_of(s, m.matcher()) == want


def test_projected_gradient_meets_targets_with_nonnegative_rates(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(1, 500), [p := rnd.random(), 1 - p]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    total = [sum(t * p[k] for _, t, p in rows) for k in (0, 1)]
    targets = [1.5 * total[0], 0.4 * total[1]]
    rate, info = fit_rates(df, targets)
    got = df.withColumn("rate", rate).collect()
    assert min(r.rate for r in got) >= 0
    assert np.allclose([sum(r.rate * r.tokens * r.posterior[k] for r in got) for k in (0, 1)], targets, rtol=1e-3)
    w = np.ones(len(rows))
    a = np.array([[t * p[0], t * p[1]] for _, t, p in rows]) / max(t for _, t, _ in rows)
    t = np.array(targets) / max(x[1] for x in rows)
    g = a.T @ a + np.eye(2) * 1e-9 * ((a[:, 0] ** 2).sum() + 1)
    for _ in range(info["rounds"]):
        w = np.maximum(0, w - a @ np.linalg.solve(g, a.T @ w - t))
    by_id = {r.doc_id: r.rate for r in got}
    assert np.allclose(w, [by_id[i] for i in range(len(rows))], atol=1e-6)


def test_posteriors_equal_naive_bayes_by_hand(spark):
    """Likelihoods, priors and damping counted in plain Python for every document and domain."""
    docs, labels = toxic_corpus(160)
    d = spark.createDataFrame(docs, DOC)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_domains(d, y, label_domain())
    names = model[0]
    got = {r.doc_id: r.posterior for r in posteriors(d, model).collect()}
    label = {i: f"quality1_toxic{t}" for i, _, t in labels}
    bags = {i: set(re.split(r"[\x20\x09-\x0D]+", t.lower())) for i, t in docs}
    n = Counter(label.values())
    assert names == sorted(n)
    seen = Counter((label[i], w) for i, b in bags.items() for w in b)
    total = Counter(w for b in bags.values() for w in b)
    vocabulary = [w for w, c in total.items() if c >= 5]
    assert len(vocabulary) <= 2000
    ll = {w: [math.log((seen[m, w] + 5 * total[w] / len(docs)) / (n[m] + 5)) for m in names] for w in vocabulary}
    for i, b in bags.items():
        s = [0.5 * sum(ll[w][k] - sum(ll[w]) / len(names) for w in b if w in ll) + math.log(n[m] / len(docs)) for k, m in enumerate(names)]
        e = [math.exp(x - max(s)) for x in s]
        assert np.allclose(got[i], [x / sum(e) for x in e], atol=1e-9)


def test_scores_equal_a_plain_count_of_matches(spark):
    docs, labels = toxic_corpus(120)
    d = spark.createDataFrame(docs, DOC)
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in score_toxicity(d, model).collect()}
    for i, t in docs:
        s = folded(t)
        spared = [(k, k + len(p) - 1) for p in model.exceptions for k in range(len(s)) if s.startswith(p, k)]
        best = {}
        for p, w in model.weights.items():
            for k in range(len(s)):
                if s.startswith(p, k) and not any(a <= k < b for a, b in spared):
                    best[k] = max(best.get(k, 0), w)
        x = 100 * sum(best.values()) / (s.count(" ") - 1 + model.smooth_words)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, model.slope * x + model.offset))))) < 1e-9


def test_mixing_is_native_and_survives_odd_tables(spark):
    docs, labels = toxic_corpus(200)
    d = spark.createDataFrame(docs + [(None, None), (900, ""), (900, "")], DOC)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mix(d, y, label_domain(), {"quality1_toxic0": 0.7, "quality1_toxic1": 0.3})
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 203 and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
    share = sum(r.rate * r.tokens * r.posterior[1] for r in rows) / sum(r.tokens for r in rows)
    assert abs(share - 0.3) < 0.01
    assert [r.rate for r in rows if not r.tokens] == [1.0] * 3
    copies = apply_rates(d, out).groupBy("doc_id").count().collect()
    times = {r.doc_id: r.repeats for r in rows}
    assert all(c["count"] == times[c.doc_id] * (2 if c.doc_id == 900 else 1) for c in copies)
    assert mix(d.limit(0), y, label_domain()).count() == 0
    assert {r.rate for r in mix(d, y.limit(0), label_domain()).collect()} == {1.0}


def test_rates_apply_to_rows_that_share_an_id(spark):
    rows = [(None, "one text"), (None, "another"), (None, None), (4, "x"), (4, "y")]
    d = spark.createDataFrame(rows, DOC)
    out = mix(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), label_domain())
    out = out.withColumn("repeats", F.when(F.col("tokens") == 1, F.lit(3)).when(F.col("tokens") == 2, F.lit(0)).otherwise(F.lit(1)))
    got = {(r.doc_id, r.text): r["count"] for r in apply_rates(d, out).groupBy("doc_id", "text").count().collect()}
    assert got == {(None, "another"): 3, (None, None): 1, (4, "x"): 3, (4, "y"): 3}


def naive_best_fit(sizes, capacities):
    left, out = list(capacities), []
    for s in sizes:
        fits = [(c, i) for i, c in enumerate(left) if c >= s]
        c, i = min(fits) if fits else max((c, i) for i, c in enumerate(left))
        left[i] -= s
        out.append(i)
    return out, left


def test_runs_of_alike_groups_equal_one_by_one_best_fit():
    rnd = random.Random(3)
    for _ in range(40):
        sizes = sorted((rnd.choice([1, 2, 3, 5, 8, 40, 90]) for _ in range(rnd.randint(1, 60))), reverse=True)
        capacities = [-(-sum(sizes) // 4)] * 4
        lines = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        got = [i + k // each for _, a, b, each, i in best_fit_runs(lines, capacities[0], 4) for k in range(b - a + 1)]
        assert got == naive_best_fit(sizes, capacities)[0]
        left, want = [], []
        for s in sizes:  # bins are opened on demand
            fits = [(c, i) for i, c in enumerate(left) if c >= s]
            c, i = min(fits) if fits else (50, len(left))
            if not fits:
                left.append(50)
            left[i] -= s
            want.append(i)
        assert [i + k // each for _, a, b, each, i in best_fit_runs(lines, 50, None) for k in range(b - a + 1)] == want


def test_tree_gives_tightest_bin_and_stays_balanced():
    t = RemainingTree([10, 4, 7])
    assert t.tightest(5) == (7, 2) and t.tightest(4) == (4, 1) and t.tightest(99) is None and t.emptiest() == (10, 0)
    t.put(7, 2, 5)
    assert t.tightest(1) == (2, 2)
    rnd, plain = random.Random(5), [1000] * 300
    t = RemainingTree(plain)
    for _ in range(3000):
        s = rnd.randint(1, 60)
        fits = [(c, i) for i, c in enumerate(plain) if c >= s]
        assert t.tightest(s) == (min(fits) if fits else None)
        if fits:
            c, i = min(fits)
            t.put(c, i, s)
            plain[i] -= s
    assert t.root[3] <= 1.45 * np.log2(302) and not RemainingTree().tightest(1)


def test_pack(spark):
    rnd = random.Random(4)
    texts = ["same"] * 30 + ["t" * rnd.randint(0, 300) + str(i) for i in range(170)] + [None, None, "", ""]
    d = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], DOC + ", shard int")
    rows = pack(d, 8).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.text_crc32 is not None
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    groups = {}
    for r in rows:
        groups.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())
    loads = [sum(r.size for r in by.get(s, [])) for s in range(8)]
    assert max(loads) - min(loads) <= 200
    few = pack(d, None, 5000).collect()
    by_shard = {}
    for r in few:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.size
    assert max(by_shard.values()) <= 5000 and len(by_shard) == max(by_shard) + 1 <= -(-sum(by_shard.values()) // 5000) + 1
    assert pack(d.limit(0), 8).count() == 0


def test_tiles_against_plain_greedy():
    def plain(item, text, least):
        mi, mt, out = [0] * len(item), [0] * len(text), []
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not mi[i + n] and not mt[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < least:
                return out
            n, i, j = best
            mi[i : i + n], mt[j : j + n] = [1] * n, [1] * n
            out.append((i, j, n))

    rnd = random.Random(6)
    for _ in range(150):
        item = [rnd.randrange(4) for _ in range(rnd.randint(3, 22))]
        text = [rnd.randrange(4) for _ in range(rnd.randint(3, 40))]
        got, want = greedy_tiles(item, text, 3), plain(item, text, 3)
        assert sum(n for *_, n in got) == sum(n for *_, n in want) or max(n for *_, n in got) == max(n for *_, n in want)
        for i, j, n in got:
            assert item[i : i + n] == text[j : j + n] and n >= 3


@pytest.mark.parametrize("most_bits", [1 << 27, 1 << 8])
def test_leaks_whole_reordered_and_clean(spark, most_bits):
    rnd = random.Random(7)
    items = [" ".join(f"b{rnd.randrange(900)}" for _ in range(40)) for _ in range(8)]
    noise = lambda n: " ".join(f"n{rnd.randrange(900)}" for _ in range(n))
    w = items[1].split()
    moved = " ".join(w[20:] + ["gap"] + w[:20])
    rows = [(0, f"{noise(50)} {items[0].upper()} {noise(9)}"), (1, f"{noise(30)} {moved}"), (2, noise(200)), (3, " ".join(items[2].split()[:12]) + noise(40)), (4, None), (5, ""), (None, items[3]), (None, items[3])]
    d = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", leaks string")
    b = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "too short"), (92, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), [x.item_id for x in r.leaks]) for r in find_leaks(d, b, most_bits=most_bits).collect())
    assert got == [("0", [0]), ("1", [1]), ("2", []), ("3", []), ("4", []), ("5", []), ("None", [3]), ("None", [3])]
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_in_other_case_with_accents(spark):
    rnd = random.Random(8)
    item = " ".join(f"élan{rnd.randrange(90)} straße{rnd.randrange(90)} ñandú{rnd.randrange(90)}" for _ in range(12))
    noise = " ".join(f"n{rnd.randrange(900)}" for _ in range(40))
    split = unicodedata.normalize("NFD", item)
    d = spark.createDataFrame([(0, f"{noise} {item.upper()}"), (1, item.title()), (2, split), (3, noise.upper())], DOC)
    b = spark.createDataFrame([(5, item), (6, "ÉTÉ À LA PLAGE DE NOËL " * 3)], "item_id long, text string")
    got = {r.doc_id: [(x.item_id, x.coverage) for x in r.leaks] for r in find_leaks(d, b).collect()}
    assert got == {0: [(5, 1.0)], 1: [(5, 1.0)], 2: [(5, 1.0)], 3: []}


def test_leaks_of_named_items_in_odd_tables(spark):
    """Item ids of any type, repeated ids and rows, clashing names, a very long text, against tiles of every pair."""
    rnd = random.Random(9)
    word = lambda: f"q{rnd.randrange(60)}"
    items = [("a", " ".join(word() for _ in range(12))), ("b", " ".join(word() for _ in range(9))), ("b", " ".join(word() for _ in range(30)))]
    items.append(("c", items[0][1] + " " + items[1][1]))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    texts += [items[2][1], items[3][1] + " tail", items[1][1] + " z " + items[0][1], " ".join(word() for _ in range(30_000)) + " " + items[0][1], items[0][1]]
    rows = [(None if i % 7 == 0 else 1, t, "x", "y") for i, t in enumerate(texts + texts[-5:])]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string, key string")
    got = sorted((r.text, tuple((x.item_id, x.covered, x.words) for x in r.leaks)) for r in find_leaks(d, spark.createDataFrame(items * 2, "item_id string, text string"), least=3, share=0.5).collect())
    want = []
    for _, t, *_ in rows:
        all_tiles = [(i, sum(x[2] for x in greedy_tiles([hash(w) for w in q.split()], [hash(w) for w in t.split()], 3)), len(q.split())) for i, q in items]
        want.append((t, tuple(sorted(x for x in all_tiles if x[1] >= 0.5 * x[2]))))
    assert [(t, tuple(i for i, *_ in x)) for t, x in got] == [(t, tuple(i for i, *_ in x)) for t, x in sorted(want)]


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = fit_trees(x[:1000], y[:1000], n_trees=40, depth=3)
    assert (((t.log_odds(x[1000:]) > 0) == y[1000:]).mean()) > 0.95


def test_extraction_on_held_out_pages():
    trees, right, n = trained(), 0, 0
    for page, truth in training_pages(80, 4242):
        got = main_text(page, decode(page, trees.log_odds(features(page))))
        right += got == main_text(page, truth)
        n += 1
    assert right >= 0.9 * n


def test_extraction_without_telling_names():
    """Classes and ids are invented words: what is left are elements, depth, density and siblings. Most words still come out right."""
    trees, shares = trained(), []
    for page, truth in training_pages(60, 4243, named=0.0):
        got, want = Counter(main_text(page, decode(page, trees.log_odds(features(page)))).split()), Counter(main_text(page, truth).split())
        shares.append(2 * sum((got & want).values()) / max(1, got.total() + want.total()))
    print("share of words", np.mean(shares))
    assert np.mean(shares) >= 0.75


def test_extraction_rules():
    trees = trained()
    html = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p>First   paragraph&nbsp;here,\n with <b>bold</b>ness, and <a href=x>a link</a>.<br>Next line of it.
    <p>Second paragraph of the long article, with some words more.<div class="comments"><div class="comment"><p>I am a reader.</p></div></div></article><footer>&copy; someone</footer></body></html>"""
    assert extract(html, trees) == "Head & line First paragraph here, with boldness, and a link. Next line of it. Second paragraph of the long article, with some words more."
    assert extract(None, trees) == "" and extract("", trees) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert isinstance(extract(deep, trees), str)


def test_decoding_drops_what_hangs_on_a_dropped_node():
    page = Page("<body><div class=a><p>one</p></div><p>two</p></body>")
    odds = np.array([0.0, 5.0, -5.0, 0.5, 5.0])
    inside = decode(page, odds)
    assert inside[page.tag.index("div")] is False or not inside[page.tag.index("div")]
    assert main_text(page, inside) == "two"


def test_extract_pages_keeps_rows_that_repeat_and_long_ones(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>" + "Some words stand here, and more follow. " * 4000 + "</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, page, 2), (3, "v", "", 3)], "page_id long, url string, html string, n_chars int")
    rows = extract_pages(df).collect()
    assert len(rows) == 4 and len({r.text for r in rows if r.page_id != 3}) == 1 and next(r.text for r in rows if r.page_id == 3) == ""
    assert next(r.text for r in rows if r.page_id == 1).count("Some words") == 4000


def test_extract_pages_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (None, None, "<p>Some words stand here.</p>", "old")], "page_id long, url string, html string, text string")
    rows = extract_pages(df).collect()
    assert {r.page_id: r.text for r in rows} == {1: "", None: "Some words stand here."}
    assert extract_pages(df.limit(0)).count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables; null and repeated ids and rows, null texts and clashing names at every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(12)
    long = lambda n: " ".join(f"v{rnd.randrange(9000)}" for _ in range(n)) + "."
    a, b, c = (long(80) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, c, "x"), (None, a, "x"), (7, None, None), (7, None, None), (8, "", "")]
    schema = "doc_id long, text string, tokens string, shard string"
    docs = spark.createDataFrame([(*r, "s") for r in rows], schema)
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, at).collect()
        if name == "near_dedup":
            assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(x) for x in [(1, a), (2, b), (None, c), (7, None), (7, None), (8, "")]), name
        else:
            assert len(got) == len(rows), name
        if name != "sharding":
            assert got[0].__fields__ == docs.columns, name
        assert stage(spark, docs.limit(0), at).count() == 0, name


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(11)
    text = lambda n: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n)) + "."
    bench = [text(40) for _ in range(5)]
    docs = [(i, text(90), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail", "en", "s", 0) for i in range(5)] + [(200, f"{text(20)} {bench[0]}", "en", "s", 0)]
    docs += [(300 + i, text(40) + " zugnak zugnak zugnak " + text(10), "en", "s", 0) for i in range(30)] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    labels = [(d[0], 1, int(300 <= d[0] < 400)) for d in docs]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs_df, kept = spark.read.parquet(f"{at}/documents.parquet"), None
    columns = docs_df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_df = stage(spark, docs_df, at)
        assert docs_df.columns == columns, name
        docs_df.write.parquet(f"{at}/{name}")
        docs_df = spark.read.parquet(f"{at}/{name}")
        ids = {r.doc_id for r in docs_df.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {d[0] for d in docs if not 300 <= d[0] < 400}
        if name == "near_dedup":
            assert not ids & set(range(100, 105)) and set(range(60)) <= ids
        if name == "decontaminate":
            assert 200 not in ids and set(range(60)) <= ids
        kept = ids
    out = corpus_pipeline.sharding(spark, docs_df, at)
    assert {r.doc_id for r in out.collect()} == kept and out.where(F.col("shard").isNull()).count() == 0
