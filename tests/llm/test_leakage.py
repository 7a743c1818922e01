import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import leakage
from veriloom.llm.textnorm import located, repair, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(1, 3))
def test_automaton_tracks_the_longest_matches(items, text, least):
    a = leakage.Automaton(least=least)
    for w in items:
        a.add(w)
    a.finish()
    holders = {}
    for i, w in enumerate(items):
        for g in a.track(w)[2]:
            holders.setdefault(g, set()).add(i)

    def occurs(run):
        return {i for i, w in enumerate(items) if any(w[p : p + len(run)] == run for p in range(len(w) - len(run) + 1))}

    longest = []
    for e in range(len(text)):
        n = 0
        while n <= e and occurs(text[e - n : e + 1]):
            n += 1
        longest.append(n)
    at, size, number = a.track(text)
    assert list(zip(at, size, strict=True)) == [(e, n) for e, n in enumerate(longest) if n >= least]
    for e, g in zip(at, number, strict=True):
        assert holders[g] == occurs(text[e - least + 1 : e + 1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcdefg"), max_size=60))
def test_candidates_drop_nothing(items, text):
    """Every item that the exact chain accepts in the whole text is found."""
    f = leakage.Finder([(i, " ".join(w)) for i, w in enumerate(items)], leakage.Settings())
    got = {i for _, i, _, _ in f.match([text])}
    for i, w in enumerate(items):
        covered, inside, _ = leakage.chained(text, w, f.settings)
        if covered >= f.wanted[i] and inside >= f.inside[i]:
            assert i in got


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_planted_passages(spark):
    rng, voc = random.Random(1), vocabulary(400, 1)
    item = [rng.choice(voc) for _ in range(80)]
    filler = lambda n: [rng.choice(voc) for _ in range(n)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    texts = {
        1: filler(100) + item + filler(100), 2: filler(30) + item[:48] + filler(10), 3: filler(50) + item[:20] + filler(50), 4: filler(300), 5: filler(10) + changed + filler(10),
        6: item[:30] + filler(25) + item[30:60], 7: item[45:] + filler(5) + item[:20], 8: filler(5) + item[:25] + filler(400) + item[25:50],
    }
    docs = [(k, " ".join(t), "x") for k, t in texts.items()] + [(9, None, "x"), (10, "", "x"), (None, " ".join(item), "x"), (11, "\n> ".join(" ".join(item[i : i + 8]).upper() + "," for i in range(0, 80, 8)), "x"), (1, " ".join(texts[1]), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, share string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(k, 1) for k in (1, 2, 5, 6, 11)}


def test_long_text_and_empty_tables(spark):
    voc = vocabulary(5000, 2)
    item = voc[:60]
    text = " ".join(random.Random(3).choices(voc[60:], k=60_000) + item)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.share) for r in leakage.leaks(d, i).collect()] == [(1, 7, 1.0)]
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_words_of_damaged_texts():
    want = ["la", "revision", "precedente", "facil"]
    for t in ("La révision précédente fácil", "LA RÉVISION, précédente: FACIL", "la rÃ©vision prÃ©cÃ©dente fÃ¡cil", "la r&eacute;vision pr&#233;c­édente<br/>f​ácil", "la révi-\nsion précédente fácil"):
        assert words(t) == want, t
    assert repair("Größe ≥ 5 & ok") == "Größe ≥ 5 & ok" and words("ﬁn") == ["fin"] and words("") == []


def changed(item, positions):
    return [f"zz{i}" if i in positions else w for i, w in enumerate(item)]


def test_long_items_with_changed_words():
    for n, at in ((600, {200, 400}), (900, {150, 400, 650, 800}), (1000, {250, 500, 750}), (300, {100, 200}), (5000, set(range(0, 5000, 700)))):
        item = [f"w{i}" for i in range(n)]
        f = leakage.Finder([(1, " ".join(item))], leakage.Settings())
        (_, _, share, _), *_ = f.find([" ".join(["x"] * 50 + changed(item, at) + ["y"] * 900)])
        assert share >= 0.99


def test_every_nth_word_changed_and_short_items():
    item = [f"w{i}" for i in range(100)]
    f = leakage.Finder([(1, " ".join(item)), (2, "one two three four five six seven eight")], leakage.Settings())
    for n in (4, 5, 6):
        (_, _, share, _), *_ = f.find([" ".join(["x"] * 50 + changed(item, set(range(0, 100, n))) + ["y"] * 50)])
        assert share >= 1 - 1.2 / n
    assert [i for _, i, _, _ in f.find(["a one two three other five six seven eight b"])] == [1]
    # A run of 150 words, an inserted sentence, 60 more of an item of 240.
    long = [f"v{i}" for i in range(240)]
    f = leakage.Finder([(1, " ".join(long))], leakage.Settings())
    assert [round(s, 3) for _, _, s, _ in f.find([" ".join(long[:150] + ["x"] * 55 + long[150:210])])] == [0.875]


def test_a_run_shared_by_two_items_counts_for_both():
    a = [f"w{i}" for i in range(120)]
    f = leakage.Finder([(1, " ".join(a)), (2, " ".join(a[30:90]))], leakage.Settings())
    assert {i for _, i, _, _ in f.find([" ".join(a)])} == {0, 1}


def test_stock_phrases_do_not_add_up():
    phrases = [[f"p{k}{x}" for x in range(4)] for k in range(12)]
    item = [w for p in phrases for w in p]
    text = [w for p in phrases[:7] for w in [*p, *(f"o{i}" for i in range(9))]]
    f = leakage.Finder([(1, " ".join(item))], leakage.Settings())
    assert list(f.find([" ".join(text)])) == []


def test_shards_give_the_same_pairs_and_the_planted_recall(spark):
    rng, voc = random.Random(5), vocabulary(600, 5)
    items = [[rng.choice(voc) for _ in range(rng.randint(40, 120))] for _ in range(30)]
    docs, want = [], set()
    for k in range(120):
        i = rng.randrange(30)
        item = items[i]
        n = rng.randint(len(item) * 6 // 10, len(item))
        at = rng.randint(0, len(item) - n)
        part = changed(item[at : at + n], set(rng.sample(range(n), n // 12)))
        docs.append((k, " ".join([rng.choice(voc) for _ in range(80)] + part + [rng.choice(voc) for _ in range(30)])))
        want.add((k, i))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).collect()}
    many = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e, leakage.Settings(shard=4000)).collect()}
    assert one == many == want


def test_removal_keeps_everything_else(spark):
    rng, voc = random.Random(6), vocabulary(500, 6)
    item = [rng.choice(voc) for _ in range(60)]
    before, after = [rng.choice(voc) for _ in range(40)], [rng.choice(voc) for _ in range(40)]
    docs = [(1, " ".join(before + item + after)), (2, "Plain,  text stays.\nAs it is."), (3, None), (4, ""), (5, " ".join(before + item[:32] + after)), (6, " ".join(before + item[:20] + after))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in leakage.without_leaks(d, e).collect()}
    assert got[1].text.split() == before + after and got[1].n_spans == 1
    assert got[5].text.split() == before + after and got[6].text == docs[5][1] and got[6].n_spans == 0
    assert got[2].text == docs[1][1] and got[3].text is None and got[4].text == "" and len(got) == 6
    assert leakage.spans(d.limit(0), e).count() == 0


def test_located_words_are_those_of_the_text():
    for t in ("La révision <b>pré</b> fácil", "une révi-\nsion  faite; (ici)", "a&amp;b  c-d", "", "x\n\ny -\nz"):
        w, where = located(t)
        assert w == words(t) and all(t[a:b].strip() for a, b in where)
