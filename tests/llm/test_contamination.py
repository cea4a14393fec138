import random

import numpy as np

from lipika.llm import contamination as C

DOCS = "doc_id long, text string, item_id long, Text string"
ITEMS = "item_id long, text string, doc_id string"
R = random.Random(4)
SYL = "ka lem tol ri vel su ber qui ono ar est gol fen mor hav".split()
WORD = lambda: "".join(R.choice(SYL) for _ in range(R.randrange(2, 5)))
TEXTS = [" ".join(WORD() for _ in range(30)) + "." for _ in range(40)]


def filler(n=60):
    return " ".join(WORD() for _ in range(n)) + ". "


def misread(t, every):
    w = t.split()
    return " ".join(x[:-1] + "zx" if i % every == every // 2 else x for i, x in enumerate(w))


def test_search_against_brute_force():
    f = C.Finder(TEXTS[:6])
    codes, _ = C.fold_text("\x00".join(filler() + t + filler() for t in TEXTS[3:9]))
    for w in C.WINDOWS:
        s = C.WuManber(f.flat, f.first, f.size, w)
        at, k = s.search(codes)
        windows = {x.codes[i : i + w].tobytes() for x in f.items for i in range(len(x.codes) - w + 1)}
        want = [i for i in range(len(codes) - w + 1) if codes[i : i + w].tobytes() in windows]
        assert sorted(at.tolist()) == want and want
        assert all((codes[a : a + w] == s.flat[s.at[j] : s.at[j] + w]).all() for a, j in zip(at, k))


def cases():
    t = TEXTS
    w = lambda i: t[i].split()
    yes = [
        (0, filler() + t[0] + filler()), (1, t[1].upper().replace(" ", "\n")), (2, filler() + misread(t[2], 6) + filler()),
        (3, filler() + " ".join(w(3)[:18]) + ". " + filler()), (4, t[4].replace("a", "а").replace("e", "​e")),
        (5, " ".join(w(5)[:15]) + " (see p. 12) " + " ".join(w(5)[15:])), (6, "".join(t[6].split())), (7, t[7].replace(" ", ", - ")),
    ]
    no = [(8, " ".join(w(8)[:8]) + " " + filler()), (9, " ".join(R.sample(w(9), len(w(9))))), (10, misread(t[10], 2)), (11, filler(200)), (12, filler() + " ".join(x for p in zip(w(12)[::5], w(13)[::5]) for x in p))]
    return yes, no


def test_leaks(spark):
    yes, no = cases()
    docs = [(k, text, 0, "clash") for k, (_, text) in enumerate(yes + no)] + [(900, None, 0, None), (901, "", 0, None), (903, filler() + "Tokyo 2020" + filler(), 0, None), (904, "the tokyo\n2020", 0, None), (902, filler(20_000) + TEXTS[0], 0, None), (0, yes[0][1], 0, None)]
    items = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, TEXTS[0], "x"), (101, None, "x"), (102, "", "x"), (103, "Tokyo 2020", "x"), (104, "?!", "x")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {tuple(r) for r in C.leaks(d, i).collect()}
    want = {(k, item) for k, (item, _) in enumerate(yes)} | {(0, 100), (902, 0), (902, 100), (903, 103), (904, 103)}
    assert got == want
    C.ITEM_BLOCK, kept = 7, C.ITEM_BLOCK
    try:
        assert {tuple(r) for r in C.leaks(d, i).collect()} == want
    finally:
        C.ITEM_BLOCK = kept
    assert C.leaks(d.limit(0), i).count() == 0 and C.leaks(d, i.limit(0)).count() == 0


def test_fold():
    f = lambda t: "".join(map(chr, C.fold_text(t)[0]))
    assert f("ＯＣＲ, १२-३") == f("ocr 123") and f("औ") == f("अौ") and f("a​b") == "ab" and f("अा") == f("आ") and f("é") == f("é")
    codes, origin = C.fold_text("कa, b")
    assert len(codes) == len(origin) and np.all(np.diff(origin) >= 0)


def test_copies_and_writings_of_one_item(spark):
    """Four writings of one text and four near copies of another share their windows, and are all found."""
    t, near = TEXTS[20], TEXTS[21]
    writings = [t, t.upper(), t.replace(" ", ", "), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t)]
    copies = [near, near + " Note.", "First: " + near, near.replace(".", " again.")]
    items = [(i, x, "x") for i, x in enumerate(writings + copies)]
    docs = [(0, filler() + t + filler(), 0, ""), (1, near, 0, ""), (2, filler(200), 0, "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = {(0, k) for k in range(4)} | {(1, k) for k in range(4, 8)}
    assert {tuple(r) for r in C.leaks(d, i).collect()} == want
    C.HITS, kept = 1, C.HITS
    try:
        assert {(d, k) for d, k, _ in C.Finder([x for _, x, _ in items], C.PART).batch([x[1] for x in docs])} == want
    finally:
        C.HITS = kept


def test_many_near_copies(spark):
    """Items that share a body and differ in their tails are all found, whatever their number and block."""
    body = TEXTS[22]
    for n in (4, 5, 50):
        items = [(k, body[:-1] + " " + " ".join(WORD() for _ in range(6)) + ".", "x") for k in range(n)]
        docs = [(1, filler() + body + filler(), 0, ""), (2, filler(100), 0, ""), (3, body, 0, "")]
        d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
        want = {(doc, k) for doc in (1, 3) for k in range(n)}
        assert {tuple(r) for r in C.leaks(d, i).collect()} == want
        if n == 5:
            C.ITEM_BLOCK, kept = 2, C.ITEM_BLOCK
            try:
                assert {tuple(r) for r in C.leaks(d, i).collect()} == want
            finally:
                C.ITEM_BLOCK = kept


def test_short_items():
    """Items of any length are found, whole and half, and not by less than half."""
    items = ["Ab", "red fox", "a tall red fox", "one two six ten one", "Tokyo 2020", "in it we do as he is at an ox, so be it", "संख्या ९", "x"]
    finder = C.Finder(items, C.PART)
    for k, t in enumerate(items):
        docs = [filler(5) + " 77 " + t.upper() + " 88 " + filler(5), "".join(chr(0x4E00 + j) for j in range(50))]
        assert (0, k) in {(d, j) for d, j, _ in finder.batch(docs)} and not any(d == 1 for d, _, _ in finder.batch(docs))
    got = {(d, j) for d, j, _ in C.Finder(items[:-1], C.PART).batch(["七 one two six 七", "七 one two 七", "七 in it we do as he is at zz ox, so 七", "七 in it we do 七"])}
    assert got == {(0, 3), (2, 5)}


def test_windows_are_kept_by_every_leak():
    """Half of an item with as many misread words as are allowed keeps the windows that must be found."""
    r = random.Random(8)
    for size in (2, 3, 4, 6, 9):
        for n in (3, 8, 14, 20, 40, 120):
            words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(size)) for _ in range(n)]
            item = " ".join(words)
            part = words[: -(-n // 2)]
            bad = -(-len(part) // 5) - 1
            for k in range(bad):
                at = (k + 1) * len(part) // (bad + 1)
                part[at] = part[at][:-1] + "z"
            assert [k for _, k, _ in C.Finder([item], 0.4).batch(["zz " + " ".join(part) + " zz"])] == [0], (size, n)


def test_every_stretch_is_judged():
    """A phrase repeated a hundred times hides no misread copy, and a longer stretch that is too foreign no shorter one."""
    t = TEXTS[30].split()
    sheet = " ".join(t[:2]) + ". "
    decoy = " ".join("zz" if k % 3 == 1 else w for k, w in enumerate(t))
    docs = [filler() + misread(TEXTS[30], 6) + filler() + "".join(sheet + filler(3) for _ in range(100)), decoy + filler(80) + " ".join(t[:18]), decoy, "".join(sheet + filler(3) for _ in range(100))]
    assert [d for d, _, _ in C.Finder([TEXTS[30]], C.PART).batch(docs)] == [0, 1]


def test_predecessors_are_not_counted_off():
    """Eighty segments between two of one chain, as in a list sheet, don't break it."""
    item = C.Item(" ".join(WORD() for _ in range(30)))
    n = len(item.codes)
    half = n // 2
    far = [[half - 3, half + 3, 50_000 + 1_000 * k] for k in range(80)]
    segs = np.array([[0, half, 100], *far, [half, n, 100 + half]])
    assert C.carried(item, segs)[0] == 1.0
