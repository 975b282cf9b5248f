import random

import numpy as np

from codeloom.llm import leaks as L

WORDS = [f"w{i}x" for i in range(400)]


def item(rnd, n=50):
    return [rnd.choice(WORDS) for _ in range(n)]


def found(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, q, **k).collect()}


def altered(rnd, words):
    """Every fourth word replaced, dropped or followed by another."""
    out = []
    for i, w in enumerate(words):
        how = rnd.choice("rda") if i % 4 == 3 else "k"
        out += {"k": [w], "r": ["other"], "d": [], "a": [w, "extra"]}[how]
    return out


def test_normal_form():
    want = ["alpha", "srcutilsrecord", "beta", "gamma"]
    for t in ("Alpha src/utils/record, BETA gamma.", "alpha src/util-\ns/record beta gam-\nma", "// alpha\n// src&#47;utils/record\n# *beta* __gamma__", "<p>al​pha src/utils/re\u00adcord beta</p> -- gamma", "alpha\xa0src/utils/record\r\n> beta\r\n> gamma"):
        assert L.words_of(t) == want, t


def test_passages(spark):
    rnd = random.Random(2)
    items = [(i, item(rnd)) for i in range(12)]
    noise = lambda n=80: [f"n{rnd.randrange(900)}" for _ in range(n)]
    docs, want = [], set()
    for k in range(60):
        i, ws = items[k % 12]
        a = rnd.randrange(0, 50 - 24)
        part = ws[a : a + 24] if k % 3 else altered(rnd, ws[a : a + 24])
        docs.append((k, " ".join(noise() + part + noise())))
        want.add((k, i))
    for k in range(100, 130):  # few words in common, and words out of order
        i, ws = items[k % 12]
        docs.append((k, " ".join(noise() + ws[3:9] + noise() + rnd.sample(ws, 9))))
    docs += [(200, None), (201, ""), (202, " ".join(items[0][1])), (203, " ".join(items[0][1]).upper()), (None, " ".join(items[0][1]))]
    want |= {(202, 0), (203, 0)}
    texts = [(i, " ".join(ws)) for i, ws in items] + [(50, None), (51, "too short"), (None, "x " * 40), (0, " ".join(items[0][1]))]
    assert found(spark, docs, texts) == want
    assert found(spark, docs, texts, block=5) == want


def test_frames_are_no_leak(spark):
    rnd = random.Random(4)
    frame = "every {} older than {} scans leaves the tree of {} together with its {} and no other file remains in place after it".split()
    make = lambda: " ".join(w if w != "{}" else f"z{rnd.randrange(10**6)}" for w in frame)
    items = [(i, make()) for i in range(6)]
    assert found(spark, [(i, t) for i, t in items], items) == {(i, i) for i in range(6)}


def test_the_rarest_words_may_be_changed(spark):
    # Common words are in all documents; the four rare ones of the item, which carry most of its weight, are replaced.
    ws = [f"rare{i}" if i % 4 == 3 else f"common{i}" for i in range(16)]
    docs = [(i, " ".join(f"common{k}" for k in range(15, -1, -1))) for i in range(50)]
    leak = (99, " ".join("other" if w.startswith("rare") else w for w in ws))
    assert found(spark, [*docs, leak], [(1, " ".join(ws))]) == {(99, 1)}


def test_shared_passages_are_reported_for_both(spark):
    rnd = random.Random(7)
    shared, own = item(rnd, 20), [item(rnd, 20) for _ in range(3)]
    items = [(i, " ".join(shared + own[i])) for i in range(2)] + [(2, " ".join(own[2]))]
    docs = [(0, " ".join(shared)), (1, " ".join(shared + own[1])), (2, " ".join(own[2]))]
    want = {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}
    got = found(spark, docs, items)
    assert {x for x in got if x[0] != 1} == {x for x in want if x[0] != 1} and (1, 1) in got
    assert found(spark, docs, items, block=1) == got


def test_frames_do_not_depend_on_blocks(spark):
    rnd = random.Random(4)
    frame = "every {} older than {} scans leaves the tree of {} together with its {} and no other file remains in place after it".split()
    items = [(i, " ".join(w if w != "{}" else f"z{rnd.randrange(10**6)}" for w in frame)) for i in range(6)]
    assert found(spark, items, items, block=1) == {(i, i) for i in range(6)}


def test_empty(spark):
    assert found(spark, [], [(1, "a " * 30)]) == set() and found(spark, [(1, "a b c")], []) == set()


def holds(doc, words, window=16):
    """By the definition: some window or more words of the item are a stretch of the document but for one change in four."""
    for a in range(len(words) - window + 1):
        row = [0] * (len(doc) + 1)
        for n, w in enumerate(words[a:], 1):
            new = [n]
            for j, x in enumerate(doc, 1):
                new.append(min(row[j - 1] + (x != w), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= window and min(row) <= n // 4:
                return True
    return False


def test_five_changed_in_the_middle_of_twenty(spark):
    ws = [f"word{i}" for i in range(20)]
    changed = [f"new{i}" if i in (6, 8, 10, 12, 13) else w for i, w in enumerate(ws)]
    assert holds(changed, ws) and not any(sum(a != b for a, b in zip(changed[i : i + 16], ws[i : i + 16])) <= 4 for i in range(5))
    more = [f"new{i}" if i in (5, 6, 8, 10, 12, 13) else w for i, w in enumerate(ws)]
    assert not holds(more, ws)
    assert found(spark, [(1, " ".join(changed)), (2, " ".join(more))], [(7, " ".join(ws))]) == {(1, 7)}


def test_search_is_that_of_the_definition():
    rnd = random.Random(11)
    words = [f"v{i}" for i in range(60)]
    item_words = [[rnd.choice(words) for _ in range(rnd.choice((16, 19, 24, 34)))] for _ in range(8)]
    docs = []
    for k in range(160):
        ws = item_words[k % 8]
        part = list(ws[rnd.randrange(3) :][: rnd.randrange(14, 34)])
        for _ in range(rnd.randrange(0, 9)):
            at = rnd.randrange(len(part))
            how = rnd.choice("rda")
            part[at : at + 1] = {"r": [rnd.choice(words)], "d": [], "a": [part[at], rnd.choice(words)]}[how]
        docs.append([rnd.choice(words) for _ in range(rnd.randrange(6))] + part + [rnd.choice(words) for _ in range(rnd.randrange(6))])
    index = L.Index(list(enumerate(item_words)), {int(h): n for n, h in enumerate(L.hashes(words))})
    flat = L.hashes([w for d in docs for w in d])
    spans = index.spans(flat, np.r_[0, np.cumsum([len(d) for d in docs])])
    got = {(int(d), int(i)) for d, i in spans[:, :2]}
    want = {(d, i) for d, doc in enumerate(docs) for i, ws in enumerate(item_words) if holds(doc, ws)}
    assert got == want and 40 < len(want) < 160
