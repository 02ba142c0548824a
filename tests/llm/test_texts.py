"""Packing, leakage and abusive passages."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import leakage as K
from folioforge.llm import packing as P
from folioforge.llm import toxicity as X


def total_cost(patterns):
    return sum(P.cost(p.capacity) * p.times for p in patterns)


@given(st.lists(st.integers(1, 1024), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing(lengths):
    histogram = Counter(lengths)
    patterns = P.plan(histogram)
    assert sum((Counter({n: k * p.times for n, k in Counter(p.lengths).items()}) for p in patterns), Counter()) == histogram
    assert all(p.capacity == min(c for c in P.CAPACITIES if c >= sum(p.lengths)) for p in patterns)
    places, used, capacity = P.Places(patterns), Counter(), {}
    for n, times in histogram.items():
        for k in range(times):
            c, capacity[c] = places.of(n, k)
            used[c] += n
    assert len(used) == sum(p.times for p in patterns) and all(used[c] <= capacity[c] for c in used)


def test_capacities_are_chosen_jointly():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 900) for _ in range(20_000))
    patterns = P.plan(histogram)
    assert {p.capacity for p in patterns} == set(P.CAPACITIES)
    for some in ((1024,), (512, 1024), (768, 1024)):
        assert total_cost(patterns) <= total_cost(P.plan(histogram, some))
    assert total_cost(patterns) < total_cost(P.plan(histogram, (1024,)))
    tokens, room = sum(n * k for n, k in histogram.items()), sum(p.capacity * p.times for p in patterns)
    assert 1 - tokens / room < 0.01 and len(patterns) < 4000


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(0, 1500)) for i in range(600)] + [(5, "word " * 40)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (sorted(map(tuple, P.pack_documents(x).collect()), key=str) for x in (df.repartition(1), df.repartition(7)))
    assert one == two


def test_containers(spark):
    schema = "doc_id bigint, text string, capacity int"
    rows = [(1, "word " * 3000, 0), (2, "", 0), (3, None, 0), (4, "Ein kurzer Text.", 0), (4, "Ein kurzer Text.", 0), (None, "no id", 0)]
    out = P.pack_documents(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    long = sorted((r.piece, r.token_from, r.token_to) for r in out if r.doc_id == 1)
    n = P.count_tokens(["word " * 3000])[0]
    assert long[0] == (0, 0, 1024) and long[-1][2] == n and all(a[2] == b[1] for a, b in zip(long, long[1:]))
    assert [(r.n_tokens, r.container_id) for r in out if r.doc_id in (2, 3)] == [(0, None)] * 2
    assert sum(r.doc_id == 4 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    assert P.pack_documents(spark.createDataFrame([], schema)).count() == 0


WORDS = [a + b for a in "ba ko ri tun mel dor sa vik".split() for b in "lo pen har zu gri nos fa wel".split()]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    return [(i, passage(rng, rng.randint(30, 90))) for i in range(40)]


def damaged(rng, words, edits):
    words = list(words)
    for at in sorted(rng.sample(range(2, len(words) - 2), edits), reverse=True):
        kind = rng.randrange(3)
        words[at : at + 1] = [["xxx"], [], [words[at], "yyy"]][kind]
    return words


def test_leaks_are_found(items):
    rng = random.Random(8)
    scanner = K.Scanner([(i, " ".join(w)) for i, w in items])
    for i, words in items:
        n = rng.randint(24, len(words))
        at = rng.randint(0, len(words) - n)
        quote = damaged(rng, words[at : at + n], n // 8)
        # an edit may cut a short quote's end off: keep the ends
        text = f"Foo. {' '.join(passage(rng, 50))}\n{'  '.join(w.upper() + ',' for w in quote)} — {' '.join(passage(rng, 50))}"
        hits = scanner.find(text)
        assert i in [h[0] for h in hits], (n, at)
        item, start, end, p, q, edits = next(h for h in hits if h[0] == i)
        assert K.fold_word(quote[0], {}) in K.words_of(text[start:end], {})[0][: 1 + n // 2] and edits * 8 <= q - p and q - p >= 24


def test_short_and_strange_texts(items):
    rng = random.Random(9)
    scanner = K.Scanner([(i, " ".join(w)) for i, w in items] + [(99, "too short"), (98, "")])
    for i, words in items:
        around = [f"other{rng.randrange(99)}" for _ in range(60)]
        assert not scanner.find(" ".join(around + words[:20] + around))
        assert i not in [h[0] for h in scanner.find(" ".join(damaged(rng, words[:24], 6)))]
    for text in (None, "", "one", "é" * 100_000):
        assert scanner.find(text) == []
    accents = " ".join(w.replace("a", "á").replace("o", "ö") for w in items[0][1])
    assert [h[0] for h in scanner.find(accents)] == [0]


def test_leak_operator(spark, items, monkeypatch):
    docs = [(k, " ".join(w), "clash") for k, w in items] + [(500, None, "x"), (501, "", "x"), (0, " ".join(items[0][1]), "clash")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x"), (700, None)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in K.leaked(documents, table).collect())
    assert got == sorted([(k, k) for k, _ in items] + [(0, 0)])
    monkeypatch.setattr(K, "MOST_WORDS", 300)
    assert sorted((r.doc_id, r.item_id) for r in K.leaked(documents, table).collect()) == got
    monkeypatch.undo()
    assert K.leaked(documents.limit(0), table).count() == 0 and K.leaked(documents, table.limit(0)).count() == 0


def test_alignment_matches_edit_distance():
    rng = random.Random(3)
    for _ in range(50):
        a, b = [rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(1, 10))]
        steps = K.alignment(a, b)[1:]
        cost = sum(not equal for _, _, equal in steps)

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                row = [i] + row[:0] + _next(row, i, c, y)
            return row[-1]

        def _next(row, i, c, y):
            out, left = [], i
            for j, d in enumerate(y, 1):
                left = min(row[j - 1] + (c != d), row[j] + 1, left + 1)
                out.append(left)
            return out

        assert cost == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


BAD = ["you vile {} i hope you choke on it", "all {} are filthy scum and must be driven out", "shut your mouth you worthless {}"]
GOOD = ["the binder of {} lists the plates in order", "a study of insults in {} was printed early", "the index names {} as engraver and heir", "pages of the copy at {} are wanting"]


def corpus(rng, n, share):
    docs, truth = [], {}
    for i in range(n):
        lines = [rng.choice(GOOD).format(rng.choice(WORDS)) for _ in range(6)]
        if rng.random() < share:
            lines.insert(rng.randrange(6), rng.choice(BAD).format(rng.choice(WORDS)))
            truth[i] = True
        docs.append((i, ". ".join(lines), f"s{i % 3}" if i % 5 else None))
    return docs, truth


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs, truth = corpus(rng, 1500, 0.06)
    labels = [(i, int((i in truth) != (rng.random() < 0.05))) for i in range(0, 1500, 2)] + [(1, None), (3, 1), (3, 0)]
    docs += [(9000, None, "s0"), (9001, "", "s1"), (9002, "word " * 20_000, "s2"), (9003, "SHUT YOUR M0UTH, you w o r t h l e s s pig", "s0")]
    documents = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, source string, score string")
    out = X.score_documents(documents, spark.createDataFrame(labels, "doc_id bigint, label int"))
    rows = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(1, 1500, 2)]
    found = {i for i in held if rows[i].flagged}
    want = {i for i in held if i in truth}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 2
    assert rows[9000].score == rows[9001].score == 0 and not rows[9002].flagged and rows[9003].flagged
    by = {r.source: r.documents for r in X.rates(out).collect()}
    assert sum(by.values()) == len(docs) and None in by


def test_no_labels(spark):
    documents = spark.createDataFrame([(1, "some text", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, label int")
    assert [(r.score, r.flagged) for r in X.score_documents(documents, labels).collect()] == [(0.0, False)]
    assert X.score_documents(documents.limit(0), labels).count() == 0


def test_calibration():
    lam = X.solve_lambda([(-1.0, 900), (1.0, 100)])
    assert abs(0.9 * 2.718281828 ** (-lam) + 0.1 * 2.718281828**lam - 1) < 1e-6
    assert X.chance_rate({}, 0, 1.0) == 1.0 and X.best_cut([(1.0, False)]) == X.math.inf
    assert X.best_cut([(5.0, True), (4.0, True), (1.0, False), (0.0, False)]) == 2.5
    assert X.calibrated(0, 10, 1) == 0 and X.calibrated(50, 10, 1) > X.calibrated(20, 10, 1) > 0


def test_disguises():
    tokens = lambda t: X.token_spans(t)[0]
    assert tokens("w o r t h l e s s pig") == ["worthless", "pig"] and tokens("p1g") == ["pig"] and tokens("s****d 1999") == [X.MASK, X.NUMBER]
    assert tokens("Ünïcode É") == ["unicode", "e"]
    for text in ("w o r t h l e s s pig", "p1g s****d 1999", "Ünïcode É", "", "b.r.a.i.n.l.e.s.s m0r0n"):
        assert X.tokens_of(text, {}) == tokens(text)
