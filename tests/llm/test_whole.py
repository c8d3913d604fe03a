"""Operators against plain computations over all that their definitions name, nothing left out beforehand."""

import random
from collections import Counter
from itertools import permutations

import brute
from test_llm import DOCS

from pagestrata.llm import decontamination, language_id, near_dedup


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def best_window(text, item, k=5):
    """The best similarity of an item and any window of its length, or the whole of a shorter text."""
    w, own = text.lower().split(), item.lower().split()
    k = min(k, len(own))
    b, best = grams(own, k), 0.0
    for start in range(max(1, len(w) - len(own) + 1)):
        a = grams(w[start : start + len(own)], k)
        both = sum((a & b).values())
        if both:
            best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def fresh(draw, n):
    return [f"w{draw.randint(0, 10**9)}" for _ in range(n)]


def held_against_windows(spark, items, texts, least=0.8):
    """Every text with a best window of ``least`` or below 0.8 has the similarity and items that all windows give."""
    found = decontamination.mark(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got, checked = {r.doc_id: r for r in found.collect()}, 0
    for i, text in enumerate(texts):
        best = {j: s for j, item in enumerate(items) if (s := best_window(text, item)) > 0}
        hits = {j: s for j, s in best.items() if s >= 0.8}
        if hits and min(hits.values()) < least:
            continue
        checked += bool(hits)
        assert got[i].items == ",".join(map(str, sorted(hits))) and abs(got[i].similarity - max(hits.values(), default=0.0)) < 1e-9, (i, best, got[i])
    return checked


def test_decontamination_at_edges_and_in_short_documents(spark):
    draw, items, texts = random.Random(5), [], []
    for n in (16, 25, 40, 59, 100):
        item = fresh(draw, n)
        items.append(" ".join(item))
        more = fresh(draw, 30)
        cut = [item[1:], item[:-1], item[2:], item[:-2], item[1:-1], item[: n // 2] + item[n // 2 + 1 :], item[: n // 2] + item[n // 2 + 2 :]]
        for w in (item, *cut):
            texts += [" ".join(x) for x in (w, w + more, more + w, more + w + more)]
    # All of the item but two words before and three after, with five words put into its middle: the best window puts no shingle where the item has it.
    item = fresh(draw, 110)
    items.append(" ".join(item))
    texts.append(" ".join([*fresh(draw, 20), *item[2:55], *fresh(draw, 5), *item[55:-3], *fresh(draw, 20)]))
    assert held_against_windows(spark, items, texts, 0.9) > 60


def test_near_dedup_links_through_partners_of_the_pivot(spark):
    # P, y with one shingle of P replaced, x with eight more of y: y links with both, x not with P. Ids in all orders.
    rows, at = [], 0
    for seed in range(12):
        draw = random.Random(seed)
        p = fresh(draw, 104)
        y = [*p[:-1], *fresh(draw, 1)]
        x = [*fresh(draw, 8), *y[8:]]
        far = [[*fresh(draw, 1), *p[1:]] for _ in range(2)]
        for ids in permutations(range(3)):
            # A prefix to every word keeps the chains apart.
            own = [*zip(ids, (p, y, x), strict=True), *((3 + i, f) for i, f in enumerate(far))]
            rows += [(100 * at + i, " ".join(f"c{at}{w}" for w in words), "en", "a", 1) for i, words in own]
            at += 1
    got = {r.doc: (r.n, r.component) for r in near_dedup.link(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.groups({r[0]: r[1] for r in rows})


def chains(seeds, step):
    """Windows of 200 shingles, each ``step`` words on from the one before, with ids in any order: no shingle is in half of a chain."""
    rows = []
    for at, seed in enumerate(seeds):
        draw = random.Random(seed)
        words, ids = fresh(draw, 204 + step * 40), list(range(40))
        draw.shuffle(ids)
        rows += [(100 * at + i, " ".join(words[step * k : step * k + 204]), "en", "a", 1) for k, i in enumerate(ids)]
    return rows


def test_near_dedup_chains_without_a_common_shingle(spark):
    rows = chains((6, 10, 13), 14)  # 186 of 214 shingles in common: 0.869
    got = {r.doc: (r.n, r.component) for r in near_dedup.link(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.groups({r[0]: r[1] for r in rows}) and {c for _, c in got.values()} == {0, 100, 200}


def test_pipeline_near_dedup_chains_without_a_common_shingle(spark):
    rows = chains((13, 19), 20)  # 180 of 220: 0.818
    assert sorted(r.doc_id for r in near_dedup.keep_first(spark, spark.createDataFrame(rows, DOCS), "").collect()) == [0, 100]


def test_near_dedup_second_round_with_a_part_of_any_name(spark):
    # P = 5, y with one shingle of P replaced, x with eight more of y, z with eight more of x: x and z are a part that isn't linked with P.
    p = list(range(100))
    y = [1000, *p[1:]]
    x = [*y[:92], *range(2000, 2008)]
    z = [*range(3000, 3008), *x[8:]]
    own = {5: p, 6: y, 7: x, **{20 + i: [*p[: 30 + i], 4000 + i, *p[31 + i :]] for i in range(8)}}
    for name in (-1, 2):
        sets = own | {name: z}
        parts = {**dict.fromkeys(own, 5), 7: name, name: name}
        left = spark.createDataFrame([(min(name, 5), len(sets), i, 100, parts[i], g) for i, g in sets.items()], "soup long, members long, rep long, n long, component long, grams array<long>")
        found = near_dedup._second_round(spark, left, spark.createDataFrame(list(sets.items()), "doc long, grams array<long>"), 85).collect()
        assert (6, 7) in {(r.u, r.v) for r in found}


def test_decontamination_near_the_threshold(spark):
    draw, items, texts = random.Random(7), [], []
    for n in (46, 50, 55, 59, 59, 60):
        item = fresh(draw, n)
        items.append(" ".join(item))
        for _ in range(25):
            i = draw.randrange(6, n - 8)
            edit = [*item[:i], *fresh(draw, draw.choice((1, 2))), *item[i + draw.choice((1, 2)) :]]
            texts.append(" ".join([*fresh(draw, 10), *edit, *fresh(draw, 10)]))
    item = fresh(draw, 110)
    items.append(" ".join(item))
    texts.append(" ".join([*fresh(draw, 20), *item[2:55], *fresh(draw, 5), *item[55:-3], *fresh(draw, 20)]))
    assert held_against_windows(spark, items, texts) > 60


def test_pipeline_near_dedup_takes_copies_from_80_percent(spark):
    draw, rows = random.Random(11), []
    for g in range(8):
        words = fresh(draw, 104)
        copy = [*fresh(draw, 10), *words[10:]]  # 90 of 110 shingles in common: 0.818
        apart = [*fresh(draw, 13), *words[13:]]  # 87 of 113, 0.770; 87 of 113 with the copy too
        rows += [(10 * g + i, " ".join(w), "en", "a", 1) for i, w in enumerate((words, copy, apart[:13] + fresh(draw, 3) + words[16:]))]
    frame = spark.createDataFrame(rows, DOCS)
    truth = {i for i, (_, c) in brute.groups({r[0]: r[1] for r in rows}, 80).items() if i == c}
    assert len(truth) == 16 and {r.doc_id for r in near_dedup.keep_first(spark, frame, "").collect()} == truth
    assert near_dedup.link(spark, frame).where("doc = component").count() == 24


def test_pipeline_keeps_a_monolingual_corpus(spark):
    rows = [(i, f"plain words of text number {i} in the only language", "en", "a", 1) for i in range(60)]
    odd = [(100, "漢字 仮名 交じり 文章", None, "a", 1), (101, "12 34", None, "a", 1), (102, None, None, "a", 1), (103, "", None, "a", 1)]
    kept = language_id.keep_identified(spark, spark.createDataFrame(rows + odd, DOCS), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))
