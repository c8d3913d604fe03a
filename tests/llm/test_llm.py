"""The ten operators and the pipeline against plain computations, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from pagestrata.llm import decontamination, language_id, license_scan, line_dedup, mixing, mtree, near_dedup, packing, personal_data, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "word", None, "b", 4), (5, "é ü 漢字 😀", "fr", None, 8), (None, "no id here at all", "en", "a", 5),
    (6, "the same text twice over", "en", "a", 5), (7, "the same text twice over", "en", "a", 5), (8, "the same text twice over", "de", "b", 5), (8, "the same text twice over", "de", "b", 5),
    (9, "long " * 60_000, "en", "a", 5), (10, "x" * 150_000, "en", "a", 5),
]


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [(*r, 1, "c", [1]) for r in AWKWARD]
    return spark.createDataFrame(extra, DOCS + ", n int, score string, spans array<int>")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def stage_tables(spark, tmp_path, frame, items):
    frame.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    items.write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


# 1


def test_language_accuracy(spark, data, docs):
    found = {r.doc_id: r for r in language_id.op1_language_id(spark, data).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert len(found) == len(truth) and len(held) > 20
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_mixed_spans(spark, docs):
    model = language_id.learn(docs)
    rows = {r.lang: r.text for r in docs.where("length(text) between 2000 and 6000").collect()}
    a, b = rows["en"][:1500], rows["fr"][:1500]
    _, _, spans = language_id.label(model, pa.array([a + "\n" + b]))
    spans = spans.to_pylist()[0]
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "fr" and len(spans) <= 4


def test_viterbi(spark):
    draw = np.random.default_rng(1)
    scores, at = draw.normal(size=(40, 3)) * 4, np.array([0, 7, 7, 40])
    got = language_id.viterbi(scores, at, 3.0)
    for a, b in zip(at, at[1:], strict=False):
        best = lambda path, a=a: sum(scores[a + i, p] for i, p in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        value = {p: scores[a, p] for p in range(3)} if b > a else {}
        for i in range(a + 1, b):
            value = {p: max(value[q] - 3.0 * (p != q) for q in range(3)) + scores[i, p] for p in range(3)}
        if b > a:
            assert abs(best(got[a:b].tolist()) - max(value.values())) < 1e-9


def test_language_awkward(spark, docs, awkward, empty):
    model = language_id.learn(docs)
    found = {r.doc_id: r for r in language_id.identify(spark, awkward, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[5].lang_pred in model.languages
    assert language_id.identify(spark, awkward, language_id.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_identified(spark, empty, "").count() == 0


# 2


def plain_superminhash(hashes, m):
    h = np.array(sorted(hashes), np.uint64)
    return near_dedup.superminhash(h, np.zeros(len(h), np.int64), 1, m)[0]


def test_superminhash_estimates_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for share in (0.3, 0.6, 0.9):
        a = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = a.copy()
        k = int(200 * (1 - share) / (1 + share))
        b[:k] = draw.integers(0, 1 << 63, k, dtype=np.uint64)
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        errors.append(abs((plain_superminhash(a, 156) == plain_superminhash(b, 156)).mean() - true))
    assert max(errors) < 0.12
    # Every element's ranks are a permutation: one element alone fills all components with different steps.
    one = plain_superminhash([5], 20) >> np.uint64(56)
    assert sorted(one.tolist()) == list(range(20))


def edited(seed, groups=6, copies=25, length=120):
    draw, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(draw.randint(0, 7)):
                i = draw.randrange(len(w))
                kind = draw.random()
                if kind < 0.6:
                    w[i] = f"e{draw.random()}"
                elif kind < 0.8 and len(w) > 10:
                    del w[i]
                else:
                    w.insert(i, f"n{draw.random()}")
            out.append((1000 * g + len(out), " ".join(w), "en", "a", 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_groups(spark, seed):
    rows = edited(seed)
    nameless = [(None, r[1] + " more", None, None, None) for r in rows[::9]]
    got = {r.doc: (r.n, r.component) for r in near_dedup.link(spark, spark.createDataFrame(rows + nameless, DOCS)).collect() if r.doc is not None}
    assert got == brute.groups({r[0]: r[1] for r in rows})


def test_near_dedup_on_data(spark, data, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op2_near_dedup(spark, data).collect()}
    assert got == brute.groups({r.doc_id: r.text for r in docs.collect()})


def test_near_dedup_awkward(spark, awkward, empty):
    rows = near_dedup.link(spark, awkward).collect()
    got = {r.doc: (r.n, r.component) for r in rows}
    assert len(rows) == len(AWKWARD) and got[1] == (0, 1) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[6] == got[7] == got[8] == (1, 6) and got[9] == (1, 9) and got[10] == (1, 10)
    kept = near_dedup.keep_first(spark, awkward, "")
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10]
    assert near_dedup.link(spark, empty).count() == 0


# 3


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(text))
    hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base(spark, data, docs):
    extra = [(10**6, "Under  the MIT\nLicense; under the mit license CC-BY-NC cc by nc", None, None, None), *AWKWARD]
    rows = docs.unionByName(spark.createDataFrame(extra, DOCS))
    truth = Counter((r.doc_id, *plain_base(r.text)) for r in rows.collect())
    got = license_scan.scan_licenses(rows).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == truth
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def slow_spans(line):
    """Every place where a notice fits within its edits, by the rule alone; of places that overlap, those with the fewest edits."""
    found = set()
    for notice, label, edits, rule in license_scan._compiled(tuple(license_scan.NOTICES.items()))[1]:
        for at in range(len(line)):
            if line[at] == " " and (m := rule.match(line, at + 1)):
                found.add((m.start(), m.end(), label, sum(m.fuzzy_counts)))
    return sorted(s for s in found if not any(o[3] < s[3] and o[0] < s[1] and s[0] < o[1] for o in found))


def test_license_fuzzy_against_all_places():
    draw = random.Random(6)
    words = "under the mit apache license version 2 cc by nc sa 4 0 gnu public licensed released mozilla all rights reserved plain notes about nothing".split()
    same = 0
    for _ in range(60):
        parts = []
        for _ in range(6):
            notice = list(draw.choice(list(license_scan.NOTICES)))
            for _ in range(draw.randint(0, 2)):
                notice[draw.randrange(len(notice))] = draw.choice("aeqz")
            parts += ["".join(notice), *draw.sample(words, 4)]
        line, _ = license_scan.word_line(" ".join(parts))
        got = {(s[2], s[3]) for s in license_scan.fuzzy_spans(line)}
        want = slow_spans(line)
        assert {s[2] for s in want} <= {x for x, _ in got}
        # A reported span is a real one: its words are within that many edits of a notice of its label.
        for a, b, label, edits, _ in license_scan.fuzzy_spans(line):
            assert min(brute.edits(n, line[a:b]) for n, x in license_scan.NOTICES.items() if x == label) <= edits
        same += {(s[2], s[3]) for s in want} == got
    assert same >= 50


def test_license_time_is_linear():
    import time

    times = []
    for n in (1_000, 8_000):
        text = "released under the mit licence " * n
        began = time.process_time()
        found = license_scan.scan(text)
        times.append(time.process_time() - began)
        assert len(found["spans"]) == n and found["spans"][-1]["first_word"] == 5 * (n - 1)
    assert times[1] < 24 * times[0]


@pytest.mark.parametrize("edit", range(3))
def test_license_fuzzy_finds_edits(edit):
    draw = random.Random(edit)
    for notice, label in license_scan.NOTICES.items():
        most = min(license_scan.MOST_EDITS, len(notice) // license_scan.PER_EDIT)
        for k in range(most + 1):
            s = list(notice)
            for i in draw.sample(range(1, len(s) - 1), k):
                if s[i] != " ":
                    s[i] = "q"
            assert label in license_scan.scan("Foo bar. " + "".join(s) + " baz")["labels"].split(",")
    assert license_scan.scan("plain words about licences and nothing else")["labels"] == ""


# 4


def plain_personal(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_personal_base(spark, docs):
    draw = random.Random(5)
    atoms = ["a", "@", ".", "1", "23", "+1", "-", " ", "(", ")", "é", "😀", "b.c", "x@y.z", "4111 1111 1111 1111", "_d@e.f", "10.0.0.", "256", "\n", " [at] ", "555-123-4567", "1.2.3.4"]
    made = [(10**6 + i, "".join(draw.choice(atoms) for _ in range(draw.randint(0, 30))), None, None, None) for i in range(1500)]
    rows = docs.unionByName(spark.createDataFrame(made, DOCS)).unionByName(spark.createDataFrame(AWKWARD, DOCS))
    truth = Counter((r.doc_id, plain_personal(r.text)) for r in rows.collect())
    for r in personal_data.find_personal(rows).collect():
        match = [s for (i, s) in truth if i == r.doc_id and hashlib.sha256(s.encode()).hexdigest() == r.base_sha256]
        assert match, r
        assert set(filter(None, match[0].split(","))) <= set(filter(None, r.spans.split(",")))
        assert r.n_email == match[0].count("email") and r.n_card == match[0].count("card")


def test_personal_long_and_empty(spark, awkward, empty):
    long = [(1, "1.2.3.4 " * 4000), (2, "a@b.cd " * 4000), (3, "12 " * 20_000), (4, "a@b" + ".c" * 20_000), (5, "7" * 50_000)]
    got = {r.doc_id: r for r in personal_data.find_personal(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got[1].n_ip == 4000 and got[2].n_email == 4000 and got[4].n_email == 1 and got[5].n_card == 0
    assert got[1].spans.split(",")[-1] == "ip:31992:31999"
    assert personal_data.find_personal(awkward).count() == len(AWKWARD) and personal_data.find_personal(empty).count() == 0


def test_personal_recall_of_planted_spans(spark, docs):
    """Recall over all spans, base and added, of planted data; texts without any stay clean."""
    draw = random.Random(9)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    made = {
        "email": lambda: draw.choice(["ann.{0}@mail.example.com", "bo{0} [at] site{0}.org", "x_{0}@uni-{0}.edu"]).format(draw.randint(1, 99)),
        "ip": lambda: ".".join(str(draw.randint(1, 255)) for _ in range(4)) if draw.random() < 0.8 else ":".join(f"{draw.randint(0, 65535):x}" for _ in range(8)),
        "card": lambda: digits(16),
        "phone": lambda: f"+1 ({draw.randint(200, 999)}) 555-{digits(4)}" if draw.random() < 0.7 else f"({draw.randint(200, 999)}) 555-{digits(4)}",
        "secret": lambda: draw.choice(['token = "{0}"', "api_key: {0}", "password={0}"]).format("".join(draw.choice("0123456789abcdef") for _ in range(40))),
    }
    prose = " ".join(w for r in docs.limit(40).collect() for w in (r.text or "").split() if w.isalpha())[:20_000].split()
    rows, truth = [], {}
    for i in range(600):
        words, planted = draw.sample(prose, 12), []
        if i % 3:
            kind = draw.choice(list(made))
            words.insert(draw.randint(1, 11), planted_text := made[kind]())
            text = " ".join(words)
            planted = [(kind, text.index(planted_text), text.index(planted_text) + len(planted_text))]
        text = " ".join(words)
        rows.append((i, text))
        truth[i] = planted
    caught, clean = Counter(), 0
    for r in personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        clean += not truth[r.doc_id] and not spans
        for kind, a, b in truth[r.doc_id]:
            caught[kind, any(k == kind and s < b and a < e for k, s, e in spans)] += 1
    for kind in made:
        assert caught[kind, True] >= 0.9 * (caught[kind, True] + caught[kind, False]), (kind, caught)
    assert clean == 200


def test_estimate_tells_classes_apart():
    good, bad = [(0, "22222", "4ss", 90), (0, "12222", "4ss", 30)], [(0, "10000", "9pp", 60), (0, "10100", "9pp", 20)]
    bias, ratio, features = personal_data.estimate(good + bad)[0]
    odds = lambda votes, f: bias + sum(ratio[i][v] for i, v in enumerate(votes) if i) + sum(features.get(f"{i}{c}", 0) for i, c in enumerate(f))
    assert odds("12222", "4ss") > 2 and odds("10000", "9pp") < -2


# 5


def test_decontamination(spark, docs, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    draw, made, truth = random.Random(1), [], {}
    for n, item in enumerate(items[:12]):
        words = item.text.split()
        for edits, leak in ((0, True), (1, None), (len(words) // 4, False)):
            w = list(words)
            for i in draw.sample(range(len(w)), edits):
                w[i] = f"z{draw.random()}"
            i = 10**6 + len(made)
            made.append((i, "Some words before it " + " ".join(w) + " and after it too", "en", "a", 1))
            if leak is not None:
                truth[i] = leak
    shared = spark.createDataFrame([(0, None), (1, ""), (2, "two words"), *((r.item_id + 10, r.text) for r in items)], "item_id long, text string")
    rows = spark.createDataFrame([*made, (5, "it has two words in it", "en", "a", 1), (6, "two other words", "en", "a", 1), *((r[0] and r[0] + 100, *r[1:]) for r in AWKWARD)], DOCS)
    found = decontamination.mark(spark, rows, shared).collect()
    got = {r.doc_id: r.contaminated for r in found}
    assert len(found) == len(made) + 2 + len(AWKWARD) and got[5] and not got[6]
    assert {i: got[i] for i in truth} == truth
    assert decontamination.mark(spark, rows, shared.limit(0)).where("contaminated").count() == 0


def test_decontamination_against_all_windows(spark):
    """Edited, moved, cut and repeated passages, rows without id and with one id; every similarity as all windows have it."""
    draw = random.Random(11)
    word = lambda: f"w{draw.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([4, 6, 25, 40, 60])))) for i in range(12)]
    texts = []
    for _, item in items:
        w = item.split()
        half = len(w) // 2
        shapes = [w, w[half:] + w[:half], w[1:], w[:-1], w + w, w[: max(1, len(w) - 4)]]
        shapes += [[x if draw.random() > p else word() for x in w] for p in (0.02, 0.04, 0.06)]
        for i, shape in enumerate(shapes):
            before, after = [word() for _ in range(draw.choice([0, 0, 7]))], [word() for _ in range(draw.choice([0, 0, 7]))]
            texts.append(" ".join(before + shape + after))
    ids = [None if i % 10 == 0 else i // 2 for i in range(len(texts))]
    rows = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, item string, start int, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.contaminated, round(r.similarity, 9), r["items"]) for r in decontamination.mark(spark, rows, bench).collect())
    want = Counter()
    for d, t in zip(ids, texts, strict=True):
        found = {i: s for i, x in items if (s := brute.window_similarity(t, x)) >= decontamination.SIMILARITY}
        want[d, bool(found), round(max(found.values(), default=0.0), 9), ",".join(map(str, sorted(found)))] += 1
    assert got == want and sum(n for (_, c, *_), n in want.items() if c) > 50


def test_decontamination_stage_on_rows_without_id(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(None, "a " + item, "en", "a", 1), (None, "plain words", "en", "a", 1), (1, item, "en", "a", 1), (1, "other words", "en", "a", 1)], DOCS)
    folder = stage_tables(spark, tmp_path, rows, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in decontamination.keep_clean(spark, rows, folder).collect()) == [(0, "plain words"), (1, "other words")]


def test_hamming_index_is_complete(spark):
    draw = random.Random(3)
    masks = set(decontamination._masks())
    for _ in range(300):
        a = [draw.getrandbits(16) for _ in range(8)]
        flips = draw.sample(range(128), decontamination.RADIUS)
        b = list(a)
        for f in flips:
            b[f // 16] ^= 1 << f % 16
        assert any(x ^ y in masks for x, y in zip(a, b, strict=True))


# 6


def test_line_dedup(spark, awkward, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "q\nq\nq\nq\nq"), (4, "a\nb"), (5, None), (6, "a\nb\nc\nd"), (7, ""), (None, "a\nb\nc")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("q", 5, 4), 4: ("a\nb", 2, 0), 5: (None, 0, 0), 6: ("", 4, 4), 7: ("", 1, 0), None: ("a\nb\nc", 3, 0)}
    assert line_dedup.drop_repeats(spark, awkward).count() == len(AWKWARD) and line_dedup.drop_repeats(spark, empty).count() == 0


def test_line_dedup_of_shared_ids(spark):
    rows = [(1, "a\nb\nc", 0, 0), (2, "x\na\nb\nc", 0, 0), (2, "p\nq\nr\ns\nt", 0, 0)]
    got = {(r.doc_id, r.text) for r in line_dedup.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, covered int, _pos int")).collect()}
    assert got == {(1, "a\nb\nc"), (2, "x"), (2, "p\nq\nr\ns\nt")}


# 7


@pytest.mark.parametrize("shape", ["random", "copies", "ties"])
def test_mtree_is_exact(spark, shape):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(700, 6))
    if shape == "copies":
        x[100:400] = x[7]
    if shape == "ties":
        x = draw.integers(-1, 2, (700, 3)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None), (10_001, [float("nan")] * x.shape[1]), (10_002, [1.0, None])]
    got = {}
    for r in mtree.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    v = np.floor(x * 256).astype(np.int64)
    assert set(got) == set(range(0, 700, 50))
    for q in got:
        want = sorted((-int(v[q] @ v[i]), i) for i in range(700) if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(-s, i) for s, i in want]


def best(v, ids, queries, k=5):
    """{query: [(score, id)]} by comparing all."""
    return {q: sorted((-min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, v[i], strict=True))), ids[i]) for i in range(len(v)) if ids[i] != q)[:k] for q, x in queries.items()}


def lists(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert len(got[r.query_id]) == r["rank"]
    return got


@pytest.mark.parametrize("shape", ["random", "copies", "near"])
def test_mtree_pages_and_blocks(spark, shape):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 4))
    if shape == "copies":
        x[200:1200] = x[5]
    if shape == "near":
        x = np.repeat(draw.normal(size=(15, 4)) * 3, 100, axis=0) + draw.normal(size=(1500, 4)) / 50
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, page int, block int, id int")
    got = lists(mtree.top_k(spark, frame, every=10, page=64, block=20, routes=4).collect())  # many pages a route, many blocks a page
    v = np.floor(x * 256)
    assert got == best(v, list(range(1500)), {i: v[i] for i in range(0, 1500, 10)})


def test_mtree_repeated_ids_large_and_long(spark):
    draw = np.random.default_rng(4)
    big = [[float(a) for a in draw.integers(-(10**6), 10**6, 3)] for _ in range(40)]  # products beyond 2^53
    rows = [(i, v) for i, v in enumerate(big)] + [(0, big[1]), (0, big[0]), (3, big[3]), (7, [0.5] * 5000), (50, [2.0**40] * 3)]
    got = lists(mtree.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    v = [[int(np.floor(a * 256)) for a in x] + [0] * (5000 - len(x)) for _, x in rows]
    want = best(v, [i for i, _ in rows], {0: min(v[i] for i in (0, 40, 41)), 50: v[-1]})
    assert got == want


def test_mtree_search_visits_few_nodes():
    draw = np.random.default_rng(5)
    x = np.floor(np.repeat(draw.normal(size=(20, 3)) * 1000, 100, axis=0) + draw.normal(size=(2000, 3)))
    most = float((x * x).sum(axis=1).max())
    tree = mtree.Tree(np.arange(2000), x, most)
    for i, below in enumerate(tree.children):
        assert (below is None) != (tree.entries[i] is None)
        for c in [] if below is None else below:
            gap = mtree.distances(tree.points[tree.route[c]][None], tree.points[tree.route[i]][None])[0, 0]
            assert abs(gap - tree.to_parent[c]) < 1e-3
    seen = []
    leaf = tree._leaf
    tree._leaf = lambda j, q, *rest: (seen.append(len(q)), leaf(j, q, *rest))[1]
    ids, scores = tree.search(x[:50], np.arange(50), np.full(50, np.iinfo(np.int64).min), 5, most)
    assert sum(seen) < 50 * sum(e is not None for e in tree.entries) / 2
    assert all(sorted(-scores[i]) == sorted(-np.delete(x @ x[i], i))[:5] for i in range(50))


def test_mtree_small_tables(spark):
    make = lambda rows: mtree.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([(0, [1.0])]) == [] and make([(0, None)]) == []
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in make([(0, [1.0]), (1, [0.5]), (2, [0.5])])] == [(0, 1, 1, 32768), (0, 2, 2, 32768)]


# 8


def sainte_lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        got[max(weights, key=lambda p: (weights[p] / (2 * got[p] + 1), -p))] += 1
    return got


def test_apportion(spark):
    draw = random.Random(2)
    for seats, n in ((0, 4), (17, 3), (100, 12), (1000, 5), (7, 30)):
        weights = {i: float(draw.choice([1, 5, 50, 1000]) * draw.random()) for i in range(n)}
        frame = spark.createDataFrame([(1, i, w, seats) for i, w in weights.items()], "g int, p int, w double, seats long")
        assert {r.p: r.blocks for r in mixing.apportion(frame, "g", "p", "w", "seats").collect()} == sainte_lague(weights, seats)


def test_mixing(spark, data, docs, awkward, empty):
    rows = mixing.op8_mixing(spark, data).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)
    assert rows == mixing.op8_mixing(spark, data).collect() or sorted(rows) == sorted(mixing.op8_mixing(spark, data).collect())
    got = mixing.mix(spark, awkward).collect()
    assert len(got) == len(AWKWARD) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(spark, empty).count() == 0 and mixing.take_mix(spark, empty, "").count() == 0


def test_mixing_of_copies_and_rows_without_id(spark):
    rows = [(None, f"words of text {i} " * (i + 1), None, "a", 1) for i in range(20)] + [(7, "one text", None, "b", 1)] * 5 + [(7, "another text of that id", None, "b", 1)] + [(i, "some plain words here", None, "c", 1) for i in range(30, 60)]
    frame = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(spark, frame).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    taken = mixing.take_mix(spark, frame, "").collect()
    assert any(r.doc_id is None for r in taken) and {(r.doc_id, r.text) for r in taken} <= {r[:2] for r in rows}
    assert sorted(map(str, taken)) == sorted(map(str, mixing.take_mix(spark, frame.repartition(3), "").collect()))
    assert abs(sum(len(r.text.split()) for r in taken) - sum(r.size for r in found)) < 0.35 * sum(r.size for r in found)


# 9


def test_best_fit():
    draw = random.Random(1)
    for _ in range(50):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(0, 60))]
        rows = packing.pack(lengths, 40)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b >= n]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - n)
            else:
                bins.append(40 - n)
        assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(bins)


def test_packing_round_trip(spark, docs, awkward, empty):
    rows = docs.unionByName(awkward.select(docs.columns))
    tokens = packing.tokens_of(None)
    parts = {}
    for r in packing.pack_tokens(rows, length=512).collect():
        ids, positions = np.frombuffer(r.input_ids, np.uint16), np.frombuffer(r.position_ids, np.int32)
        assert len(ids) == len(positions) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 512
        for a, b, doc, offset in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets, strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((offset, ids[a:b]))
    # Every piece of every document is there as often as it should be: rows of one id may have the same offsets.
    got = Counter((doc, o, p.tobytes()) for doc, pieces in parts.items() for o, p in pieces)
    pieces = Counter()
    for r in rows.collect():
        ids = tokens.ids(r.text).astype(np.uint16) if r.text else np.zeros(0, np.uint16)
        pieces.update((r.doc_id, a, ids[a : a + 512].tobytes()) for a in range(0, len(ids), 512))
    assert got == pieces and packing.pack_tokens(empty).count() == 0


def test_packing_windows(spark, docs):
    """Small windows pack the same pieces; what fill they lose is little."""
    whole, cut = (packing.pack_tokens(docs.coalesce(1), length=512, window=w).collect() for w in (10**9, 20_000))
    total = lambda rows: Counter(x for r in rows for x in zip(r.doc_ids, r.offsets, strict=True))
    assert total(whole) == total(cut) and len(cut) < 1.1 * len(whole)


# 10


def test_token_counts(spark, docs, awkward, empty):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(rows).collect())
    want = Counter()
    for r in rows.collect():
        t = r.text or ""
        n = len(library.encode(t)) if t else 0
        want[(r.doc_id, len(t.encode()), n, n > 4096)] += 1
    assert got == want and token_counts.count_tokens(empty).count() == 0


def test_transducer_on_odd_texts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(token_counts.Vocabulary(path), max_states=300, max_units=50)
    draw = random.Random(1)
    atoms = ["a", "b", "the", " ", "  ", "\n", "\r", "\t", ".", ",", ";", "é", "漢", "▁", "x)", "(", "</s>", "<unk>", "😀", "\x00", "ing", "tion"]
    for _ in range(2000):
        s = "".join(draw.choice(atoms) for _ in range(draw.randint(0, 25)))
        assert own.text(s, draw.choice([1, 2, 3, 7, 1000])) == len(library.encode(s)), s


def test_state_maps_compose():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(token_counts.Vocabulary(path), max_states=500)
    draw = random.Random(2)
    atoms = ["a", "tion", "the", token_counts.MARK, token_counts.MARK * 2, "\n", ".", "é", "漢", "😀", "\x00", "ing"]
    for _ in range(400):
        a, b, c = (own.chunk_map("".join(draw.choice(atoms) for _ in range(draw.randint(0, 6)))) for _ in range(3))
        assert own.compose(own.compose(a, b), c) == own.compose(a, own.compose(b, c))
    for long in ("x" * 300_000, " " * 300_000, "a  " + "b" * 200_000, "word " * 60_000, "  ab" * 50_000):
        assert own.text(long, 4096) == len(library.encode(long))


# pipeline


def test_pipeline(spark, data, docs, tmp_path):
    import corpus_pipeline

    items = spark.read.parquet(f"{data}/benchmark.parquet")
    folder = stage_tables(spark, tmp_path, docs, items)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns, name
        rows = {r.doc_id: r for r in kept.collect()}
        left = Counter(r.doc_id for r in after.collect())
        if name == "language_id":
            model = language_id.learn(docs)
            langs, score, _ = language_id.label(model, pa.array([r.text for r in rows.values()]))
            assert set(left) == {d for d, x, v in zip(rows, langs, score, strict=True) if x != "und" and v >= language_id.REJECT / len(model.languages)}
        if name == "near_dedup":
            assert set(left) == {d for d, (_, c) in brute.groups({d: r.text for d, r in rows.items()}, near_dedup.STAGE_PERCENT).items() if d == c}
        if name == "decontamination":
            known = [r.text for r in items.collect()]
            assert set(left) == {d for d, r in rows.items() if all(brute.window_similarity(r.text, x) < decontamination.SIMILARITY for x in known)}
        if name == "mixing":
            sizes = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark, kept).collect()}
            assert left == Counter({d: t for d, (n, x) in sizes.items() if n and (t := int(x / n + 0.5))})
        else:
            assert max(left.values()) == 1
        kept = after
    tokens, want = packing.tokens_of(None), Counter()
    for r in kept.collect():
        want[r.doc_id] += len(tokens.ids(r.text)) if r.text else 0
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        for a, b, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, strict=False):
            got[doc] += b - a
    assert got == want and len(got) > 20


def test_pipeline_awkward(spark, data, awkward, empty, tmp_path):
    import corpus_pipeline

    items = spark.read.parquet(f"{data}/benchmark.parquet")
    for i, frame in enumerate((awkward.drop("spans"), empty)):
        folder = stage_tables(spark, tmp_path / str(i), frame, items)
        found = corpus_pipeline.run(spark, folder).collect()
        held = {d for r in found for d in r.doc_ids}
        # With one language learned, what is in its script stays: of copies the smallest id, and the row without one.
        assert held == (set() if i else {None, 4, 5, 6, 9, 10} & held) and (i or {None, 6} <= held)


def test_batches_are_bounded(spark):
    """A worker's batches hold at most BATCH bytes, or one row of more; a session's own smaller bound stays."""
    import pyarrow as pa
    from pagestrata.llm import common

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column(1).nbytes])], ["n", "size"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.range(40).selectExpr("id", "repeat('x', if(id = 7, 9000000, 500000)) AS text").coalesce(1)
        rows = common.map_batches(docs, run, "n long, size long").collect()
        assert sum(r.n for r in rows) == 40
        assert all(r.size <= common.BATCH + 1_000_000 or r.size >= 9_000_000 for r in rows) and len(rows) > 3
        spark.conf.set(name, "1MB")
        common.map_batches(docs, run, "n long, size long")
        assert spark.conf.get(name) == "1MB"
    finally:
        spark.conf.set(name, before)
    assert [common._bytes(x) for x in ("64m", "4096", "67108864b", "2kB")] == [64 << 20, 4096, 64 << 20, 2048]
