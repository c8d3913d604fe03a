"""Language of whole texts: script ranges, per-word scores, and Viterbi spans.

A word is a run of letters (ASCII letters, or any bytes beyond ASCII). Its scripts, told by the
ranges of its characters, leave only the languages that were seen in one of them. Each candidate gets the naive
Bayes score of the word's byte 2-, 3- and 4-grams, word ends included. Viterbi over the words with a
penalty for each switch labels spans, so a quotation in another language is one span and a stray
word is none. The prediction is the language with the most bytes; its score is those bytes' share
of the text's, weighted by the words' posteriors.

Learned: whole texts with a language whose crc32(id) mod 3 is not 1, drawn by a hash of the id: of each language about
``per_language`` texts, or as many as have about ``train_chars`` characters together (of all languages ``all_chars``): a bounded sample,
the same at every size. Predictions read whole texts and nothing else. Words of no known script range are scored by their n-grams alone.
Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing to learn from. Rows
without id are predicted and never learned from; repeated rows are rows of their own; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm.common import documents, map_batches, pieces

PER_LANGUAGE, TRAIN_CHARS, ALL_CHARS = 800, 4_000_000, 128_000_000
#: Nats that a switch of language costs; share of a language's words from which a script is one of its own.
SWITCH, SCRIPT_SHARE = 12.0, 0.01
BITS = 16
ORDERS = (2, 3, 4)
#: Bytes of text whose positions are scored at once.
PART = 1 << 19

#: First bytes of UTF-8 sequences by script range, as bits. Bytes that symbols share with scripts (E2, EE and beyond) tell none.
_RANGES = {0x01: range(0xC2, 0xCC), 0x02: range(0xCE, 0xD0), 0x04: range(0xD0, 0xD5), 0x08: range(0xD5, 0xD8), 0x10: range(0xD8, 0xE0), 0x20: range(0xE0, 0xE1), 0x40: range(0xE1, 0xE2), 0x80: range(0xE3, 0xEE)}
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
for _bit, _bytes in _RANGES.items():
    _SCRIPT[list(_bytes)] = _bit
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _words(texts: pa.Array):
    """(n-gram slots of each position by order, first position of each word, script bits and bytes of each word, words before each text)."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0] + np.arange(n + 1)
    # A blank after every text, and four before the first, so that no n-gram or word crosses texts.
    data = np.full(len(raw) + n + 4, 32, np.uint8)
    at = np.ones(len(raw) + n, bool)
    at[ends[1:] - 1] = False
    data[4:][at] = _FOLD[raw]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)
    data[1:][upper] += 32
    body = data[4:]
    letter = body != 32
    before = data[3:-1] != 32
    used = np.flatnonzero(letter | before)
    first = np.flatnonzero((letter & ~before)[used])
    x = data.astype(np.uint32)
    grams = []
    for order in ORDERS:
        h = np.zeros(len(body), np.uint32)
        for i in range(order):
            h = h * np.uint32(0x01000193) + x[4 - i : len(x) - i]
        h = h[used] * np.uint32(0x9E3779B1)
        grams.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    kinds = np.zeros(len(body), np.uint8)
    kinds[at] = _SCRIPT[raw]
    starts = used[first]
    scripts = np.bitwise_or.reduceat(kinds[used], first) if len(first) else np.zeros(0, np.uint8)
    size = np.diff(np.append(first, len(used))) - 1
    return grams, first, scripts, size, np.searchsorted(starts, ends)


class Model:
    def __init__(self, languages: list[str], tables: np.ndarray, allowed: np.ndarray):
        self.languages, self.tables, self.allowed = languages, tables, allowed

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        size = 1 << BITS
        counts = np.zeros((len(ORDERS), len(languages), size))
        scripts = np.zeros((len(languages), 8))
        words = np.zeros(len(languages))
        for k, language in enumerate(languages):
            own = [t for t, label in zip(texts, labels, strict=True) if label == language]
            for i in range(0, len(own), 64):
                grams, first, kinds, _, _ = _words(pa.array(own[i : i + 64]))
                words[k] += len(first)
                scripts[k] += [np.count_nonzero(kinds & (1 << b)) for b in range(8)]
                for o, slots in enumerate(grams):
                    counts[o, k] += np.bincount(slots, minlength=size)
        seen = np.maximum((counts.sum(axis=1) > 0).sum(axis=1), 1)[:, None, None]
        logs = np.log((counts + 0.5) / (counts.sum(axis=2, keepdims=True) + 0.5 * seen))
        logs -= logs.max(axis=1, keepdims=True)
        own = scripts >= SCRIPT_SHARE * np.maximum(words, 1)[:, None]
        allowed = np.array([[any(own[k, b] for b in range(8) if kind >> b & 1) for k in range(len(languages))] for kind in range(256)], bool).reshape(256, len(languages))
        return cls(languages, np.ascontiguousarray(logs.transpose(0, 2, 1), np.float32) / len(ORDERS), allowed)

    def word_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each word by language, bytes of each word, words before each text)."""
        grams, first, kinds, size, at = _words(texts)
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32), size, at
        scores = self.tables[0][grams[0]]
        for table, slots in zip(self.tables[1:], grams[1:], strict=True):
            scores += table[slots]
        scores = np.add.reduceat(scores, first, axis=0)
        allowed = self.allowed[kinds]
        scores[~allowed & allowed.any(axis=1, keepdims=True)] -= 30
        return scores, size, at

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(label of each word, its posterior, bytes of each word, words before each text).

        Positions are scored a part at a time, as they take far more room than words.
        """
        parts = [self.word_scores(p.column(0)) for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t", PART)]
        scores, size = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        before = np.cumsum([0, *(p[2][-1] for p in parts)])
        at = np.concatenate([p[2][:-1] + b for p, b in zip(parts, before, strict=False)] + [before[-1:]])
        if not len(scores):
            return np.zeros(0, np.int16), np.zeros(0), size, at
        labels = viterbi(scores, at, SWITCH)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return labels, odds[np.arange(len(labels)), labels] / odds.sum(axis=1), size, at


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: sum of scores less ``switch`` for each change, for all texts in step."""
    count = np.diff(at)
    filled = np.flatnonzero(count)
    sums = np.add.reduceat(scores, at[filled], axis=0)
    only = sums.argmax(axis=1)
    out = np.repeat(only, count[filled]).astype(np.int16)
    # Where all that other labels could gain is less than one switch, one label is best.
    gain = np.add.reduceat(scores.max(axis=1) - scores[np.arange(len(out)), out], at[filled])
    open_ = filled[gain > switch]
    if not len(open_):
        return out
    open_ = open_[np.argsort(-count[open_], kind="stable")]
    start, length = at[open_], count[open_]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    back = np.zeros(scores.shape, bool)
    lead = np.zeros(len(scores), np.int16)
    best = scores[start].copy()
    for t in range(1, steps):
        k = active[t]
        row = start[:k] + t
        now = best[:k]
        top = now.argmax(axis=1)
        reach = now[np.arange(k), top][:, None] - switch
        moved = reach > now
        back[row], lead[row] = moved, top
        best[:k] = np.where(moved, reach, now) + scores[row]
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        row = start[:k] + t
        out[row] = label[:k]
        label[:k] = np.where(back[row, label[:k]], lead[row], label[:k])
    return out


def fold_of(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, train_chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """Fits the model on a bounded sample: of each language the rows that a hash takes at the rate which keeps to the bounds."""
    rows = docs.where((fold_of(F.col(key)) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r[0]: (r[1], max(1, r[2])) for r in rows.groupBy("l").agg(F.count("*"), F.sum(F.length("t"))).collect()}
    if not counts:
        return Model([], np.zeros((len(ORDERS), 1 << BITS, 0), np.float32), np.zeros((256, 0), bool))
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_000))
    most = min(train_chars, all_chars / len(counts))
    rates = F.create_map(*(F.lit(x) for language, (n, chars) in sorted(counts.items()) for x in (language, int(1e6 * min(1, per_language / n, most / chars)))))
    sample = rows.where(draw < rates[F.col("l")]).select("t", "l").toArrow()
    if not sample.num_rows:  # the rates are for many rows
        sample = rows.orderBy(draw, "k").limit(len(counts)).select("t", "l").toArrow()
    return Model.fit(sample["t"].to_pylist(), sample["l"].to_pylist())


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def label(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, pa.Array]:
    """(language, score, spans) of each text."""
    n = len(texts)
    names = np.array([*model.languages, "und"], object)
    if not model.languages:
        return ["und"] * n, np.zeros(n), pa.array([[]] * n, pa.list_(_SPAN))
    labels, odds, size, at = model.spans(texts)
    k = len(model.languages)
    owner = np.repeat(np.arange(n), np.diff(at))
    weight = np.bincount(owner * k + labels, size, n * k).reshape(n, k)
    sure = np.bincount(owner * k + labels, size * odds, n * k).reshape(n, k)
    pick = weight.argmax(axis=1)
    total = weight.sum(axis=1)
    score = np.where(total > 0, sure[np.arange(n), pick] / np.maximum(total, 1), 0.0)
    pick = np.where(total > 0, pick, k)
    new = np.ones(len(labels), bool)
    if len(labels):
        new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    runs = pa.StructArray.from_arrays([pa.array(names[labels[heads]], pa.string()), pa.array(heads - at[owner[heads]]), pa.array(np.diff(np.append(heads, len(labels))))], ["lang", "first_word", "n_words"])
    return names[pick].tolist(), np.clip(score, 0, 1), pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, at).astype(np.int32)), runs)


def _no_letter(texts: pa.Array, plain: pa.Array) -> np.ndarray:
    """True where no character is a letter; only texts without ASCII letters are looked at one by one."""
    out = np.zeros(len(texts), bool)
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)):
        t = texts[int(i)].as_py()
        out[i] = not t or not any(c.isalpha() for c in t)
    return out


def identify(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans) for each row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1 << 17, (16 << 20) // max(4, len(shared.value.languages)))
        for batch in batches:
            for part in pieces(batch, text, step):
                texts = part.column(text)
                langs, score, spans = label(shared.value, texts)
                dull = _no_letter(texts, pa.compute.match_substring_regex(texts.fill_null(""), "[A-Za-z]"))
                langs = ["und" if d else x for d, x in zip(dull, langs, strict=True)]
                if dull.any():
                    spans = pa.array([[] if d else x for d, x in zip(dull, spans.to_pylist(), strict=True)], spans.type)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(langs), pa.array(np.where(dull, 0.0, score)), spans], [key, "lang_pred", "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"{key} {kind}, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(spark, docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


#: A text is rejected if it is ``und``, or if its score is below this many times what equal odds would give. With one
#: language scores tell nothing, and a text is rejected if over half of its words' bytes are outside that language's scripts.
REJECT = 1.1


def _in_scripts(model: Model, texts: pa.Array) -> np.ndarray:
    """True where at least half of the words' bytes are of words in a learned script."""
    parts = []
    for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t", PART):
        _, _, kinds, size, at = _words(p.column(0))
        owner = np.repeat(np.arange(p.num_rows), np.diff(at))
        within = size * model.allowed[kinds].any(axis=1)
        parts.append(np.bincount(owner, within, p.num_rows) * 2 >= np.bincount(owner, size, p.num_rows))
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is undetermined or doubtful go; one scan, no join."""
    model = spark.sparkContext.broadcast(learn(docs))
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                texts = part.column("text")
                langs, score, _ = label(model.value, texts)
                dull = _no_letter(texts, pa.compute.match_substring_regex(texts.fill_null(""), "[A-Za-z]"))
                sure = score >= REJECT / len(model.value.languages) if len(model.value.languages) > 1 else _in_scripts(model.value, texts)
                keep = ~dull & sure & np.array([x != "und" for x in langs], bool)
                yield part.filter(pa.array(keep))

    return map_batches(docs, run, schema).select(columns)


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
