"""Token counts by a finite-state transducer compiled from a subword vocabulary.

The vocabulary merges neighbouring pieces by rank. For such a vocabulary a row of pieces is the
library's result exactly if every two neighbours u, v are (that is, merging u + v alone gives u, v),
and for every prefix of a unit exactly one last piece meets this. The state after a prefix is
therefore finite: the longest suffix that still starts some piece, with the last piece and the
relative count at each of its positions. Transitions carry the change of the count. States and
transitions are compiled when first met and dropped together at ``max_states``.

Units end before each word mark: no piece has a word mark after another character, so a word mark after
another character, a line end and a character in no piece send every state to one and the same. A chunk of text is therefore a map
from states to states and counts in two parts: what it holds up to the first such place, which is still to be run from
the state that comes in, and from there a fixed count and a fixed state that goes out. The maps compose
associatively; a scan joins those of a long text pairwise, in as many rounds as their number has bits.

Runs of two or more word marks share one rank in the vocabulary; units that start with such a run take the merge rule itself,
and their state is the unit so far. Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm.common import documents, map_batches, pieces

MARK = "▁"
PART = re.compile(f"{MARK}+|[^{MARK}\n]+")
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
LIMIT = 4096


class Vocabulary:
    """Ranks of the pieces of a sentencepiece BPE model with byte fallback, and its merge rule."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rank = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                rank[model.id_to_piece(i)] = -model.get_score(i)
        self.rank = rank
        self.chars = {c for p in rank for c in p}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.whole = {p for p in rank if len(p) == 1 or self.merge(p) == [p]}
        self.starts: dict[str, list[str]] = {}
        for p in self.whole:
            for k in range(1, len(p) + 1):
                self.starts.setdefault(p[:k], []).append(p)
        self._alike: dict[tuple[str, str], object] = {}

    def merge(self, text: str) -> list[str]:
        """The library's pieces of a short text: merges the best pair, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tokens(self, text: str) -> int:
        """Tokens of the merge rule; a character in no piece takes one for each of its bytes."""
        return sum(1 if p in self.rank else len(p.encode()) for p in self.merge_long(text))

    def merge_long(self, text: str) -> list[str]:
        """As merge(), with a heap: long units stay near-linear."""
        if len(text) < 40:
            return self.merge(text)
        import heapq

        n, rank = len(text), self.rank
        part, after, before = list(text), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a + b in rank]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or part[i] + part[j] != piece:
                continue
            part[i], part[j], after[i] = piece, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(p := part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [p for p in part if p]

    def alike(self, last: tuple[object, int], open_: str, few: int = 12) -> tuple[object, int] | None:
        """What of the last piece still tells states apart: the pieces that start with ``open_`` and may follow it; None if there are none."""
        u, change = last
        if type(u) is frozenset:
            left = frozenset(t for t in u if t.startswith(open_))
            return (left, change) if left else None
        longer = self.starts.get(open_)
        if not longer:
            return None
        if len(longer) > few:
            return last
        key = (u, open_)
        if key not in self._alike:
            if len(self._alike) > 200_000:
                self._alike.clear()
            self._alike[key] = frozenset(t for t in longer if not u or self.neighbours(u, t))
        left = self._alike[key]
        return (left, change) if left else None

    def neighbours(self, u: str, v: str) -> bool:
        key = (u, v)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(u + v) == [u, v]
        return known


#: A state by its key (see Transducer), or the unit so far where that begins with a run of word marks.
State = tuple | str
START = ("", (("", 0),))


class StateMap(NamedTuple):
    """What a chunk does to the state that comes in: ``head`` is run from it; if ``reset``, ``count`` tokens follow and ``state`` goes out."""

    head: str
    reset: bool = False
    count: int = 0
    state: State = START


class Transducer:
    """Deterministic, compiled as it is met: ``step[state][char] -> (state, change of the count)``."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 120_000, max_units: int = 400_000):
        self.vocabulary, self.max_states, self.max_units = vocabulary, max_states, max_units
        self.units: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: the open suffix, and at each of its positions (the oldest first) the last piece and the count against the present one.
        self.step: list[dict[str, tuple[int, int]]] = [{}]
        self.keys: list[tuple] = [START]
        self.known = {self.keys[0]: 0}
        self.marked = self._compile(0, MARK)[0]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        vocabulary = self.vocabulary
        suffix, lasts = self.keys[state]
        grown = suffix + char
        for k in range(len(grown)):  # the longest piece first
            piece = grown[k:]
            if piece in vocabulary.whole and lasts[k]:
                u, c = lasts[k]
                if piece in u if type(u) is frozenset else not u or vocabulary.neighbours(u, piece):
                    break
        else:
            raise ValueError(f"no piece ends {grown!r}")
        change = c + 1
        marks = [x and (x[0], x[1] - change) for x in lasts] + [(piece, 0)]
        cut = next((k for k in range(len(grown)) if grown[k:] in vocabulary.starts), len(grown))
        # Positions from which no piece can still grow don't tell states apart.
        key = (grown[cut:], tuple(x and vocabulary.alike(x, grown[k:]) for k, x in enumerate(marks[cut:], cut) if k < len(grown)) + (marks[-1],))
        out = self.step[state][char] = (self._number(key), change)
        return out

    def _number(self, key: tuple) -> int:
        there = self.known.get(key)
        if there is None:
            there = self.known[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        return there

    def count(self, unit: str) -> int:
        """Tokens of a unit, in one pass over its characters."""
        if unit.startswith(MARK * 2) or not self.vocabulary.chars.issuperset(unit):
            return self.vocabulary.tokens(unit)
        step, state, total = self.step, 0, 0
        for char in unit:
            there = step[state].get(char) or self._compile(state, char)
            state = there[0]
            total += there[1]
        return total

    def of(self, unit: str) -> int:
        n = self.units.get(unit)
        if n is None:
            n = self.count(unit)
            if len(unit) <= 24:
                if len(self.units) >= self.max_units:
                    self.units.clear()
                self.units[unit] = n
        return n

    def run(self, state: State, text: str) -> tuple[State, int]:
        """(state, change of the count) after characters that follow in the state."""
        tokens, total, i = self.vocabulary.tokens, 0, 0
        at = state if type(state) is str else self._number(state)
        while i < len(text):
            if text[i] == "\n":
                total, at, i = total + self.of("\n"), 0, i + 1
                continue
            j = PART.match(text, i).end()
            part, i = text[i:j], j
            if part[0] == MARK:
                marks = at if type(at) is str and not at.strip(MARK) else MARK if at == self.marked else ""
                if marks or len(part) > 1:
                    total += tokens(marks + part) - (tokens(marks) if marks else 0)
                    at = marks + part
                else:
                    at, n = self.step[0].get(MARK) or self._compile(0, MARK)
                    total += n
            elif type(at) is str:
                total += tokens(at + part) - tokens(at)
                at += part
            else:
                for char in part:
                    if char in self.vocabulary.chars:
                        at, n = self.step[at].get(char) or self._compile(at, char)
                    else:
                        at, n = 0, len(char.encode())
                    total += n
        return at if type(at) is str else self.keys[at], total

    def chunk_map(self, chunk: str) -> StateMap:
        """The chunk's map. Its head is the unit that may go on from the chunk before: up to the first place that resets."""
        if len(self.keys) > self.max_states:
            self._reset()
        found = UNIT.findall(chunk)
        head = "" if not found or found[0] == "\n" else found.pop(0)
        if not found:
            return StateMap(head)
        tail = found.pop()
        get = self.units.get
        try:
            body = sum(map(self.units.__getitem__, found))
        except KeyError:
            body = 0
            for u in found:
                n = get(u)
                body += self.of(u) if n is None else n
        state, n = self.run(START, tail)
        return StateMap(head, True, body + n, state)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; associative."""
        if not a.reset:
            return StateMap(a.head + b.head, b.reset, b.count, b.state)
        state, n = self.run(a.state, b.head)
        return StateMap(a.head, True, a.count + n + b.count, b.state) if b.reset else StateMap(a.head, True, a.count + n, state)

    def text(self, text: str | None, chunk: int = 65_536) -> int:
        """Tokens of a text: its chunks' maps, joined pairwise, applied to the start."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*pair) if len(pair) == 2 else pair[0] for pair in (maps[i : i + 2] for i in range(0, len(maps), 2))]
        return self.run(START, maps[0].head)[1] + maps[0].count


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process and model."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(Vocabulary(path))
    return _COMPILED[path]


def count_tokens(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row. ``model``: a sentencepiece BPE model; None takes piece_bpe_32k.model where the worker has it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        compiled = transducer(model or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            for part in pieces(batch, text, 4 << 20):
                texts = part.column(text)
                sizes = pa.compute.binary_length(texts).fill_null(0).cast(pa.int64())
                tokens = [compiled.text(x.as_py()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(key), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(key, text), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
