"""Licence scan: a generalised suffix automaton of licence words, matching statistics, chained spans.

The automaton holds every run of words of all notices. A text streams through
it: after each word the state stands for the longest run that ends there and
occurs in some notice (the matching statistics). Where a run can't be extended
it is a maximal match. Matches of LEAST_MATCH words or more (a shorter notice:
all of it) are chained, per notice, in order of text and notice, over at most
MOST_GAP other words; the notice's words under a chain are its cover. A chain
that covers LEAST_COVER of its notice is a span and adds the notice's label. The
fixed phrases are runs of the automaton too: a phrase ends at a word if its state
lies on the suffix links of the word's state.

Words of a text that stand in no word pair of the automaton can't be part of a
match of two words, so whole arrays of words are ruled out before the automaton
takes the rest, run by run. The automaton is small and the same in all tasks;
documents are never shuffled.

Null texts are empty: no word, no span, score 0, empty labels. Long texts go
through in stretches of a megabyte and are held as 4 bytes a word. Repeated rows
and null or tied ids are rows of their own. All input columns are kept; a result
column whose name is taken gets an underscore in front. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandwise.llm.common import fresh, spread_scan, texts_of
from strandwise.llm.licenses import NOTICES, PHRASES
from strandwise.llm.terms import word_lists

#: Words of the shortest match that a chain takes.
LEAST_MATCH = 4
#: Words of the text that may lie between two matches of a chain.
MOST_GAP = 12
#: Share of a notice's words that a span covers.
LEAST_COVER = 0.8

RESULT = (
    "n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base_labels ARRAY<STRING>, "
    "labels ARRAY<STRING>, score DOUBLE, "
    "spans ARRAY<STRUCT<label: STRING, notice: STRING, first_word: BIGINT, last_word: BIGINT, cover: DOUBLE>>"
)


@dataclass
class Automaton:
    """States as lists: transitions, suffix link, longest run; state 0 is the start."""

    words: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: Notices as (label, name, word numbers).
    notices: list[tuple[str, str, list[int]]] = field(default_factory=list)
    #: By state: where in which notice its runs end; and the phrases that end its runs.
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    phrases: list[list[tuple[int, str]]] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the runs that `state` extends by `word`, apart from longer ones."""
        target = self.step[state][word]
        if self.longest[target] == self.longest[state] + 1:
            return target
        copy = self._state(self.longest[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: int) -> int:
        """The state after one more word of a notice."""
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.longest[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def walk(self, run: Sequence[int]) -> int:
        state = 0
        for word in run:
            state = self.step[state][word]
        return state


def _numbers(automaton: Automaton, text: str) -> list[int]:
    return [
        automaton.words.setdefault(w, len(automaton.words) + 1) for part in word_lists(text.encode()) for w in part
    ]


def build(notices: Sequence[tuple[str, str, str]], phrases: Mapping[str, str]) -> Automaton:
    """The automaton of all notices and phrases; both need two words or more."""
    a = Automaton()
    runs = [(label, name, _numbers(a, text)) for label, name, text in notices]
    fixed = [(label, _numbers(a, text)) for text, label in phrases.items()]
    a.notices = runs + [(label, "", run) for label, run in fixed]
    for notice, (_, name, run) in enumerate(a.notices):
        if len(run) < 2:
            raise ValueError("a notice or phrase needs two words or more")
        last = 0
        for i, word in enumerate(run):
            last = a.extend(last, word)
            a.ends[last].add((notice, i))
    order = sorted(range(1, len(a.step)), key=lambda s: -a.longest[s])
    for s in order:  # what ends a run ends its suffixes as well
        a.ends[a.link[s]] |= a.ends[s]
    a.phrases = [[] for _ in a.step]
    own = [(a.walk(run), len(run), label) for label, run in fixed]
    for s in reversed(order):
        a.phrases[s] = a.phrases[a.link[s]] + [(n, label) for at, n, label in own if at == s]
    base = len(a.words) + 1
    a.pairs = np.unique(np.array([x * base + y for _, _, run in a.notices for x, y in zip(run, run[1:])], np.int64))
    return a


def word_numbers(a: Automaton, text: bytes) -> np.ndarray:
    """The text's words by number; 0 for words that no notice has."""
    get = a.words.get
    return np.concatenate([np.array(list(map(get, part, repeat(0))), np.int32) for part in word_lists(text)])


def known_runs(a: Automaton, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches `[begin, end)` of two words or more whose neighbouring words are pairs of some notice."""
    if len(numbers) < 2:
        return []
    left, right = numbers[:-1], numbers[1:]
    at = np.flatnonzero((left > 0) & (right > 0))
    codes = left[at].astype(np.int64) * (len(a.words) + 1) + right[at]
    found = np.searchsorted(a.pairs, codes)
    at = at[(found < len(a.pairs)) & (a.pairs[np.minimum(found, len(a.pairs) - 1)] == codes)]
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    begins, ends = at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]] + 2
    return list(zip(begins.tolist(), ends.tolist()))


def matches(a: Automaton, numbers: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """`(end, length, state, maximal)` after each word inside the known runs; end is the word's place."""
    for begin, end in known_runs(a, numbers):
        state = length = 0
        held: tuple[int, int, int] | None = None
        for place, word in enumerate(numbers[begin:end].tolist(), begin):
            grown = True
            while state and word not in a.step[state]:
                state, grown = a.link[state], False
                length = a.longest[state]
            if word in a.step[state]:
                state, length = a.step[state][word], length + 1
            if held:
                yield *held, not grown
            held = place, length, state
        if held:
            yield *held, True


@dataclass
class _Chains:
    """Chains of matches of one notice, as the text streams by."""

    size: int
    #: Recent matches: text end, notice end, words covered, first word of the chain.
    recent: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: Best chain by first word: words covered, text end.
    best: dict[int, tuple[int, int]] = field(default_factory=dict)

    def add(self, end: int, length: int, notice_end: int) -> None:
        begin, notice_begin = end - length + 1, notice_end - length + 1
        self.recent = [r for r in self.recent if r[0] >= begin - 1 - MOST_GAP]
        covered, first = length, begin
        for e, ne, c, f in self.recent:
            shared = max(0, e - begin + 1, ne - notice_begin + 1)
            if ne < notice_end and e < end and shared < length and c + length - shared > covered:
                covered, first = c + length - shared, f
        self.recent.append((end, notice_end, covered, first))
        if covered > self.best.get(first, (0, 0))[0]:
            self.best[first] = covered, end


def scan_text(a: Automaton, text: bytes) -> dict:
    """All result columns of one text."""
    numbers = word_numbers(a, text)
    places, base, chains = [], set(), {}
    for end, length, state, maximal in matches(a, numbers):
        for n, label in a.phrases[state]:
            if n <= length:
                places.append(end - n + 1)
                base.add(label)
        if not maximal or length < 2:
            continue
        for notice, notice_end in a.ends[state]:
            size = len(a.notices[notice][2])
            if length >= min(LEAST_MATCH, size) and a.notices[notice][1]:
                chains.setdefault(notice, _Chains(size)).add(end, length, notice_end)
    score, spans = (1.0 if places else 0.0), []
    for notice, found in chains.items():
        label, name, _ = a.notices[notice]
        for first, (covered, end) in found.best.items():
            cover = min(1.0, covered / found.size)
            score = max(score, cover)
            if cover >= LEAST_COVER:
                spans.append({"label": label, "notice": name, "first_word": first, "last_word": end, "cover": cover})
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["notice"]))
    return {
        "n_words": len(numbers),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": sorted(base),
        "labels": sorted(base | {s["label"] for s in spans}),
        "score": score,
        "spans": spans,
    }


def scan(
    docs: DataFrame,
    text: str = "text",
    notices: Sequence[tuple[str, str, str]] = NOTICES,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """`docs` with the columns of RESULT; a notice's text is not held back from other notices' spans."""
    result = T.StructType.fromDDL(RESULT)
    names = [fresh(docs, f.name) for f in result.fields]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, result.fields)]
    schema = T.StructType([*docs.schema.fields, *fields])
    parameters = list(notices), dict(phrases)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(T.StructType(fields))
        automaton = build(*parameters)
        for batch in batches:
            rows = [scan_text(automaton, t) for t in texts_of(batch.column(text))]
            found = [pa.array([r[f.name] for r in rows], arrow.field(i).type) for i, f in enumerate(result.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    return spread_scan(docs).mapInArrow(scanned, schema)
