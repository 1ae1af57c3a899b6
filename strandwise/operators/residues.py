"""Proteins of coding sequences as codes, translated and searched in tasks.

numpy translates a batch of records at once; a protein word is a number with
five bits a class letter. Spark deals the records and adds up what tasks found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwise.functions.nucleotide import IUPAC_BASES
from strandwise.functions.protein import CODON_TABLE, ambiguous_codons, full_alphabet
from strandwise.operators import codes
from strandwise.operators.codes import byte_texts, byte_view, places

#: Bits of a class letter in a word's code, and the longest word; its code leaves room for a row number.
LETTER_BITS, MAX_WORD = 5, 9
#: Accessions that a task remembers to have a word.
KNOWN = 100_000

_BASE = np.full(256, len(IUPAC_BASES), np.uint8)
for _i, _letter in enumerate(IUPAC_BASES):
    _BASE[[ord(_letter), ord(_letter.lower())]] = _i
_BASE[[ord("U"), ord("u")]] = _BASE[ord("T")]
# Residue of three base numbers of four bits; 0: not a codon.
_RESIDUE = np.zeros(1 << 12, np.uint8)
_NAMED = {**ambiguous_codons(), **CODON_TABLE}
for _codon in product(IUPAC_BASES, repeat=3):
    _a, _b, _c = (_BASE[ord(x)].item() for x in _codon)
    _RESIDUE[_a << 8 | _b << 4 | _c] = ord(_NAMED.get("".join(_codon), "X"))


class Classes:
    """Numbers of the class letters of an alphabet; what it doesn't hold is `other` (or nothing)."""

    def __init__(self, alphabet: dict[str, str] | None, other: str = ""):
        table = full_alphabet(alphabet)
        self.letters = sorted({*table.values(), *other})
        self.usable = all(x.isascii() for x in [*table, *self.letters]) and len(self.letters) <= 1 << LETTER_BITS
        if self.usable:
            self.number = np.full(256, self.letters.index(other) if other else 255, np.uint8)
            for residue, letter in table.items():
                self.number[ord(residue)] = self.letters.index(letter)
            self.bytes = np.frombuffer("".join(self.letters).encode(), np.uint8)

    def fits(self, k: int) -> bool:
        return self.usable and 0 < k <= MAX_WORD

    def code(self, word: str) -> int | None:
        """Code of a word; none if no residues spell it."""
        if any(x not in self.letters for x in word):
            return None
        return sum(self.letters.index(x) << LETTER_BITS * i for i, x in enumerate(reversed(word)))

    def text(self, code: np.ndarray, k: int) -> pa.Array:
        shifts = LETTER_BITS * np.arange(k - 1, -1, -1)
        return byte_texts(self.bytes[code[:, None] >> shifts & (1 << LETTER_BITS) - 1])


def _proteins(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`first, run, residue` of runs of rows: each residue but stops, and its row after the first one."""
    data, at = byte_view(batch.column("seq"))
    begin = 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(at, at[begin] + codes.STEP_LETTERS, "right")) - 1, begin + 1)
        end = min(end, begin + (1 << 16))
        sizes = np.diff(at[begin : end + 1]) // 3
        run, place = places(np.zeros(len(sizes), np.int64), sizes)
        # Codon j of a run stands 3 j letters after its start.
        place = 3 * place + np.repeat(at[begin:end], sizes)
        base = _BASE[data[at[begin] : at[end]]]
        place -= at[begin]
        code = base[place].astype(np.int32) << 8 | base[place + 1].astype(np.int32) << 4 | base[place + 2]
        residue = _RESIDUE[code]
        if not residue.all():
            bad = int(place[np.flatnonzero(residue == 0)[0]] + at[begin])
            raise ValueError(f"not a codon: {data[bad : bad + 3].tobytes().decode(errors='replace').upper()}")
        kept = residue != ord("*")
        yield begin, run[kept], residue[kept]
        begin = end


def _words(run: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and code of each word of k letters that lies in one run."""
    n = max(len(number) - k + 1, 0)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code << LETTER_BITS | number[i : i + n]
    at = np.flatnonzero(run[:n] == run[k - 1 : k - 1 + n])
    return at, code[at]


def _plain(run: np.ndarray, residue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the proteins that hold J, B or Z."""
    ambiguous = np.isin(residue, np.frombuffer(b"JBZ", np.uint8))
    if not ambiguous.any():
        return run, residue
    kept = ~np.isin(run, run[ambiguous])
    return run[kept], residue[kept]


def _numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, and the values by number."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_counts(cds: DataFrame, k: int, classes: Classes) -> DataFrame:
    """`accession, word, n`: words of coding sequences (`accession, seq`; null: none), counted batch by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, names = _numbered(batch.column("accession"))
            for first, run, residue in _proteins(batch):
                run, residue = _plain(run, residue)
                number = classes.number[residue]
                if (number == 255).any():
                    own = residue[run == run[np.flatnonzero(number == 255)[0]]]
                    raise ValueError(f"residue outside the alphabet in {own.tobytes().decode()}")
                at, code = _words(run, number, k)
                joint = group[first + run[at]] << LETTER_BITS * k | code
                if len(names) << LETTER_BITS * k <= codes.DENSE_CODES:
                    n = np.bincount(joint)
                    joint = np.flatnonzero(n)
                    n = n[joint]
                else:
                    joint, n = np.unique(joint, return_counts=True)
                accession = names.take(pa.array(joint >> LETTER_BITS * k))
                word = classes.text(joint & (1 << LETTER_BITS * k) - 1, k)
                yield pa.RecordBatch.from_arrays([accession, word, pa.array(n, pa.int64())], names=["accession", "word", "n"])

    rows = cds.select("accession", "seq")
    return rows.mapInArrow(count, codes._schema(rows, ["accession"], "word STRING, n BIGINT"))


def any_word(cds: DataFrame, k: int) -> DataFrame:
    """`accession, any`: accessions of a task, and whether a record of theirs has a word (null `seq`: none)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        for batch in batches:
            group, names = _numbered(batch.column("accession"))
            names = names.to_pylist()
            has = np.array([x in done for x in names], bool)
            left = np.flatnonzero(~has[group])
            for first, run, residue in _proteins(batch.take(pa.array(left))):
                rows, n = np.unique(_plain(run, residue)[0], return_counts=True)
                has[group[left[first + rows[n >= k]]]] = True
            new = [i for i, x in enumerate(names) if x not in done]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in new], batch.schema.field("accession").type), pa.array(has[new], pa.bool_())], names=["accession", "any"]
            )
            done.update(names[i] for i in new if has[i] and len(done) < KNOWN)

    rows = cds.select("accession", "seq")
    return rows.mapInArrow(look, codes._schema(rows, ["accession"], "any BOOLEAN"))


def _apart(group: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which of a group's places (ascending) count, if one within k of the last that counted doesn't."""
    # Groups are told apart by a gap, so one search finds the next place that can count.
    line = at + group * (int(at.max()) + k + 1)
    after = np.searchsorted(line, line + k)
    kept = np.zeros(len(line), bool)
    front = np.flatnonzero(np.concatenate([[True], np.diff(line) >= k]))
    while len(front):
        kept[front] = True
        front = after[front]
        front = front[front < len(line)]
        front = front[~kept[front]]
    return kept


def word_places(cds: DataFrame, words: list[str], classes: Classes) -> DataFrame:
    """`accession, name, motif, pos, amino_match`: where each word stands in each row's
    protein (`accession, name, seq`), from left to right and never overlapping itself."""
    by_width: dict[int, dict[int, str]] = {}
    for word in words:
        if (code := classes.code(word)) is not None:
            by_width.setdefault(len(word), {})[code] = word
    wanted = [
        (k, codes.CodeSet(np.array(list(known)), LETTER_BITS * k), np.array(sorted(known)), pa.array([known[c] for c in sorted(known)]))
        for k, known in by_width.items()
    ]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run, residue in _proteins(batch):
                number = classes.number[residue]
                for k, members, order, texts in wanted:
                    at, code = _words(run, number, k)
                    hit = members.places(code)
                    if not len(hit):
                        continue
                    at, slot = at[hit], np.searchsorted(order, code[hit])
                    by_word = np.lexsort((at, slot))
                    at, slot = at[by_word], slot[by_word]
                    # A group: the places of one word in one row.
                    group = np.cumsum(np.concatenate([[False], (slot[1:] != slot[:-1]) | (run[at[1:]] != run[at[:-1]])]))
                    kept = _apart(group, at, k)
                    at, slot = at[kept], slot[kept]
                    rows = batch.select(["accession", "name"]).take(pa.array(first + run[at]))
                    match = byte_texts(residue[at[:, None] + np.arange(k)])
                    pos = pa.array(at - np.searchsorted(run, run[at]), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("accession"), rows.column("name"), texts.take(pa.array(slot)), pos, match],
                        names=["accession", "name", "motif", "pos", "amino_match"],
                    )

    rows = cds.select("accession", "name", "seq")
    return rows.mapInArrow(found, codes._schema(rows, ["accession", "name"], "motif STRING, pos BIGINT, amino_match STRING"))
