"""Byte-level BPE encoding and decoding by DuckDB recursive queries over a partition's distinct words.

Each task keeps an in-memory DuckDB connection with two tables: the vocabulary
and the merges (left id, right id, merged id), derived from the ranks. A step of
the recursive query holds one row for each token position of a word, with the
position and token to its right, joins both tokens with the merge table, finds
each word's smallest merged rank and its leftmost place, and contracts that
pair; words without a pair are marked and drop out, so the query ends at the
fixpoint. Ids are put together, and decoded to bytes, by ordered aggregation.

A text is cut into segments before white space, a segment into the matches of
the pattern; both are encoded once and kept in bounded tables of the worker.
A match that is a token itself is that token, as in the usual encoders. A match
of n bytes may need n steps of up to n rows, all of which the query holds, so a
query takes matches of at most `ROWS_A_QUERY` such rows together. A match of more
than `LONG_WORD` bytes goes through a heap of pairs instead.

Defined results: a null or empty text has no ids and decodes to no bytes. A very
long text is encoded whole, alone in its step. Repeated rows are encoded each.
Columns other than doc_id and text play no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import extended, pieces
from strandwise.llm.tokens import PLAIN, WHITE, segments

LONG_WORD = 1024
#: Segments and words that a worker keeps, and rows of all steps of one recursive query at most.
KEPT_SEGMENTS = 250_000
KEPT_WORDS = 300_000
ROWS_A_QUERY = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every way to make a token of two others: (left id, right id, merged id)."""
    return [
        (ranks[token[:cut]], ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]


_ENCODE = """
WITH RECURSIVE step(word, pos, tok, next_pos, next_tok, merged, done) AS (
    SELECT f.word, f.pos, f.tok, f.next_pos, f.next_tok, m.merged, false
    FROM first_tokens f LEFT JOIN merges m ON m.left_tok = f.tok AND m.right_tok = f.next_tok
  UNION ALL (
    WITH chosen AS (
        SELECT word, min(merged * 65536::BIGINT + pos) AS best, arg_min(next_pos, merged * 65536::BIGINT + pos) AS gone
        FROM step WHERE NOT done GROUP BY word),
    placed AS (
        SELECT c.word, (c.best // 65536)::INTEGER AS made, (c.best % 65536)::INTEGER AS place, c.gone,
               g.next_pos AS after_pos, g.next_tok AS after_tok
        FROM chosen c LEFT JOIN step g ON g.word = c.word AND g.pos = c.gone),
    moved AS (
        SELECT s.word, s.pos, p.made IS NULL AS done,
               CASE WHEN s.pos = p.place THEN p.made ELSE s.tok END AS tok,
               CASE WHEN s.pos = p.place THEN p.after_pos ELSE s.next_pos END AS next_pos,
               CASE WHEN s.pos = p.place THEN p.after_tok WHEN s.next_pos = p.place THEN p.made
                    ELSE s.next_tok END AS next_tok
        FROM step s JOIN placed p ON s.word = p.word WHERE s.pos IS DISTINCT FROM p.gone)
    SELECT v.word, v.pos, v.tok, v.next_pos, v.next_tok, m.merged, v.done
    FROM moved v LEFT JOIN merges m ON m.left_tok = v.tok AND m.right_tok = v.next_tok)
)
SELECT word, array_to_string(list(tok ORDER BY pos), ',') AS ids FROM step WHERE done GROUP BY word
"""

_DECODE = """
SELECT t.word, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM id_rows t JOIN vocabulary v ON v.tok = t.tok GROUP BY t.word
"""


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of neighbouring pairs, for words too long for the query."""
    part = [word[i : i + 1] for i in range(len(word))]
    after = [*range(1, len(part)), -1]
    before = [-1, *range(len(part) - 1)]
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p is not None]


class Codec:
    """Ranks and pattern with their DuckDB tables; one for each worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.words_of = regex.compile(white).findall
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        names = ["left_tok", "right_tok", "merged"]
        merges = pa.table([pa.array(c, pa.int32()) for c in zip(*merge_table(self.ranks), strict=True)], names)
        tokens = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", tokens)):
            self.con.register("incoming", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.con.unregister("incoming")
        self.words: dict[str, tuple[str, bytes]] = {}
        self.kept: dict[str, tuple[str, bytes]] = {}

    def _query(self, sql: str, name: str, table: pa.Table) -> list[tuple]:
        self.con.register(name, table)
        rows = self.con.execute(sql).fetchall()
        self.con.unregister(name)
        return rows

    def encode_words(self, words: list[str]) -> dict[str, str]:
        """Comma-joined ids of each word."""
        out: dict[str, str] = {}
        queried: list[tuple[str, bytes]] = []
        for w in words:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                out[w] = str(rank)
            elif len(raw) > LONG_WORD:
                out[w] = ",".join(map(str, heap_merge(raw, self.ranks)))
            else:
                queried.append((w, raw))
        # Short words first, so that a query's words need about as many steps.
        queried.sort(key=lambda q: len(q[1]))
        size = np.array([len(raw) for _, raw in queried], np.int64)
        held = np.cumsum(size * (size + 1) // 2)
        at = 0
        while at < len(queried):
            stop = max(int(np.searchsorted(held, (held[at - 1] if at else 0) + ROWS_A_QUERY, "right")), at + 1)
            part, n = queried[at:stop], size[at:stop]
            token = self.base[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
            number, end = np.repeat(np.arange(len(part)), n), np.cumsum(n)
            place = np.arange(len(token)) - np.repeat(end - n, n)
            after, after_token = place + 1, np.append(token[1:], -1)
            after[end - 1] = after_token[end - 1] = -1
            names = ["word", "pos", "tok", "next_pos", "next_tok"]
            table = pa.table([pa.array(c.astype(np.int32)) for c in (number, place, token, after, after_token)], names)
            for i, ids in self._query(_ENCODE, "first_tokens", table):
                out[part[i][0]] = ids
            at = stop
        return out

    def decode_ids(self, joined: list[str]) -> list[bytes]:
        """Bytes of each comma-joined list of ids."""
        out = [b""] * len(joined)
        n = np.array([ids.count(",") + 1 if ids else 0 for ids in joined], np.int64)
        if not n.sum():
            return out
        token = np.array(",".join(filter(None, joined)).split(","), np.int32)
        end = np.cumsum(n)
        columns = np.repeat(np.arange(len(n)), n), np.arange(len(token)) - np.repeat(end - n, n), token
        table = pa.table([pa.array(c.astype(np.int32)) for c in columns], ["word", "pos", "tok"])
        for i, raw in self._query(_DECODE, "id_rows", table):
            out[i] = bytes(raw)
        return out

    def _cut(self, segment: str) -> list[str]:
        plain = PLAIN.fullmatch(segment)
        if plain is None:
            return self.words_of(segment)
        return [plain[1], plain[2]] if plain[2] else [plain[1]]

    def learn(self, new: set[str]) -> None:
        """Adds the ids and decoded bytes of segments to the tables; `forget` makes room again."""
        cut = {s: self._cut(s) for s in new}
        known = self.words
        unknown = list(set().union(*cut.values()).difference(known))
        ids = self.encode_words(unknown)
        joined = [ids[w] for w in unknown]
        known.update(zip(unknown, zip(joined, self.decode_ids(joined), strict=True), strict=True))
        for s, words in cut.items():
            if len(words) == 1:
                self.kept[s] = known[words[0]]
            else:
                own = [known[w] for w in words]
                self.kept[s] = (",".join([o[0] for o in own]), b"".join([o[1] for o in own]))

    def forget(self) -> None:
        """Drops the latest entries beyond the tables' bounds."""
        for table, most in ((self.words, KEPT_WORDS), (self.kept, KEPT_SEGMENTS)):
            while len(table) > most:
                table.popitem()

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Comma-joined ids and decoded bytes of each text."""
        cut = [segments(t) if t else [] for t in texts]
        kept = self.kept
        new = {s for own in cut for s in own if s not in kept}
        if new:
            self.learn(new)
        for own in cut:
            found = [kept[s] for s in own]
            yield ",".join([f[0] for f in found]), b"".join([f[1] for f in found])
        self.forget()


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`doc_id` with `ids` (comma-joined), `decoded` bytes, their digests and the number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                counts, ids_sha, decoded_sha = [], [], []
                for ids, raw in own.texts(part.column(text).to_pylist()):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(sha256(ids.encode()).hexdigest())
                    decoded_sha.append(sha256(raw).hexdigest())
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = extended(docs.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def token_lists(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`doc_id` and its ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                ids = [[int(x) for x in i.split(",")] if i else [] for i, _ in own.texts(part.column(text).to_pylist())]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    schema = extended(docs.select("doc_id"), "ids array<int>")
    return docs.select("doc_id", F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
