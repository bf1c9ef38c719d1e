"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database for each task.

The vocabulary is a rank file of a public tokenizer (never trained here).  A text is split by the tokenizer's
pattern; each distinct piece becomes rows (piece, position, token), at first one token for each byte.  A recursive
query joins neighbouring tokens with the merge table, contracts each piece's leftmost pair of the smallest rank,
and repeats until no piece has a pair left.  Decoding joins ids with the vocabulary and aggregates by position.
Pieces that a worker has met before are not sent again.

A piece longer than SHORT is contracted in many places at once.  Its positions fall into cells of twice the longest
token, and neighbouring cells with the same smallest rank form an island.  If no cell beside an island has a smaller
rank, nothing that is contracted elsewhere can reach its pairs of that rank before they are contracted, so all of
them are, from the left and without overlap (only the leftmost, where the new token could make a pair of a still
smaller rank).  The ids are those of one contraction at a time.  A single piece of more than WHOLE bytes, for which
the rows of one step don't fit a worker's share of memory, is contracted by a heap with the same result.

A query's rows are bounded: it takes QUERY_BYTES bytes of pieces (or one longer piece) and stops after so many
steps that it makes QUERY_ROWS rows at most; pieces that aren't done go on from there in a later query.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.rows import beside, column, trimmed

#: Bytes of the pieces sent to one recursive query, and rows that its steps make (28 bytes each).
QUERY_BYTES, QUERY_ROWS = 1 << 18, 1 << 21
#: The same rows for the query of long pieces, whose steps hold more at once.
LONG_ROWS = 1 << 17
#: Bytes up to which a piece is contracted by one pair a step; bytes of longer pieces sent to one query; bytes of the longest.
SHORT, LONG_BYTES, WHOLE = 256, 1 << 14, 1 << 15
#: DuckDB's limit in each worker.  A query of the size above takes a fraction of it.
MEMORY = "400MB"
#: Pieces, and bytes of them, that a worker remembers before it starts anew.
CACHE, CACHE_BYTES = 400_000, 32 << 20
#: Pieces whose ids are decoded by one query.
QUERY_PIECES = 20_000

# White space as the tokenizer's regular expressions know it (Unicode White_Space), whatever the engine's \s.
_SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

_LAST = """
SELECT piece, step, list(tok ORDER BY pos) AS ids, list(pos ORDER BY pos) AS places
FROM steps JOIN (SELECT piece, max(step) AS step FROM steps GROUP BY piece) USING (piece, step)
GROUP BY piece, step ORDER BY piece
"""

_ENCODE = """
WITH RECURSIVE steps(step, piece, pos, tok, nxt, prv) AS (
  SELECT 0, piece, pos, tok, lead(tok) OVER w, lag(pos) OVER w
  FROM symbols WINDOW w AS (PARTITION BY piece ORDER BY pos)
  UNION ALL
  SELECT step, piece, pos, tok, lead(tok) OVER w, lag(pos) OVER w
  FROM (
    SELECT s.step + 1 AS step, s.piece, s.pos, CASE WHEN s.pos = b.best & 4294967295 THEN (b.best >> 32)::INT ELSE s.tok END AS tok
    FROM steps s JOIN (
      -- the smallest rank, and of equal ones the leftmost position
      SELECT piece, min((m.rank::BIGINT << 32) | pos) AS best
      FROM steps JOIN merges m ON m.l = tok AND m.r = nxt WHERE step < {most} GROUP BY piece
    ) b ON s.piece = b.piece
    WHERE s.prv IS DISTINCT FROM b.best & 4294967295
  ) WINDOW w AS (PARTITION BY piece ORDER BY pos)
)""" + _LAST

_ENCODE_LONG = """
WITH RECURSIVE steps(step, piece, pos, tok) AS (
  SELECT 0, piece, pos, tok FROM symbols
  UNION ALL
  SELECT step + 1, piece, pos, CASE WHEN hit THEN rank ELSE tok END
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      -- every second pair of a run of overlapping ones, from its first
      SELECT *, least_here AND CASE WHEN safe THEN (n - max(CASE WHEN starts THEN n END) OVER (PARTITION BY piece ORDER BY pos)) % 2 = 0 ELSE pos = leftmost END AS hit
      FROM (
        SELECT *, NOT coalesce(lag(least_here) OVER (PARTITION BY piece ORDER BY pos), false) AS starts
        FROM (
          WITH pairs AS (
            SELECT p.*, pos // {reach} AS cell, m.rank, m.safe
            FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS n FROM steps WHERE step < {most} WINDOW w AS (PARTITION BY piece ORDER BY pos)) p
            LEFT JOIN merges m ON m.l = tok AND m.r = nxt
          ), cells AS (
            SELECT *, sum(edge::INT) OVER (PARTITION BY piece ORDER BY cell) AS island
            FROM (
              SELECT *, best >> 32 AS low, lag(best >> 32) OVER w AS before, lead(best >> 32) OVER w AS after, lag(best >> 32) OVER w IS DISTINCT FROM best >> 32 AS edge
              FROM (SELECT piece, cell, coalesce(min((rank::BIGINT << 32) | pos), 9223372032559808512) AS best FROM pairs GROUP BY ALL)
              WINDOW w AS (PARTITION BY piece ORDER BY cell)
            )
          ), islands AS (
            SELECT piece, island, min(low) AS low, min(best) & 4294967295 AS leftmost, bool_and(coalesce(before, low) >= low AND coalesce(after, low) >= low) AS lowest
            FROM cells GROUP BY ALL
          )
          SELECT p.*, i.leftmost, coalesce(p.rank = i.low AND i.lowest, false) AS least_here
          FROM pairs p JOIN cells USING (piece, cell) JOIN islands i USING (piece, island)
          WHERE piece IN (SELECT piece FROM pairs WHERE rank IS NOT NULL)
        )
      )
    )
  )
  WHERE gone IS NOT TRUE
)""" + _LAST

_DECODE = """
SELECT piece, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM tokens JOIN vocabulary v USING (tok) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, rank) of every way in which two tokens make a third."""
    found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = np.array(found, np.int32).reshape(-1, 3).T
    return left, right, rank


class Runs:
    """Many short arrays behind each other in one that grows."""

    def __init__(self, kind: type):
        self.values, self.ends, self.count = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, runs: list[np.ndarray]) -> None:
        """Appends at least one run to a list whose first run, number 0, is empty."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        first = int(self.ends[self.count])
        ends = first + np.cumsum(lengths)
        if ends[-1] > len(self.values):
            self.values = np.concatenate([self.values[:first], np.zeros(max(int(ends[-1]), 2 * len(self.values)) - first, self.values.dtype)])
        if self.count + len(runs) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(runs), len(self.ends)), np.int64)])
        self.values[first : ends[-1]] = np.concatenate(runs)
        self.ends[self.count + 1 : self.count + 1 + len(runs)] = ends
        self.count += len(runs)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The runs of these numbers (from 1), joined."""
        starts, ends = self.ends[numbers - 1], self.ends[numbers]
        lengths = ends - starts
        done = np.cumsum(lengths)
        return self.values[np.repeat(starts - done + lengths, lengths) + np.arange(int(done[-1]) if len(done) else 0)]


class Codec:
    """Encodes and decodes distinct pieces in a DuckDB database of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.reach = 2 * max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        left, right, rank = merge_table(ranks)
        tied = np.full(len(ranks) + max(ranks.values()), np.iinfo(np.int32).max)  # the smallest rank that a token has a part in
        for part in (left, right):
            np.minimum.at(tied, part, rank)
        self._table("merges_in", l=left, r=right, rank=rank, safe=tied[rank] > rank)
        self.db.execute("CREATE TABLE merges AS FROM merges_in")
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("vocabulary_in", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary_in")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # of each piece met, from 1
        self.ids, self.decoded = Runs(np.int32), Runs(np.uint8)

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.db.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [np.array([self.ranks[p]], np.uint32) if p in self.ranks else None for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i in rest:
            if len(pieces[i]) > WHOLE:
                out[i] = self._heap(pieces[i])
        for query, least, longest, size, rows in ((_ENCODE, 0, SHORT, QUERY_BYTES, QUERY_ROWS), (_ENCODE_LONG, SHORT, WHOLE, LONG_BYTES, LONG_ROWS)):
            todo = [(i, np.arange(len(pieces[i]), dtype=np.int32), self.single[np.frombuffer(pieces[i], np.uint8)]) for i in reversed(rest) if least < len(pieces[i]) <= longest]
            while todo:
                batch, held = [], 0
                while todo and (not batch or held + len(todo[-1][1]) <= size):
                    batch.append(todo.pop())
                    held += len(batch[-1][1])
                for i, pos, ids, done in self._contract(query, batch, max(2, rows // held)):
                    if done:
                        out[i] = ids.astype(np.uint32)
                    else:
                        todo.append((i, pos, ids))
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same contraction for one piece over WHOLE: pairs wait in a heap by (rank, position)."""
        token: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(piece) and (rank := self.ranks.get(token[i] + token[j])) is not None:
                heapq.heappush(heap, (rank, i, len(token[i]) + len(token[j])))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            if token[i] is None or (j := after[i]) >= len(piece) or len(token[i]) + len(token[j]) != size:
                continue
            token[i], token[j] = token[i] + token[j], None
            after[i] = after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[t] for t in token if t is not None], np.uint32)

    def _contract(self, query: str, batch: list[tuple[int, np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(number, positions, ids, whether nothing is left to contract) of each piece after at most so many steps."""
        lengths = [len(pos) for _, pos, _ in batch]
        self._table("symbols", piece=np.repeat(np.arange(len(batch), dtype=np.int32), lengths), pos=np.concatenate([pos for _, pos, _ in batch]), tok=np.concatenate([tok for _, _, tok in batch]))
        found = self.db.sql(query.format(reach=self.reach, most=most)).to_arrow_table().combine_chunks()
        ids, places = found["ids"].combine_chunks(), found["places"].combine_chunks()
        flat, at, ends = ids.values.to_numpy(), places.values.to_numpy(), ids.offsets.to_numpy()
        for (i, _, _), step, a, b in zip(batch, found["step"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield i, at[a:b].astype(np.int32), flat[a:b].astype(np.int32), step < most

    def decode_sequences(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids; an id that the vocabulary lacks raises ValueError."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate(sequences).astype(np.int32) if len(sequences) else np.zeros(0, np.int32)
        out = [b""] * len(sequences)
        if not len(flat):
            return out
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._table("tokens", piece=np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), pos=(np.arange(len(flat)) - starts).astype(np.int32), tok=flat)
        unknown = self.db.execute("SELECT count(*) FROM tokens ANTI JOIN vocabulary USING (tok)").fetchall()[0][0]
        if unknown:
            raise ValueError(f"{unknown} ids are not in the vocabulary")
        found = self.db.sql(_DECODE).to_arrow_table()
        for piece, text in zip(found["piece"].to_pylist(), found["hex"].to_pylist(), strict=True):
            out[piece] = bytes.fromhex(text)
        return out

    def pieces_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the numbers of its pieces; new pieces are encoded, and their ids decoded."""
        if len(self.number) > CACHE or self.decoded.ends[self.decoded.count] > CACHE_BYTES:
            self.forget()
        out, new = [], []
        for text in texts:
            pieces = self.split(text)
            numbers = np.empty(len(pieces), np.int64)
            known = self.number
            for i, piece in enumerate(pieces):
                at = known.get(piece)
                if at is None:
                    at = known[piece] = len(known) + 1
                    new.append(piece)
                numbers[i] = at
            out.append(numbers)
        for i in range(0, len(new), QUERY_PIECES):
            ids = self.encode_pieces([p.encode() for p in new[i : i + QUERY_PIECES]])
            self.ids.add(ids)
            self.decoded.add([np.frombuffer(b, np.uint8) for b in self.decode_sequences(ids)])
        return out


_codecs: dict[str, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """One codec for each Python worker and vocabulary."""
    name, ranks, pattern = shared.value
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


def _texts(column: pa.Array) -> list[str]:
    return [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in column]


def _runs(texts: list[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encode(batches: Iterator[pa.RecordBatch], shared: Broadcast, names: list[str]) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    for batch in batches:
        rest, row = batch.columns[:-1], 0
        for texts in _runs(_texts(batch.column(batch.num_columns - 1))):
            numbers = codec.pieces_of(texts)
            ids = [codec.ids.take(n) for n in numbers]
            decoded = [codec.decoded.take(n) for n in numbers] if "decoded_sha256" in names else []
            made = {
                "n_tokens": lambda ids=ids: pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": lambda ids=ids: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": lambda d=decoded: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in d], pa.string()),
                "ids": lambda ids=ids: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate(ids))),
            }
            yield pa.RecordBatch.from_arrays([*(c.slice(row, len(texts)) for c in rest), *(made[n]() for n in names)], names=[*batch.schema.names[:-1], *names])
            row += len(texts)


def _decode(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        decoded = codec.decode_sequences([np.array(x or [], np.uint32) for x in column.to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.binary())], names=[*batch.schema.names[:-1], "decoded"])


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The rank file at path, read on the driver.  Its size is that of the public vocabulary (some 50,000 entries)."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks, pattern))


def _apply(rows: DataFrame, function, source, keep: list[str], names: dict[str, str]) -> DataFrame:
    return beside(rows, [c for c in keep if c not in names], source, function, ", ".join(f"{k} {v}" for k, v in names.items()))


_KINDS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}


def encode(docs: DataFrame, shared: Broadcast, text_col: str = "text", keep_text: bool = True, want: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """docs with the wanted ones of n_tokens, ids (array<int>), ids_sha256 and decoded_sha256.

    A null or empty text has no ids.  Special tokens are ordinary text.  Rows that repeat are each encoded.  Columns
    of docs with these names are replaced; all others stay, the text only if asked.
    """
    rest = [c for c in docs.columns if keep_text or c != text_col]
    return _apply(docs, partial(trimmed(_encode), shared=shared, names=list(want)), column(text_col).cast("binary"), rest, {w: _KINDS[w] for w in want})


def decode(rows: DataFrame, shared: Broadcast, ids_col: str = "ids") -> DataFrame:
    """rows with the decoded bytes of their ids; null ids decode to nothing, an unknown id is an error."""
    return _apply(rows, partial(trimmed(_decode), shared=shared), column(ids_col).cast("array<int>"), rows.columns, {"decoded": "binary"})


def op4_duckdb_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each document."""
    import public_tokenizers

    shared = vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, shared, keep_text=False, want=("n_tokens", "ids_sha256", "decoded_sha256"))
