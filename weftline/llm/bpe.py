"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

Encoding: every distinct word of a slice of texts becomes token-position rows, byte by byte. A recursive query joins the
rows with the merge table, contracts each word's leftmost minimum-rank pair, and goes on until no word has a pair left.
Decoding: the token rows of each text join the vocabulary and an ordered aggregation joins their bytes.

Words repeat, so a worker keeps the ids of up to ``KEPT`` words; that changes the speed only. Two things shorten long words
without changing a token: no token holds two bytes that never stand side by side in the vocabulary, so words are cut
between such bytes; and where contracting a pair can't make a pair of a lower rank, a round contracts all of its places in a
word that don't overlap, from the left, which is what one round for each of them would come to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of

#: Bytes of a word from which a round contracts more than one place; work of a query (bytes squared); words that a worker
#: keeps; bytes of texts that are encoded together.
LONG, WORK, KEPT, SLICE = 48, 6_000_000, 1_000_000, 4 << 20

_ENCODE = """
WITH RECURSIVE s(it, g, w, t, nt, n) AS (
  SELECT 0::INT, g, w, t, nt, n FROM start
  UNION ALL
  SELECT s.it + 1, s.g, s.w, CASE WHEN s.g = h.g THEN h.merged ELSE s.t END,
         CASE WHEN s.g = h.g THEN h.nt WHEN s.n = h.g THEN h.merged ELSE s.nt END,
         CASE WHEN s.g = h.g THEN h.n ELSE s.n END
  FROM s JOIN (
    SELECT b.w, b.k & 4294967295 AS g, b.k >> 32 AS merged, b.q, x.nt, x.n
    FROM (SELECT s.w, min((m.merged << 32) | s.g) AS k, arg_min(s.n, (m.merged << 32) | s.g) AS q
          FROM s JOIN merges m ON m.pair = s.t * 4294967296 + s.nt GROUP BY s.w) b
    JOIN s x ON x.g = b.q) h ON s.w = h.w
  WHERE s.g <> h.q)
SELECT s.w, s.g, s.t FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) l ON s.w = l.w AND s.it = l.it ORDER BY s.g
"""
#: The same for long words. Only the last state of each position is kept; -1 marks positions that went into another token.
_ENCODE_LONG = """
WITH RECURSIVE s(g, w, t, nt, n) USING KEY (g) AS (
  SELECT g, w, t, nt, n FROM start
  UNION
  (WITH live AS (SELECT * FROM recurring.s WHERE t >= 0),
  pairs AS (SELECT l.w, l.g, l.n AS q, m.merged, m.sole FROM live l JOIN merges m ON m.pair = l.t * 4294967296 + l.nt),
  best AS (SELECT w, min(merged) AS merged FROM pairs GROUP BY w),
  places AS (SELECT p.*, coalesce(lag(p.q) OVER o <> p.g, true) AS first, row_number() OVER o AS i
             FROM pairs p JOIN best b ON b.w = p.w AND b.merged = p.merged WINDOW o AS (PARTITION BY p.w ORDER BY p.g)),
  runs AS (SELECT *, max(CASE WHEN first THEN i ELSE 0 END) OVER (PARTITION BY w ORDER BY g) AS since FROM places),
  chosen AS (SELECT * FROM runs WHERE CASE WHEN sole THEN i = 1 ELSE (i - since) % 2 = 0 END),
  moved AS (SELECT c.g, c.merged, x.nt, x.n FROM chosen c JOIN live x ON x.g = c.q),
  linked AS (
    SELECT l.g, l.w, CASE WHEN gone.q IS NOT NULL THEN -1 ELSE coalesce(m.merged, l.t) END AS t, m.g IS NOT NULL OR gone.q IS NOT NULL AS new,
           CASE WHEN m.g IS NOT NULL THEN m.nt ELSE l.nt END AS nt, CASE WHEN m.g IS NOT NULL THEN m.n ELSE l.n END AS n
    FROM live l LEFT JOIN moved m ON m.g = l.g LEFT JOIN chosen gone ON gone.q = l.g)
  SELECT l.g, l.w, l.t, coalesce(f.merged, l.nt), l.n FROM linked l LEFT JOIN chosen f ON f.g = l.n WHERE l.new OR f.g IS NOT NULL))
SELECT w, g, t FROM s WHERE t >= 0 ORDER BY g
"""
_DECODE = """
SELECT s.w, unhex(string_agg(v.hex, '' ORDER BY s.g)) AS bytes FROM tokens s JOIN vocabulary v ON v.t = s.t GROUP BY s.w
"""


class _Numbers(dict):
    """word -> number, in the order in which words come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class Tokenizer:
    """One rank file's merges and vocabulary in a DuckDB connection of this process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.apart = np.ones((256, 256), bool)  # bytes that stand side by side in no token
        pairs, merged, lower = [], [], set()
        for token, rank in ranks.items():
            self.apart[list(token[:-1]), list(token[1:])] = False
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) + b)
                    merged.append(rank)
                    lower.update(x for x in (a, b) if rank < x)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": "false"})
        # sole: the contraction can make a pair of a lower rank, so a round makes one of them in a word
        self._table("merges", pair=np.array(pairs, np.int64), merged=np.array(merged, np.int64), sole=np.array([r in lower for r in merged]))
        vocabulary = pa.table({"t": pa.array(ranks.values(), pa.int64()), "hex": [t.hex() for t in ranks]})
        self.con.register("given", vocabulary)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")
        self.decimals = [b"%d" % i for i in range(max(ranks.values()) + 1)]
        self.forget()

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def forget(self) -> None:
        """Drop the kept words: their numbers, and by number where their ids start and how many they are."""
        self.words, self.ids, self.used = _Numbers(), np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        flat, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        cut = np.zeros(len(flat) + 1, bool)  # where a part starts
        cut[1:-1] = self.apart[flat[:-1], flat[1:]]
        cut[ends - size] = cut[-1] = True
        places = np.flatnonzero(cut)
        first, n = places[:-1], np.diff(places)
        # parts of like length go together, as a query takes as many rounds as its longest part
        order = np.argsort(n, kind="stable")
        first, n = first[order], n[order]
        work = np.cumsum(n * n)
        long, at, found = int(np.searchsorted(n, LONG, side="right")), 0, []
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + WORK, side="right")))
            end = min(end, long) if at < long else end
            found.append(self._contract(flat, first[at:end], n[at:end], at >= long))
            at = end
        place, ids = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        order = np.argsort(place, kind="stable")
        return ids[order], np.bincount(np.searchsorted(ends, place, side="right"), minlength=len(words))

    def _contract(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token's first byte, token) of the parts of ``flat`` that start at ``first`` and have ``n`` bytes."""
        ends = np.cumsum(n)
        last, rows = ends - 1, np.arange(ends[-1])
        place = rows + np.repeat(first - (ends - n), n)
        tokens = self.bytes[flat[place]]
        following, link = np.append(tokens[1:], -1), rows + 1
        following[last], link[last] = -1, -1
        self.con.register("start", pa.table({"g": rows, "w": np.repeat(np.arange(len(n)), n), "t": tokens, "nt": following, "n": link}))
        out = self.con.sql(_ENCODE_LONG if long else _ENCODE).to_arrow_table()
        self.con.unregister("start")
        return place[out["g"].to_numpy()], out["t"].to_numpy()

    def decode_lists(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; ``ids`` holds the lists one after another."""
        lists = np.repeat(np.arange(len(counts)), counts)
        self.con.register("tokens", pa.table({"w": lists, "g": np.arange(len(ids)), "t": ids}))
        out = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("tokens")
        found = dict(zip(out["w"].to_pylist(), out["bytes"].to_pylist(), strict=True))
        return [found.get(i, b"") for i in range(len(counts))]

    def _learn(self) -> None:
        """Encode the words that have just got numbers."""
        new, self.words.new = self.words.new, []
        ids, counts = self.encode_words([w.encode() for w in new])
        before, total = len(self.words) - len(new), self.used + len(ids)
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < len(self.words):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : total] = ids
        self.start[before : before + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[before : before + len(new)] = counts
        self.used = total

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.words) > KEPT or self.words.new:  # the latter after a failure
            self.forget()
        words = [self.pattern.findall(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if self.words.new:
            self._learn()
        count = self.count[codes].astype(np.int64)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[codes] - (upto - count), count)]
        ends = np.append(0, upto)[np.cumsum(n)]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[list[str]]:
    """Lists of whole texts of about ``size`` characters together."""
    part: list[str] = []
    total = 0
    for text in texts:
        part.append(text.as_py())
        total += len(part[-1])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``ids`` (array<int>) and ``decoded`` (binary). Null texts count as empty: no ids, no bytes.

    ``path`` is a rank file that must be readable where tasks run; ``pattern`` splits text into words. Rows are independent:
    ids may be null or repeat, other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch["text"]):
                ids, counts = own.encode_texts(part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids))
                decoded = pa.array(own.decode_lists(ids, counts), pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(part)), lists, decoded], ["doc_id", "ids", "decoded"])
                at += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(kernel, f"doc_id {kind}, ids array<int>, decoded binary")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row its id and ``decoded`` (binary), the bytes of its ids; null and empty lists give no bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            flat = batch["ids"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([len(x) if x is not None else 0 for x in batch["ids"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own.decode_lists(flat, counts), pa.binary())], ["doc_id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document n_tokens, ids_sha256 and decoded_sha256, without handing the ids back to the JVM; null texts, ids, other
    columns and empty tables as with ``encode``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch["text"]):
                ids, counts = own.encode_texts(part)
                decimals, ends = list(map(own.decimals.__getitem__, ids.tolist())), np.cumsum(counts).tolist()
                coded = [hashlib.sha256(b" ".join(decimals[b - n : b])).hexdigest() for b, n in zip(ends, counts.tolist(), strict=True)]
                decoded = [hashlib.sha256(b).hexdigest() for b in own.decode_lists(ids, counts)]
                columns = [batch["doc_id"].slice(at, len(part)), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
