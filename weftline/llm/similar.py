"""N-gram Jaccard self-join by set-relation skipping.

Two documents link when their sets of word shingles have a Jaccard similarity of at least ``NUM`` / ``DEN``.

1. Documents with equal sets form a class; one representative goes on, so copies are never expanded into pairs.
2. Classes that share a sketch meet in chunks, and sets close to a leader form a group with it. Overlaps inside a chunk are
   derived from those of the set before by the difference, and a group's own links are settled there. From here on an item is
   a group, which stands for the union of its sets, or a single set.
3. Blocks of items exchange Golomb-coded tokens with owners of hash ranges and learn how many items hold each token. Rare
   tokens come first in every item; those of one item alone can't join anything and stay out of the index.
4. Prefixes go into index lists. A long list is split into parts that meet pairwise, each meeting in a place of its own. A
   list's entries lie in blocks by position: a block whose largest slack is below a probe's size is skipped, others allow
   sizes in an interval. Prefixes are so long that those of linked items share several tokens; pairs that meet in fewer lists
   are dropped, as chance pairs, which grow as the square of the input. Pairs of items come out, never pairs of their sets.
5. Pairs name cells: two chunks of similar items. A cell's sets meet in one task, in an order that puts similar sets beside
   each other, with overlaps derived as in 2. A cell reports link counts and a spanning forest, not pairs.
6. The forests' components are contracted by Spark joins.

Tokens are cut to ``BITS`` bits on the way through 3 and 4. An item knows how many of its tokens the cut merged and asks for
that much less overlap, so no link is lost; links are decided on 64-bit hashes of shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import golomb
from weftline.llm.common import components, discard, fresh, is_key, keep, keyed, release, slices, small, text_of

NUM, DEN = 60, 100
#: Sets of at least this similarity (in percent) to a leader join its group.
LEAD = 70
BITS, OWNED, BLOCK_BYTES, BLOCK_TOKENS = 40, 2_000_000, 8 << 20, 1 << 20
#: Bytes of text whose words are hashed at once, and bytes of a word from which on it is hashed alone.
AT_ONCE, LONG = 1 << 18, 64
#: Entries of a part of an index list; weight of a chunk and of what a task takes at once, a set weighing its tokens and EACH.
PART, CHUNK, BIN, EACH = 8192, 1 << 19, 1 << 20, 256
#: Candidate pairs expanded at once, and those that a task holds to drop those that come again.
EXPAND, HELD = 1 << 19, 1 << 20
#: Tokens that the prefixes of a linked pair share at least: 2 and one more for each LONGER of its overlap, SHARED at most.
LONGER, SHARED = 16, 12
_B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TURNS = np.array([1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = np.isin(np.arange(256), [*range(9, 14), 32])
_MOST = np.uint64((1 << 64) - 1)
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # keeps the first n bytes of eight
_SHARE = NUM / (NUM + DEN)  # a link shares at least this part of both sizes' sum
_TINY = 1e-9


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and 64-bit hashes of the words between white space, eight bytes of all words at a time. ``data`` begins with
    white space and ends with eight bytes of it at least."""
    space = _SPACES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out, some = sizes.astype(np.uint64), np.arange(len(first))
    with np.errstate(over="ignore"):
        for at in range(0, LONG, 8):
            x = out[some] * _B ^ eight[first[some] + at] & _LEFT[np.minimum(sizes[some] - at, 8)]
            x = (x ^ (x >> np.uint64(32))) * _MIX
            x = (x ^ (x >> np.uint64(32))) * _MIX
            out[some] = x ^ (x >> np.uint64(32))
            some = some[sizes[some] > at + 8]
            if not len(some):
                break
    for i in some.tolist():  # beyond LONG bytes
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + sizes[i]])
    return first, out


def shingles(texts: list[bytes], size: int = 2) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's shingles; one for all its words where there are fewer."""
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        some, total = [], 0
        while total < AT_ONCE and len(out) + len(some) < len(texts):
            some.append(texts[len(out) + len(some)])
            total += len(some[-1])
        ends = np.cumsum([len(t) + 1 for t in some]) + 1
        first, v = words(b" ".join([b"", *some, b" " * 8]).translate(_LOWER))
        n = max(0, len(v) - size + 1)
        with np.errstate(over="ignore"):
            runs = v[:n]
            for i in range(1, size):
                runs = runs * _B + v[i : i + n]
            runs = _mixed(runs)
            a = 0
            for b in np.searchsorted(first, ends).tolist():
                if 0 < b - a < size:
                    out.append(_mixed(np.array([xxhash.xxh3_64_intdigest(v[a:b].tobytes(), seed=b - a)], np.uint64)))
                else:
                    out.append(_once(np.sort(runs[a : max(a, b - size + 1)])))  # faster than np.unique
                a = b
    return out


def _once(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.append(True, ascending[1:] != ascending[:-1])[: len(ascending)]]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    out = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def cut(tokens: np.ndarray) -> np.ndarray:
    """Distinct tokens of ``BITS`` bits of ascending ones."""
    return _once(tokens >> np.uint64(64 - BITS))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set, none of them empty: for each of ``_TURNS`` the two least tokens under that turn, in one number. Similar sets
    are likely to share one."""
    sizes = np.array([len(s) for s in sets])
    tokens, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(_TURNS)), np.uint64)
    with np.errstate(over="ignore"):
        for i, turn in enumerate(_TURNS):
            turned = tokens * turn
            a = np.minimum.reduceat(turned, first)
            turned[turned == np.repeat(a, sizes)] = _MOST  # one token a set: the turns keep tokens distinct
            b = np.where(sizes > 1, np.minimum.reduceat(turned, first), a)
            out[:, i] = ((a * _B) ^ b) * _MIX
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def _overlap(least: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Tokens that a linked item shares at least: ``NUM`` / ``DEN`` of the smallest set, less what the cut merged."""
    return (NUM * least + DEN - 1) // DEN - lost


def shared(least: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """How many tokens of an item's prefix a linked item's prefix holds too, if it asks for as many itself; never more than
    their overlap."""
    overlap = _overlap(least, lost)
    return np.clip(np.minimum(2 + overlap // LONGER, overlap), 1, SHARED)


def prefix_length(size: np.ndarray, least: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """How many of an item's first tokens must hold the first ``shared`` ones of its overlap with a linked item."""
    return np.clip(size - _overlap(least, lost) + shared(least, lost), 0, size)


def linked(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return DEN * both >= NUM * (a + b - both)


def _signatures(size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"], BLOCK_BYTES):
                sets = shingles(texts, size)
                n = [len(s) for s in sets]
                marks = iter(sketches([s for s in sets if len(s)]).tolist() if any(n) else [])
                sig = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                columns = [pa.array(n, pa.int32()), sig, pa.array([next(marks) if x else None for x in n], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, len(texts)) for c in ("key", "doc_id")), *columns], ["key", "doc_id", "n", "sig", "marks"])
        release()

    return kernel


def _pack40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


_BLOCK = "block long, items array<long>, least array<int>, most array<int>, lost array<int>, sizes array<int>, tokens binary"


def _block(items: list[int], least: list[int], most: list[int], whole: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """One row: a block's name, its items with their least and greatest set sizes, tokens that the cut merged, and tokens."""
    sizes = np.array([len(s) for s in sets])
    name = xxhash.xxh3_64_intdigest(np.array(items, np.int64).tobytes()) >> 1
    lists = [least, most, (np.array(whole) - sizes).tolist(), sizes.tolist()]
    columns = [pa.array([name], pa.int64()), pa.array([items], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.int32())) for x in lists)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([_pack40(np.concatenate(sets))], pa.binary())], ["block", "items", "least", "most", "lost", "sizes", "tokens"])


def _single_blocks(size: int):
    """Kernel: blocks of single sets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"], BLOCK_BYTES):
                sets = shingles(texts, size)
                n = [len(s) for s in sets]
                yield _block(batch["key"].slice(at, len(texts)).to_pylist(), n, n, n, [cut(s) for s in sets])
        release()

    return kernel


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: blocks of groups, each as the union of its sets."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, np.ndarray]] = []
        total = 0
        for item, least, most, data in zip(*(batch[c] for c in ("item", "least", "most", "sets")), strict=True):
            n, m = np.frombuffer(data.as_buffer(), np.int32, 2)
            union = np.frombuffer(data.as_buffer(), np.uint64, n, 8 + 4 * m)
            rows.append((item.as_py(), least.as_py(), most.as_py(), len(union), cut(union)))
            total += len(union)
            if total >= BLOCK_TOKENS:
                yield _block(*map(list, zip(*rows, strict=True)))
                rows, total = [], 0
        if rows:
            yield _block(*map(list, zip(*rows, strict=True)))
    release()


def _ask(owners: int):
    """Kernel: each block's distinct tokens and how many of its items hold them, coded for their owners."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = golomb.bounds(owners, BITS)
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["tokens"], strict=True):
                values, counts = np.unique(_unpack40(data.as_py()), return_counts=True)
                counts = np.minimum(counts, 65535).astype(np.uint16)
                rows = [(o, block, b - a, *golomb.encode(values[a:b], int(first[o])), zlib.compress(counts[a:b].tobytes(), 1)) for o, a, b in golomb.split(values, owners, BITS)]
                names = ["owner", "block", "n", "width", "unary", "rest", "counts"]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return kernel


def _answer(owners: int):
    """Kernel: for each block's tokens a class of how many items hold them: 0 for one, else 1 and more, rising."""

    def kernel(table: pa.Table) -> pa.Table:
        release()  # what earlier groups needed
        first, rows = golomb.bounds(owners, BITS), table.to_pylist()
        sets = [golomb.decode(r["n"], int(first[r["owner"]]), r["width"], r["unary"], r["rest"]) for r in rows]
        counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.uint16) for r in rows])
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        total = np.bincount(inverse, counts)
        code = np.where(total <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 2) / 2)))).astype(np.uint8)[inverse]
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        coded = [zlib.compress(c.tobytes(), 1) for c in np.split(code, cuts)]
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "codes": pa.array(coded, pa.binary())})

    return kernel


_ENTRY = "token long, part int, parts int, item long, sizes long, left long"
_BAND = 8  # bits of a block of positions


def _two(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two small numbers in one, which compresses well."""
    return low.astype(np.int64) | (high.astype(np.int64) << 32)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: index entries of each item's prefix, without tokens that no other item holds: token, part of its list, number
    of parts, item, its least set size and what the greatest is more, how much overlap there is room for from here on, and the
    block of positions (from 2**block - 1 on) with the tokens to share above ``_BAND``. There is room for the shared tokens
    before this one, too. How common a token is bounds its list, and so says in how many parts it is split."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens = _unpack40(row["tokens"])
            item, least, most, lost, sizes = (np.array(row[c], np.int64) for c in ("items", "least", "most", "lost", "sizes"))
            values, inverse = np.unique(tokens, return_inverse=True)
            parts = sorted(row["answers"], key=lambda a: a["owner"])
            codes = np.frombuffer(b"".join(zlib.decompress(a["codes"]) for a in parts), np.uint8)
            if len(codes) != len(values):
                raise ValueError("answers don't fit their block")
            code = codes[inverse].astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((tokens, code, doc))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tokens, code = tokens[order], code[order]
            use = (place < prefix_length(sizes, least, lost)[doc]) & (code > 0)
            tokens, code, doc, place = tokens[use], code[use], doc[use], place[use]
            parts = np.ceil(2.0 ** (1 + code / 8) / PART).astype(np.int64)
            with np.errstate(over="ignore"):
                part = ((item[doc].view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % parts
            band = np.frexp(place + 1.0)[1] - 1
            ask = shared(least, lost)
            wide = [_two(least[doc], (most - least)[doc]), _two((sizes + lost + ask - 1)[doc] - place, band | (ask[doc] << _BAND))]
            columns = [tokens.view(np.int64), part.astype(np.int32), parts.astype(np.int32), item[doc], *wide]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _ENTRY.split(", ")])
    release()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, entry) for all entries from lo up to hi of each probe."""
    n = np.maximum(hi - lo, 0)
    probe = np.repeat(np.arange(len(lo)), n)
    return probe, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def probe_lists(group: np.ndarray, side: np.ndarray, item: np.ndarray, least: np.ndarray, most: np.ndarray, room: np.ndarray, band: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (places in the arrays) between entries of one group: within side 0 alone, or from side 0 to side 1.

    A link between sets of items with least sizes m and n shares at least ``_SHARE`` * (m + n) tokens, and each side has at
    most ``room`` left. So an entry's slack, room / _SHARE - n, bounds the m that it can answer. Entries lie in blocks of
    positions (``band``), sorted by least size; a block whose largest slack is below m is skipped, and in others one interval is read.
    """
    top, wide = int(band.max(initial=0)) + 1, int(least.max(initial=0)) + 2
    two = np.zeros(int(group.max(initial=-1)) + 1, bool)
    two[group[side == 1]] = True
    slack = np.floor(room / _SHARE - least + _TINY).astype(np.int64)
    own = np.flatnonzero(np.where(two[group], side == 1, True))
    own = own[np.argsort(((group * top + band) * wide + least)[own], kind="stable")]
    block = (group * top + band)[own]
    codes = block * wide + least[own]
    largest = np.full((len(two) + 1) * top, -1)
    np.maximum.at(largest, block, slack[own])
    spread = float((most / np.maximum(least, 1)).max(initial=1.0))
    probes = np.flatnonzero(side == 0)
    for b in range(top):
        blocks = group[probes] * top + b
        some = np.flatnonzero(largest[blocks] >= least[probes])
        if not len(some):
            continue
        p, base = probes[some], blocks[some] * wide
        low = np.ceil(NUM * least[p] / DEN / spread - _TINY).astype(np.int64)
        high = np.minimum(np.floor(DEN * most[p] / NUM + _TINY).astype(np.int64), slack[p])
        lo = np.searchsorted(codes, base + np.clip(low, 0, wide - 1))
        hi = np.searchsorted(codes, base + np.clip(high, -1, wide - 1), side="right")
        upto = np.cumsum(np.maximum(hi - lo, 0))
        at = 0
        while at < len(p):
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + EXPAND, side="right")))
            probe, entry = _ranges(lo[at:end], hi[at:end])
            i, j = p[at:end][probe], own[entry]
            need = _SHARE * (least[i] + least[j]) - _TINY
            ok = (room[i] >= need) & (room[j] >= need) & (NUM * least[i] <= DEN * most[j]) & (NUM * least[j] <= DEN * most[i])
            ok &= (item[i] != item[j]) & (two[group[i]] | (item[i] < item[j]))
            if ok.any():
                yield i[ok], j[ok]
            at = end


class _Pairs:
    """Distinct pairs of numbers with how often they came and how often they have to; while pairs are compared, each is one
    64-bit code of two local numbers."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> None:
        self.parts.append(self._distinct(np.minimum(a, b), np.maximum(a, b), need, np.ones(len(a), np.int64)))
        self.n += len(self.parts[-1])

    @staticmethod
    def _distinct(a: np.ndarray, b: np.ndarray, need: np.ndarray, times: np.ndarray) -> np.ndarray:
        ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        _, first, same = np.unique(inverse[: len(a)] * len(ids) + inverse[len(a) :], return_index=True, return_inverse=True)
        return np.stack([a[first], b[first], need[first], np.bincount(same, times, len(first)).astype(np.int64)], axis=1)

    def merge(self) -> None:
        pairs = np.concatenate(self.parts)
        self.parts = [self._distinct(*pairs.T)]
        self.n = len(self.parts[0])

    def flush(self) -> pa.RecordBatch:
        pairs = np.concatenate(self.parts) if self.parts else np.zeros((0, 4), np.int64)
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], ["a", "b", "need", "times"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: rows are entries of index lists, or of two parts of one, in the order of their list. Pairs that come again
    within ``HELD`` pairs of a partition are added up before they are shuffled."""
    names, low = ("token", "meeting", "item", "sizes", "left"), np.int64((1 << 32) - 1)
    held = _Pairs()
    rest = {c: np.zeros(0, np.int64) for c in names}

    def search(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, meeting, item, sizes, left = (columns[c] for c in names)
        new = np.append(True, (token[1:] != token[:-1]) | (meeting[1:] >> 1 != meeting[:-1] >> 1))[: len(token)]
        least, ask = sizes & low, left >> 32 + _BAND
        band = (left >> 32) & ((1 << _BAND) - 1)
        for i, j in probe_lists(np.cumsum(new) - 1, meeting & 1, item, least, least + (sizes >> 32), left & low, band):
            held.add(item[i], item[j], np.minimum(ask[i], ask[j]))
            if held.n > HELD:
                held.merge()
                if held.n > HELD // 2:
                    yield held.flush()

    for batch in batches:
        columns = {c: np.concatenate([rest[c], batch[c].to_numpy(zero_copy_only=False)]) for c in names}
        if not len(columns["token"]):
            continue
        last = (columns["token"] == columns["token"][-1]) & (columns["meeting"] >> 1 == columns["meeting"][-1] >> 1)
        n = int(np.count_nonzero(~last))  # the last list may go on in the next batch
        rest = {c: columns[c][n:] for c in names}
        yield from search({c: columns[c][:n] for c in names})
    yield from search(rest)
    if held.n:
        held.merge()
        yield held.flush()
    release()


def candidates(entries: DataFrame) -> DataFrame:
    """Distinct pairs a < b of items that pass the length and position filters at as many shared tokens as both ask for.

    Each entry of a list of n parts goes to the n meetings of its part with all parts, and a meeting is a list of its own.
    """
    met = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other").cast("long"), F.greatest("part", "other").cast("long")
    # both parts' numbers and the side in one: 0 for lists of one part
    meeting = F.shiftleft(low, 32) + F.shiftleft(high, 1) + (F.col("part") > F.col("other")).cast("long")
    met = met.select("token", meeting.alias("meeting"), "item", "sizes", "left")
    lists = met.repartition("token", F.shiftright("meeting", 1)).sortWithinPartitions("token", "meeting")
    found = lists.mapInArrow(_candidates, "a long, b long, need long, times long").groupBy("a", "b")
    return found.agg(F.max("need").alias("need"), F.sum("times").alias("times")).where("times >= need").select("a", "b")


def overlaps(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Each row follows from the row before it: tokens gone and tokens new."""
    values, flat = np.unique(np.concatenate(other), return_inverse=True)
    who = np.repeat(np.arange(len(other)), [len(s) for s in other])
    order = np.argsort(flat, kind="stable")
    who, bound = who[order], np.searchsorted(flat[order], np.arange(len(values) + 1))
    out = np.zeros((len(own), len(other)), np.int32)
    before, row = np.zeros(0, np.int64), np.zeros(len(other), np.int64)

    def add(ids: np.ndarray) -> np.ndarray:
        _, at = _ranges(bound[ids], bound[ids + 1])
        return np.bincount(who[at], minlength=len(other))

    for i, s in enumerate(own):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        ids = at[values[at] == s]
        new = np.setdiff1d(ids, before, assume_unique=True)
        if len(new) * 2 < len(ids):
            row = row + add(new) - add(np.setdiff1d(before, ids, assume_unique=True))
        else:
            row = add(ids)
        out[i], before = row, ids
    return out


def related(sets: list[np.ndarray]) -> bytes:
    """Sets in bytes by their relation to the first: all distinct tokens, then the first set and what each other one has more
    or less than it."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat.astype(np.int32), np.cumsum([len(s) for s in sets])[:-1])
    parts = [parts[0], *(np.setxor1d(parts[0], p, assume_unique=True) for p in parts[1:])]
    sizes = np.array([len(values), len(parts), *(len(p) for p in parts)], np.int32)
    return b"".join([sizes.tobytes(), values.tobytes(), *(p.tobytes() for p in parts)])


def unrelated(data: pa.Buffer | bytes) -> list[np.ndarray]:
    """Inverse of ``related``."""
    n, m = np.frombuffer(data, np.int32, 2)
    sizes = np.frombuffer(data, np.int32, m, 8)
    values = np.frombuffer(data, np.uint64, n, 8 + 4 * m)
    first, *others = np.split(np.frombuffer(data, np.int32, int(sizes.sum()), 8 + 4 * m + 8 * n), np.cumsum(sizes)[:-1])
    return [values[first], *(values[np.setxor1d(first, x, assume_unique=True)] for x in others)]


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal rows."""
    n = len(columns[0])
    new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if n > 1 else np.zeros(0, np.int64)
    return zip([0, *new.tolist()] if n else [], [*new.tolist(), n] if n else [], strict=True)


_GROUP = "item long, least int, most int, weight long, keys array<long>, copies array<long>, links array<long>, sets binary"


def _grouped(table: pa.Table) -> pa.Table:
    """Kernel: groups of the sets of each chunk. A leader is the free set that is close to the most others, and takes those
    that are free; a set close to none is a group of its own. ``links`` count inside the group, weighted by copies."""
    release()  # what earlier groups needed
    table = table.sort_by([("chunk", "ascending"), ("key", "ascending")])
    chunk, keys, copies = (table[c].to_numpy() for c in ("chunk", "key", "copies"))
    rows = []
    for first, end in _runs(chunk):
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table["tokens"].slice(first, end - first)]
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:3].tolist(), i))
        sets, key, weight = [sets[i] for i in order], keys[first:end][order], copies[first:end][order]
        n, both = np.array([len(s) for s in sets]), overlaps(sets, sets)
        union = n[:, None] + n[None, :] - both
        close, link = 100 * both.astype(np.int64) >= LEAD * union, DEN * both.astype(np.int64) >= NUM * union
        np.fill_diagonal(link, False)
        free = np.ones(len(sets), bool)
        for leader in np.argsort(-close.sum(axis=1), kind="stable").tolist():
            if free[leader]:
                free[leader] = False
                mine = np.append(leader, np.flatnonzero(close[leader] & free))
                free[mine] = False
                sizes, links = n[mine], link[np.ix_(mine, mine)] @ weight[mine]
                rows.append((int(key[leader]), int(sizes.min()), int(sizes.max()), int(sizes.sum() + EACH * len(mine)), key[mine], weight[mine], links, related([sets[i] for i in mine])))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _GROUP.split(", ")])


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least item that links reach from each of ``n`` items; rows of ``link`` belong to items a, columns to items b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, np.where(link, root[b][None, :], n).min(axis=1, initial=n))
        np.minimum.at(new, b, np.where(link, root[a][:, None], n).min(axis=0, initial=n))
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _cells(table: pa.Table) -> pa.Table:
    """Kernel: per cell the links of its sets to sets of other items, weighted by copies, and a spanning forest of the items."""
    release()  # what earlier groups needed
    table = table.sort_by([("low", "ascending"), ("high", "ascending"), ("item", "ascending")])
    low, high, sides, items = (table[c].to_numpy() for c in ("low", "high", "side", "item"))
    out = []
    for first, end in _runs(low, high):
        sets, key, copies, item = [], [], [], []
        for i in range(first, end):
            sets += unrelated(table["sets"][i].as_buffer())
            key += table["keys"][i].as_py()
            copies += table["copies"][i].as_py()
            item += [i - first] * (len(sets) - len(item))
        names, own_side = items[first:end], sides[first:end]
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:3].tolist(), i))
        sets, key, copies, item = [sets[i] for i in order], np.array(key)[order], np.array(copies)[order], np.array(item)[order]
        n, side = np.array([len(s) for s in sets]), own_side[item]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(b)
        b = a if within else b
        both = overlaps([sets[i] for i in a], [sets[i] for i in b]).astype(np.int64)
        link = linked(n[a][:, None], n[b][None, :], both)
        if within:
            link &= item[a][:, None] != item[b][None, :]
        counts = np.zeros(len(sets), np.int64)
        counts[a] += link @ copies[b]
        if not within:
            counts[b] += link.T @ copies[a]
        root = names[_forest(link, item[a], item[b], end - first)]
        some = np.flatnonzero(counts)
        out.append((key[some], counts[some], names[item[some]], root[item[some]]))
    return pa.table([pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i in range(4)], names=["key", "links", "item", "root"])


def _full_sets(size: int, *names: str, alone: bool = False):
    """Kernel: each text's tokens, with the named columns; ``alone``: as ``sets`` of one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"], BLOCK_BYTES):
                found = shingles(texts, size)
                data = pa.array([related([s]) if alone else s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, len(texts)) for c in names), data], [*names, "sets" if alone else "tokens"])
        release()

    return kernel


def similar(docs: DataFrame, size: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles, n_similar, component_id.

    Words are lower-cased (A-Z) and lie between ASCII white space; a text of fewer than ``size`` words is one shingle. Null
    texts and texts without words have no shingles, link with nothing and are their own component. Rows are documents, so
    repeated rows link with each other; a component's id is its smallest id that isn't null. Other columns are ignored; an
    empty table gives an empty result.
    """
    return decided(keyed(docs, id_col, text_col), size).select("doc_id", "n_shingles", "n_similar", "component_id")


def _crowds(classes: DataFrame) -> DataFrame:
    """(key, copies, chunk) of the classes that share a sketch with another: each goes to the commonest of its sketches, and a
    sketch that many share is split into chunks by hash."""
    each = classes.select("key", "n", "copies", F.posexplode("marks").alias("turn", "mark"))
    common = each.groupBy("turn", "mark").count().where("count > 1")
    chosen = each.join(common, ["turn", "mark"]).groupBy("key").agg(F.max(F.struct("count", -F.col("turn"), "mark", "n", "copies")).alias("best"))
    chosen = keep(chosen.select("key", "best.n", "best.copies", F.xxhash64("best.col2", "best.mark").alias("bucket")), "chosen")
    weights = chosen.groupBy("bucket").agg(F.count("*").alias("members"), F.ceil(F.sum(F.col("n") + EACH) / CHUNK).alias("parts")).where("members > 1").drop("members")
    return chosen.join(weights, "bucket").select("key", "n", "copies", F.xxhash64("bucket", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("chunk"))


def _bins(weight: int | None) -> int:
    return max(1, -(-(weight or 0) // BIN))


def decided(rows: DataFrame, size: int = 2) -> DataFrame:
    """What ``similar`` tells of each row of key, doc_id, text, with its key and ``stays``: whether it is its component's
    first row by id, nulls last, and then by key."""
    signed = keep(rows.select("key", "doc_id", "text").mapInArrow(_signatures(size), "key long, doc_id long, n int, sig binary, marks array<long>"), "signatures")
    some = signed.where("sig is not null")
    classes = some.groupBy("sig").agg(F.min("key").alias("key"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")).alias("least"), F.count("*").alias("copies"), F.min(F.struct("n", "marks")).alias("s"))
    classes = keep(classes.select("sig", "key", "least", "copies", "s.n", "s.marks"), "classes")
    crowds = keep(_crowds(classes), "crowds")
    # rows that aren't single sets: those that another represents or that have no words, and those in crowds
    copies = some.join(classes.select("key"), "key", "left_anti").select("key").unionByName(signed.where("sig is null").select("key"))
    none = F.lit(None).cast("long")
    special = copies.select("key", none.alias("chunk"), none.alias("copies")).unionByName(crowds.select("key", "chunk", "copies"))
    special = keep(special.withColumn("special", F.lit(True)), "special")
    texts = rows.select("key", "text")
    if small(special):  # where they are few, a broadcast spares the shuffle of all texts
        placed = texts.join(F.broadcast(special), "key", "left")
    else:  # sorted, so that a partition made again is cut into the same blocks
        placed = texts.join(special, "key", "left").sortWithinPartitions("key")
    sets = placed.where("chunk is not null").select("key", "chunk", "copies", "text")
    sets = sets.mapInArrow(_full_sets(size, "key", "chunk", "copies"), "key long, chunk long, copies long, tokens binary")
    bins = _bins(crowds.agg(F.sum(F.col("n") + EACH)).first()[0])
    groups = keep(sets.withColumn("bin", F.pmod(F.xxhash64("chunk"), F.lit(bins))).groupBy("bin").applyInArrow(_grouped, _GROUP), "groups")
    total = classes.agg(F.sum("n")).first()[0] or 0
    owners = max(1, -(-total // OWNED))
    # one shuffle of the blocks serves both their questions and the join with the answers: the plans are equal up to it
    blocks = placed.where("special is null").select("key", "text").mapInArrow(_single_blocks(size), _BLOCK)
    blocks = blocks.unionByName(groups.select("item", "least", "most", "sets").mapInArrow(_group_blocks, _BLOCK)).where("block is not null").repartition("block")
    asked = blocks.mapInArrow(_ask(owners), "owner int, block long, n int, width int, unary binary, rest binary, counts binary")
    answers = asked.groupBy("owner").applyInArrow(_answer(owners), "block long, owner int, codes binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "codes")).alias("answers"))
    entries = blocks.join(answers.hint("shuffle_hash"), "block").mapInArrow(_prefixes, _ENTRY)
    pairs = keep(candidates(entries), "pairs")
    discard(special, crowds)
    cells = _verified(texts, classes, groups, pairs, size)
    discard(pairs)
    inside = groups.select("item", F.explode(F.arrays_zip("keys", "links")).alias("m")).select(F.col("m.keys").alias("key"), F.col("m.links").alias("links"), "item")
    sums = inside.select("key", "links").unionByName(cells.select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    edges = inside.select(F.col("key").alias("a"), F.col("item").alias("b")).unionByName(cells.select(F.col("item").alias("a"), F.col("root").alias("b")))
    found = classes.join(sums, "key", "left").join(components(edges).withColumnRenamed("node", "key"), "key", "left")
    found = found.select("sig", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    smallest = found.groupBy("component").agg(F.min("least").alias("first"))
    found = found.join(smallest, "component").select("sig", (F.col("links") + F.col("copies") - 1).alias("n_similar"), "first")
    # a class of very many copies must not meet in one task: rows go by (class, salt), answers to every salt in use
    salted = signed.drop("marks").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)).cast("int"))
    spots = salted.where("sig is not null").select("sig", "salt").distinct().join(found, "sig")
    done = salted.join(spots, ["sig", "salt"], "left")
    return done.select(
        "key",
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (F.col("sig").isNull() | (F.col("first.key") == F.col("key"))).alias("stays"),
    )


def _verified(texts: DataFrame, classes: DataFrame, groups: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(key, links, item, root) of the cells that hold the candidate pairs of items."""
    # chunks: the smallest neighbour leads, and a heavy leader's followers are split by hash
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leaders = sides.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("item"), F.least("a", "b").alias("leader"))
    alone = classes.select(F.col("key").alias("item"), (F.col("n") + EACH).cast("long").alias("weight"), "copies")
    heavy = groups.select("item", F.col("weight").alias("group_weight"))
    leaders = leaders.join(alone, "item").join(heavy, "item", "left").withColumn("grouped", F.col("group_weight").isNotNull()).withColumn("weight", F.coalesce("group_weight", "weight")).drop("group_weight")
    leaders = keep(leaders, "leaders")
    weights = leaders.groupBy("leader").agg(F.ceil(F.sum("weight") / CHUNK).alias("parts"))
    chunks = keep(leaders.join(weights, "leader").select("item", "weight", "copies", "grouped", F.xxhash64("leader", F.pmod(F.xxhash64("item"), F.col("parts"))).alias("chunk")), "chunks")
    one = chunks.select(F.col("item").alias("a"), F.col("chunk").alias("ca"), F.col("weight").alias("wa"))
    two = chunks.select(F.col("item").alias("b"), F.col("chunk").alias("cb"), F.col("weight").alias("wb"))
    placed = pairs.join(one, "a").join(two, "b").withColumns({"low": F.least("ca", "cb"), "high": F.greatest("ca", "cb")})
    place = lambda k, c, w: placed.select(F.col(k).alias("item"), "low", "high", (F.col(c) != F.col("low")).cast("int").alias("side"), F.col(w).alias("weight"))
    members = keep(place("a", "ca", "wa").unionByName(place("b", "cb", "wb")).distinct(), "members")
    bins = _bins(members.agg(F.sum("weight")).first()[0])
    single = chunks.where("not grouped").select(F.col("item").alias("key"), F.array("item").alias("keys"), F.array("copies").alias("copies"))
    if small(single):
        wanted = texts.join(F.broadcast(single.select("key")), "key", "left_semi")
    else:
        wanted = texts.join(single.select("key"), "key", "left_semi")
    sets = wanted.mapInArrow(_full_sets(size, "key", alone=True), "key long, sets binary").join(single, "key").select(F.col("key").alias("item"), "keys", "copies", "sets")
    sets = sets.unionByName(groups.join(chunks.where("grouped").select("item"), "item").select("item", "keys", "copies", "sets"))
    cells = members.drop("weight").join(sets, "item").withColumn("bin", F.pmod(F.xxhash64("low", "high"), F.lit(bins)))
    found = keep(cells.groupBy("bin").applyInArrow(_cells, "key long, links long, item long, root long"), "links")
    discard(leaders, chunks, members)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component one row, the first with its smallest id, and
    all rows without words. Rows are decided one by one, also where ids are null or repeat."""
    key, row, out = F.col("doc_id").cast("long"), fresh(docs, "__row"), fresh(docs, "__out")
    if not is_key(docs, "doc_id"):
        docs, key = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), F.col(row)
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    gone = keep(decided(rows).where("not stays").select(F.col("key").alias(out)), "gone")
    if small(gone):
        gone = F.broadcast(gone)
    return docs.join(gone, key == F.col(out), "left_anti").drop(row)
