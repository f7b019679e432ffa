"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from cases import no_docs, odd_docs, rows

from weftline.llm import similar
from weftline.llm.common import components


def plain(pairs, size=2):
    sets = []
    for _, text in pairs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in lower.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    n = len(sets)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [pairs[j][0] for j in seen if pairs[j][0] is not None]
        out.append((pairs[i][0], len(sets[i]), len(links[i]), min(ids, default=None)))
    return out


def run(docs, **more):
    return sorted(map(repr, map(tuple, similar.similar(docs, **more).collect())))


def test_odd_rows(spark):
    assert run(odd_docs(spark)) == sorted(map(repr, plain([r[:2] for r in rows()])))
    assert similar.similar(no_docs(spark)).count() == 0


def family_texts(n=260, seed=4):
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(30)) for _ in range(draw.randrange(1, 80))] for _ in range(25)]
    out = []
    for _ in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 5, 10, 20])):
            words[draw.randrange(len(words))] = "x" + str(draw.randrange(50))
        out.append(" ".join(words[draw.choice([0, 0, 0, 3]) :]))
    return out


@pytest.mark.parametrize("part,chunk", [(8192, 1 << 19), (3, 2000)])
def test_families(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "CHUNK", chunk)
    pairs = list(enumerate(family_texts()))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert run(docs) == sorted(map(repr, plain(pairs)))


@pytest.mark.parametrize("bits", [40, 8])
def test_cut_tokens_lose_no_link(spark, monkeypatch, bits):
    """With 8 bits most tokens of a set collide; what the cut merges is asked for less, so all links are found."""
    monkeypatch.setattr(similar, "BITS", bits)
    pairs = list(enumerate(family_texts(120, seed=9)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert run(docs) == sorted(map(repr, plain(pairs)))


def test_a_token_in_very_many_sets(spark, monkeypatch):
    """20,000 pairs of words share one shingle, as rare as all else that they share: its list is split into parts."""
    monkeypatch.setattr(similar, "PART", 512)
    texts = [f"same words x{i} y{i}" for i in range(20_000)] + ["same words", "same words again", "SAME words again", "same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in similar.similar(docs).collect()}
    assert [out[i] for i in range(20_000, 20_004)] == [(1, 1, 20_000), (2, 1, 20_001), (2, 1, 20_001), (1, 1, 20_000)]
    assert all(out[i] == (3, 0, i) for i in range(20_000))


def test_pairs_of_a_list_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(similar, "EXPAND", 1000)
    n = 300
    whole = np.full(n, 20)
    found = list(similar.probe_lists(np.zeros(n, int), np.zeros(n, int), np.arange(n), whole, whole, whole, np.zeros(n, int)))
    assert len(found) > 40 and max(len(i) for i, _ in found) <= 1000
    assert {(int(a), int(b)) for i, j in found for a, b in zip(i, j, strict=True)} == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_chance_pairs_are_no_candidates(spark, monkeypatch):
    """Any two texts share a rare shingle or two by chance; such pairs were candidates, and grow as the square of the input."""
    draw = random.Random(3)
    texts = [[f"w{draw.randrange(60)}" for _ in range(60)] for _ in range(300)]
    texts += [[*t[:50], f"v{i}", *t[51:]] for i, t in enumerate(texts[:20])] + [[*t[:20], *t[32:]] for t in texts[20:40]]
    seen, keep = {}, similar.keep

    def kept(df, name, *more):
        seen[name] = keep(df, name, *more)
        if name == "pairs":
            seen["n"] = seen[name].count()
        return seen[name]

    monkeypatch.setattr(similar, "keep", kept)
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(spark.createDataFrame(pairs, "doc_id long, text string")) == sorted(map(repr, plain(pairs)))
    assert seen["n"] < 50


def test_linked_prefixes_share_what_both_ask_for():
    """Sets in one order of tokens, at the threshold and above it, with sizes of their own."""
    draw = np.random.default_rng(8)
    for _ in range(2000):
        n = int(draw.integers(1, 120))
        both = np.sort(draw.choice(400, n, replace=False))
        left = int(n * similar.DEN / similar.NUM + 1e-9) - n
        more = int(draw.integers(0, left + 1))
        rest = draw.permutation(np.setdiff1d(np.arange(400), both))
        a, b = (np.sort(np.append(both, x)) for x in (rest[:more], rest[more:left]))
        sizes, none = np.array([len(a), len(b)]), np.zeros(2, int)
        ask = similar.shared(sizes, none)
        p, q = similar.prefix_length(sizes, sizes, none)
        assert len(np.intersect1d(a[:p], b[:q])) >= min(ask) >= 1


def test_related_sets_come_back():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 2**63, 50)).astype(np.uint64)
    sets = [base, base[:40], np.unique(np.append(base[5:], draw.integers(0, 2**63, 9).astype(np.uint64))), base[:1]]
    assert [s.tolist() for s in similar.unrelated(similar.related(sets))] == [s.tolist() for s in sets]


def test_threshold_ties(spark):
    # 6 of 10 shingles shared links, 6 of 11 doesn't; one-word texts link with themselves alone
    a = "a b c d e f g p q"
    texts = [a, "a b c d e f g x y", "a b c d e f g x y z", "one", "one", "two", "ONE", "", None]
    pairs = list(enumerate(texts))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    want = plain(pairs)
    assert want[0][2] == 1 and want[0][1] == 8
    assert run(docs) == sorted(map(repr, want))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs) == sorted(map(repr, plain([(r.doc_id, r.text) for r in docs.collect()])))


def test_overlaps_follow_from_the_row_before():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 500, 200)).astype(np.uint64)
    sets = [np.unique(np.where(draw.random(len(base)) < 0.05, draw.integers(0, 900, len(base)).astype(np.uint64), base)) for _ in range(30)]
    sets += [np.unique(draw.integers(0, 2000, int(n))).astype(np.uint64) for n in draw.integers(1, 300, 10)]
    assert similar.overlaps(sets, sets[::2]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[::2]] for a in sets]


def test_one_of_each(spark):
    pairs = list(enumerate(family_texts(60)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in pairs], "doc_id long, text string, component_id int")
    left = similar.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _, _, c in plain(pairs) if i == c}
    assert similar.one_of_each(no_docs(spark)).count() == 0


def test_one_of_each_decides_row_by_row(spark):
    """Nulls and repeated ids: a row goes only if it links itself, and one row of each component stays."""
    a, b, c = ("a b c d e f g p q", "a b c d e f g x y"), "h i j k l m n", "r s t u v w z"
    linked, alone = [(None, a[0]), (1, a[1])], [(None, "only this one text"), (None, ""), (None, None)]
    repeated = [(5, b), (5, "unlike all others here"), (2, b), (7, c), (7, c), (None, "o p o p q"), (None, "o p o p q")]
    pairs = linked + alone + repeated
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(pairs)], "doc_id long, text string, n int")
    left = similar.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted((repr(r.doc_id), repr(r.text)) for r in left.collect())
    want = [(1, a[1]), *alone, (5, "unlike all others here"), (2, b), (7, c), (None, "o p o p q")]
    assert got == sorted((repr(i), repr(t)) for i, t in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100} or {k: v for k, v in got.items() if k != v} == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_words_of_many_texts_are_hashed_together():
    """Each text's words were looked up one by one, in three passes over all texts; same sets as one text alone or plain tuples."""
    draw = random.Random(2)
    long = [b"x" * n + end for n in (7, 8, 9, 63, 64, 65, 200_000) for end in (b"", b"y", b"\0", b" y")]
    texts = [b"", b" ", b"a", b"A", b"a b", b"\0", b"\0\0", b"a\0 b", b"\t\n\x0b\x0c\r a\x1c\x85b", *long]
    texts += [bytes(draw.choice(b"aB \n\xc3\xa9") for _ in range(draw.randrange(60))) for _ in range(1000)]
    for size in (1, 2, 3):
        found, hashed = similar.shingles(texts, size), {}
        for text, got in zip(texts, found, strict=True):
            words = bytes(c + 32 if 65 <= c <= 90 else c for c in text).split()
            want = {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, len(words) > 0))}
            assert len(got) == len(want) and (np.diff(got) > 0).all() and got.tolist() == similar.shingles([text], size)[0].tolist()
            if len(want) == 1:
                assert hashed.setdefault(*want, int(got[0])) == got[0]
        assert len(set(hashed.values())) == len(hashed)
