"""URL filters, substring dedup, toxicity and quality against plain implementations and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import no_docs, odd_docs, rows

from weftline.llm import boost, quality, queries, substrings, toxicity, urls

SF = "/root/testdata/sf0.01"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_removal(texts, window=35):
    words = [(t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") for t in texts]
    words = [[w for w in ws if w] for ws in words]
    seen = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for ws in words:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((len(ws), len(gone), sha(" ".join(kept))))
    return out


def test_substrings_odd(spark):
    texts = [r[1] for r in rows()]
    got = substrings.digest(odd_docs(spark)).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(plain_removal(texts))
    assert substrings.digest(no_docs(spark)).count() == 0


@pytest.mark.parametrize("window,k", [(35, 18), (5, 3)])
def test_substrings_random(spark, window, k):
    draw = np.random.default_rng(7)
    pieces = [" ".join(draw.choice(list("abcdefgh"), int(n))) for n in draw.integers(1, 60, 12)]
    texts = [" ".join(draw.choice(pieces, int(n))) for n in draw.integers(0, 8, 120)] + ["a " * 90, "b " * 35]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs, window, k).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, window)


def test_unsound_paths_are_compared_window_by_window(spark):
    """Where paths of one name hold different words, the check tells, and their windows are compared one by one."""
    import pyarrow as pa

    words = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    path = lambda sound: [{"head": 5, "start": 0, "end": 60, "sound": sound}]
    batch = lambda sound: pa.RecordBatch.from_pydict({"key": [1, 2], "text": [" ".join(w) for w in words], "paths": [path(sound), path(sound)]})
    rows = [r for b in substrings.look_up(35, 18)(iter([batch(True)])) for r in b.to_pylist()]
    assert [r["head"] for r in rows] == [5, 5] and rows[0]["one"] != rows[1]["one"]
    rows = [r for b in substrings.look_up(35, 18)(iter([batch(False)])) for r in b.to_pylist()]
    assert [(r["key"], r["place"]) for r in rows] == [(k, i) for k in (1, 2) for i in range(26)]
    assert len({(r["one"], r["two"]) for r in rows}) == 52


def test_rolled_and_edges():
    values = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    values[100:150] = values[20:70]
    for n in (1, 2, 3, 18, 35):
        h = substrings.rolled(values, n, substrings._B1)
        assert len(h) == 200 - n + 1 and len(set(h.tolist())) == len({tuple(values[i : i + n]) for i in range(200 - n + 1)})
    least, chosen = substrings.edges(values, np.full(200, 200), 35, 18)
    kmers = substrings.rolled(values, 18, substrings._B1)
    assert all(least[i] == kmers[i : i + 18].min() for i in range(166))
    assert set(chosen) == {j for i in range(166) for j in range(i, i + 18) if kmers[j] == least[i]}


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in urls.RULES:
        name, start = rule.partition("/")[0], rule[rule.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "x://example.org/en/1?q", "a://b://c.org/", "http://example.org/en/100#t", "http://example.org", "http://corg/", "http://x.com/de/", "http://x.com/fr", "http://é.com/fr/ü", "http://h.net/\n/x", "y://org/a?b://c"]


def test_url_rules(spark):
    given = ODD_URLS + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given)], "page_id long, url string, host string")
    out = urls.judge(pages).orderBy("page_id").collect()
    verdicts = {r: v for v, r in urls.RULES}
    for r, u in zip(out, given, strict=True):
        assert (r.host, r.path, r.rule) == plain_url(u), u
        assert r.verdict == verdicts.get(r.rule, "allow" if r.score >= 0.5 else "block") and 0 <= r.score <= 1
    assert urls.judge(pages.where("page_id < 0")).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id < 4")).collect()} == {"allow"}


def test_url_model_separates(spark):
    draw = np.random.default_rng(3)
    make = lambda s, tld: f"http://{''.join(draw.choice(list(s), 8))}.{tld}"
    given = [make("abcd", "com/fr/1") for _ in range(400)] + [make("wxyz", "com/de/1") for _ in range(400)]
    given += [make("abcd", "net/1") for _ in range(50)] + [make("wxyz", "net/1") for _ in range(50)]
    out = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).orderBy("page_id").collect()
    assert {r.verdict for r in out[800:850]} == {"allow"} and {r.verdict for r in out[850:]} == {"block"}


def test_url_grams_are_counted_once_per_place():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"rest": ["ab", "b"], "blocked": [False, True]})
    out = next(urls.count_grams(iter([batch]))).to_pydict()
    accepted = dict(zip(out["slot"], out["accepted"], strict=True))
    assert accepted[-1] == 2 + urls.ORDER + 1
    n = urls.ORDER + 3
    assert sum(v for k, v in accepted.items() if k >= 0) == sum(n - m for m in range(urls.ORDER + 1))


def plain_differences(labelled, texts):
    """Both models with exact counts in dictionaries."""
    marks = lambda t: [urls.START] * urls.ORDER + [ord(c) for c in t] + [urls.END]
    counts, totals = [Counter(), Counter()], [0, 0]
    for text, blocked in labelled:
        s = marks(text)
        totals[blocked] += len(s)
        counts[blocked].update(tuple(s[i - m : i + 1]) for m in range(urls.ORDER + 1) for i in range(m, len(s)))
    out = []
    for text in texts:
        s, sums = marks(text), [0.0, 0.0]
        for c in (0, 1):
            for i in range(urls.ORDER, len(s)):
                p = (counts[c][(s[i],)] + urls.MU / 1000) / (totals[c] + urls.MU)
                for m in range(1, urls.ORDER + 1):
                    p = min(1.0, (counts[c][tuple(s[i - m : i + 1])] + urls.MU * p) / (counts[c][tuple(s[i - m : i])] + urls.MU))
                sums[c] += np.log(p)
        out.append((sums[0] - sums[1]) / (len(s) - urls.ORDER))
    return np.array(out)


def test_url_grams_never_share_counts(spark):
    """Over a million distinct grams, more than any fixed number of slots would hold apart, score as plain dictionaries do."""
    draw = np.random.default_rng(11)
    make = lambda: "".join(map(chr, draw.integers(0x4E00, 0x9FFF, 14)))
    labelled = [(f"{make()}.com/{'de' if i % 2 else 'fr'}/{make()}", bool(i % 2)) for i in range(12_000)]
    free = [f"{t[: 4 + i % 10]}.net/{labelled[i + 1][0][-8:]}" for i, (t, _) in enumerate(labelled[:300])] + ["", "\U0001f600.net/\U0010ffff"]
    pages = spark.createDataFrame([(i, "http://" + t) for i, t in enumerate([t for t, _ in labelled] + free)], "page_id long, url string")
    got = urls.judge(pages).where(f"page_id >= {len(labelled)}").orderBy("page_id").collect()
    used, held = ([(t, b) for t, b in labelled if (zlib.crc32(t.encode()) % urls.HELD == 0) == h] for h in (False, True))
    d, bins = plain_differences(used, [t for t, _ in held] + free), urls.BINS
    at = np.floor(np.clip(d[: len(held)], -2, 1.999) * (bins / 4)).astype(int) + bins // 2
    hist = [np.bincount(at[[b == c for _, b in held]], minlength=bins) for c in (False, True)]
    slope, intercept = urls.fit_line((np.arange(bins) - bins // 2 + 0.5) / (bins / 4), *hist)
    want = 1 / (1 + np.exp(-(slope * d[len(held) :] + intercept)))
    assert np.abs(np.array([r.score for r in got]) - want).max() < 1e-3
    assert len({s[i - m : i + 1] for s, _ in used for m in range(6) for i in range(m, len(s))}) > 1 << 20


def test_boosting_and_isotonic():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boost.Trees(60, 3).fit(x, y)
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.95
    curve = boost.Isotonic().fit(np.array([0.0, 1, 1, 2, 3]), np.array([0.0, 1, 0, 0, 1]))
    p = curve(np.linspace(-1, 4, 50))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    empty = boost.Trees().fit(np.zeros((0, 3)), np.zeros(0))
    assert boost.Isotonic().fit(np.zeros(0), np.zeros(0))(empty.margin(x)).tolist() == [0.5] * 2000


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    found = out.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found) and all((r.score >= 0.3) == r.predicted for r in found)
    hit = sum(r.toxic and r.predicted for r in found)
    recall, precision = hit / sum(r.toxic for r in found), hit / max(1, sum(r.predicted for r in found))
    assert recall > 0.8 and precision > 0.8, (recall, precision)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(odd_docs(spark), labels)
    assert out.count() == len(rows()) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(no_docs(spark), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd_docs(spark), labels.where("doc_id < 0")).collect()} == {0.5}


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = docs.join(labels.where("doc_id % 5 <> 0").select("doc_id"), "doc_id", "left_semi").unionByName(docs.join(labels, "doc_id", "left_anti")).unionByName(docs.join(labels.where("doc_id % 5 = 0").select("doc_id"), "doc_id", "left_semi"))
    model = quality.fit(part, labels.where("doc_id % 5 <> 0"))
    found = quality.score(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good = [r for r in found if r.quality == 1]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98, sum(r.kept for r in good) / len(good)
    assert sum(not r.kept for r in bad) / len(bad) > 0.8, sum(not r.kept for r in bad) / len(bad)


def test_quality_searches_all_unlabelled_rows(spark):
    """Over 30,000 unlabelled rows all take part in the search for pseudo-labels, repeated and null ids too."""
    from pyspark.sql import functions as F

    docs = spark.range(32_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id") % 97).alias("text"), F.lit("xx").alias("lang"), (F.col("id") % 7).cast("string").alias("source"), F.lit(7).alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id = 31999")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 7 > 2).cast("int").alias("quality"))
    assert quality.fit(docs, labels, rounds=1).searched == 32_000 - 400 + 2


def test_wide_trees_are_the_trees_of_one_table():
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(3000, 4)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    one = boost.Trees(20).fit(x, y)
    wide = boost.WideTrees(one.cuts, 20)
    wide.start(y.sum(), len(y))
    bins = wide.bin(x)
    for _ in range(20):
        for level in range(wide.depth):
            f = wide.binned_margin(bins)
            wide.add_level(sum(wide.sums(bins[p], y[p], 1.0, f[p], level) for p in (slice(0, 1700), slice(1700, 3000))), level)
    assert np.abs(wide.margin(x) - one.margin(x)).max() < 1e-6 and np.abs(wide.binned_margin(bins) - one.margin(x)).max() < 1e-6


def test_surest_rows_are_labelled():
    """The cut-offs from counts pick the rows that sorting all margins picks."""
    margins = np.random.default_rng(6).permutation(np.linspace(-3, 2.9, 1000))
    codes = quality._code(margins)
    low, below, high, above = quality._sure(Counter(codes.tolist()), 0.4)
    assert len(set(codes.tolist())) > 900 and 0 < below <= 1 and 0 < above <= 1
    order, n = np.argsort(margins), int(1000 * quality.SHARE)
    bad, good = set(np.flatnonzero(codes <= low).tolist()), set(np.flatnonzero(codes >= high).tolist())
    assert set(order[: int(n * 0.6)].tolist()) <= bad and len(bad) <= int(n * 0.6) + 2
    assert set(order[len(order) - int(n * 0.4) :].tolist()) <= good and len(good) <= int(n * 0.4) + 2
    few = quality._sure(Counter({-5: 600, 7: 400}), 0.5)
    assert few == (-5, 50 / 600, 7, 50 / 400)  # ties: that part of the rows, by the number that breaks them


def test_rounds_are_the_same_in_the_driver_and_in_spark(spark, monkeypatch):
    """Pseudo-labels learned by sums over partitions give the scores that learning them in one place gives."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = []
    for near in (quality.NEAR, -1):
        monkeypatch.setattr(quality, "NEAR", near)
        found.append({r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, rounds=1)).collect()})
    assert found[0].keys() == found[1].keys() and max(abs(found[0][i] - found[1][i]) for i in found[0]) < 1e-6


def test_lexicon_keeps_all_that_pass(spark):
    """Over a thousand words that only toxic documents hold are all entries; of beginnings that say the same, the shortest."""
    letters = "abcdefghijklmnop"
    word = lambda c, j: c + letters[j % 16] + letters[j // 16 % 16] + letters[j // 256] + "ql"
    docs = spark.createDataFrame([(i, " ".join(word(c, j) for c in ("t" if i % 2 else "c") for j in range(1500))) for i in range(40)], "doc_id long, text string")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    model = toxicity.fit(docs, labels)
    assert model.lexicon.entries == sorted(word("t", j)[:4] + "*" for j in range(1500))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    out = quality.digest(docs, labels)
    assert out.count() == len(rows()) and out.where("score is null").count() == 0
    assert quality.good(docs, labels).columns == docs.columns
    assert quality.digest(no_docs(spark), labels).count() == 0
    assert quality.good(docs, labels.where("doc_id < 0")).count() == len(rows())


def test_registry():
    assert set(queries.oracle_sql()) <= set(queries.queries())
