"""Quality rules, classifier, line and near-deduplication and packing against plain Python, with the awkward cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash

from voxmill.llm import bpe, line_dedup, packing, quality_rules, simhash, weak_labels
from voxmill.llm.components import components

from .fixtures import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def union(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_verdicts(rows, core=0.75, prior=50, tail=1e-9):
    """Whether each row (lang, source, five statistics) passes: the estimate from sorted distances, group by group."""
    floors = np.array(list(quality_rules.FEATURES.values()))
    q, cdf = quality_rules.chi2_quantile, quality_rules.chi2_cdf

    def vector(s):
        n, size = max(s[0], 1), max(s[1], 1)
        x = [np.log(n), np.log(size / n), np.log1p(20 * s[2] / size), np.log1p(10 * s[4] / n), np.log1p(40 * s[3] / n)]
        return [int(np.floor(abs(v) * 1000 + 0.5) * np.sign(v)) for v in x]

    base = [s[0] < 50 or 100 * s[4] > 50 * s[0] for *_, s in rows]
    z = {i: vector(s) for i, (*_, s) in enumerate(rows) if not base[i]}
    groups, langs = defaultdict(list), defaultdict(list)
    for i in z:
        groups[rows[i][0], rows[i][1]].append(i)
        langs[rows[i][0]].append(i)

    def middles(ids):
        x = np.array([z[i] for i in ids]) / 10
        x = np.floor(np.abs(x) + 0.5) * np.sign(x)
        mid = np.median(x, 0)
        return mid / 100, (np.median(np.abs(x - mid), 0) * 0.014826) ** 2

    def chain(v):
        h = 42
        for x in v:
            h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
        return h

    def fitted(n, mean, cov, pm, pv):
        gap = mean - pm
        all_ = n + prior
        return (n * mean + prior * pm) / all_, (n * cov + prior * np.diag(pv) + n * prior / all_ * np.outer(gap, gap)) / all_ + np.diag(floors**2)

    def distance(x, fit):
        d = x - fit[0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(fit[1]), d)

    def moments(x):
        return (len(x), x.mean(0), np.cov(x.T, bias=True).reshape(5, 5)) if len(x) else (0, np.zeros(5), np.zeros((5, 5)))

    kept = [not f for f in base]
    ma, va = middles(z) if z else (None, None)
    scale = lambda share: share / cdf(q(share, 5), 7)
    for (lang, _), ids in groups.items():
        ml, vl = middles(langs[lang])
        k = len(langs[lang])
        pm, pv = (k * ml + prior * ma) / (k + prior), (k * vl + prior * va) / (k + prior)
        x = np.array([z[i] for i in ids]) / 1000
        half = np.array([chain(z[i]) % 2 for i in ids])
        m, v = middles(ids)
        starts = [(len(ids), m, np.diag(v)), (len(ids), pm, np.diag(pv)), moments(x), moments(x[half == 0]), moments(x[half == 1])]
        h = int(np.ceil(core * len(ids)))

        def step(fit):
            n, mean, cov = moments(x[np.argsort(distance(x, fit), kind="stable")[:h]])  # noqa: B023
            return fitted(n, mean, cov * scale(core), pm, pv)  # noqa: B023

        fits = [step(step(fitted(*s, pm, pv))) for s in starts if s[0]]
        best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
        for _ in range(30):
            now = step(best)
            if np.linalg.slogdet(now[1])[1] >= np.linalg.slogdet(best[1])[1] - 1e-9:
                break
            best = now
        n, mean, cov = moments(x[distance(x, best) <= q(0.975, 5)])
        last = fitted(n, mean, cov * scale(0.975), pm, pv)
        for i, d in zip(ids, distance(x, last), strict=True):
            kept[i] = bool(d <= q(1 - tail, 5))
    return kept


def check_quality(spark, docs, rows):
    """rows: (doc_id, text, lang, source)."""
    told = [(lang, source, plain_stats(text)) for _, text, lang, source in rows]
    want = Counter((r[0], *t[2], t[2][0] < 50 or 100 * t[2][4] > 50 * t[2][0], k) for r, t, k in zip(rows, told, plain_verdicts(told), strict=True))
    got = Counter(map(tuple, quality_rules.quality_table(docs).collect()))
    assert got == want
    return [r for r in want if r[-1]]


def test_quality_rules(spark):
    rows = documents()
    kept = check_quality(spark, frame(spark), [r[:4] for r in rows])
    assert not {11, 12} & {r[0] for r in kept}
    out = quality_rules.keep_good(frame(spark))
    assert out.columns == frame(spark).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in kept for _ in range(Counter(x[0] for x in rows)[r[0]] if r[0] == 20 else 1))
    assert quality_rules.quality_table(frame(spark, [])).collect() == []
    assert quality_rules.keep_good(frame(spark, [])).collect() == []


def test_quality_rules_query(spark):
    """The whole query at the smallest scale, and that it finds most of what labels call bad and nothing else."""
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    kept = {r[0] for r in check_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), rows)}
    for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").collect():
        assert r.doc_id not in kept


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(quality_rules.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_mcd_ignores_outliers(spark):
    """The fit of 300 rows, 60 of them far off together, is that of the other 240."""
    rng = np.random.default_rng(0)
    rows = [("en", "a", int(n), int(n * 5), 0, 0, int(n * 0.05)) for n in np.exp(rng.normal(5.5, 0.4, 240)) + 50]
    far = [("en", "a", 100, 900, 80, 0, 45)] * 60
    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    (fit,) = quality_rules.fit_mcd(spark.createDataFrame(rows + far, schema)).collect()
    assert abs(fit.m2) < 0.01 and abs(fit.m0 - np.mean([np.log(r[2]) for r in rows])) < 0.15


def plain_scores(texts):
    """The scores of texts when all of them train the scorer, in one process."""
    distinct = {xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42: t for t in texts}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    votes = [weak_labels.votes(t) for t in texts]
    patterns = sorted(set(votes))
    post = dict(zip(patterns, weak_labels.em(np.array(patterns), np.array([votes.count(p) for p in patterns], float))[0], strict=True))
    rows = [({k: float(np.float32(v)) for k, v in weak_labels.features(t).items()}, post[weak_labels.votes(t)]) for _, t in sorted((signed(h), t) for h, t in distinct.items())]
    weights, bias = weak_labels.train(rows)
    weights = weights.astype(np.float32)
    out = []
    for t in texts:
        words = WORD.findall(t or "")
        out.append(bias + sum(float(weights[weak_labels._word_slots(w)].sum()) for w in words) / max(1, len(words)) + float(weights[weak_labels._text_slots(words)].sum()))
    return out


def test_weak_labels_query(spark):
    """Every row of the query, and of the awkward fixture, against one process that holds everything."""
    from voxmill.llm.queries import op1_weak_labels

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for got, rows in ((op1_weak_labels(spark, "/root/testdata/sf0.001"), [(r.doc_id, r.text) for r in docs]), (weak_labels.classify(frame(spark)), [r[:2] for r in documents()])):
        want = sorted(((i, s) for (i, _), s in zip(rows, plain_scores([t for _, t in rows]), strict=True)), key=str)
        have = sorted(((r.doc_id, r.score) for r in got.collect()), key=str)
        assert [i for i, _ in have] == [i for i, _ in want]
        assert np.allclose([s for _, s in have], [s for _, s in want], atol=0.02)
        assert all((s >= 0) == (t >= 0) for (_, s), (_, t) in zip(have, want, strict=True) if abs(t) > 0.02)


def test_weak_labels(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.kept for r in weak_labels.classify(docs).collect()}
    truth = {r.doc_id: bool(r.quality) for r in labelled.collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 0.97 * len(truth)
    assert sum(not got[k] for k, v in truth.items() if v) <= 0.005 * len(truth)
    out = weak_labels.keep_good(frame(spark))
    assert out.columns == frame(spark).columns
    rows = weak_labels.classify(frame(spark)).collect()
    assert len(rows) == len(documents()) and all(r.kept for r in rows if r.doc_id not in (11, 12))
    assert weak_labels.classify(frame(spark, [])).collect() == []


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20000) < 0.2
    rates = np.array([[0.02, 0.9], [0.05, 0.8], [0.01, 0.7], [0.1, 0.85]])
    votes = np.where(rng.random((20000, 4)) < rates[:, bad.astype(int)].T, weak_labels.BAD, weak_labels.GOOD)
    votes[rng.random(votes.shape) < 0.2] = weak_labels.NONE
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found, share = weak_labels.em(patterns, counts.astype(float))
    assert np.mean((post[inverse.ravel()] > 0.5) == bad) > 0.95
    assert abs(share - 0.2) < 0.05 and np.abs(found - rates).max() < 0.12


def plain_line_dedup(rows):
    lines = {}
    docs = sorted({(r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42), r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0], r[1]))
    where = []
    for d in docs:
        for no, line in enumerate(d[3].split("\n")):
            if WORD.search(line):
                where.append((d, no, lines.setdefault(line, len(lines))))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= line_dedup.LEAST else set() for x in lines]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, seen, gone = union(len(lines), pairs), set(), defaultdict(set)
    for d, no, i in where:
        if root[i] in seen:
            gone[d[1] if not d[0] else None, d[3]].add(no)
        seen.add(root[i])
    return gone


def test_line_dedup(spark):
    rows = documents()
    gone = plain_line_dedup(rows)
    out = line_dedup.dedup_lines(frame(spark), counts=True)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_chars) for r in out.collect())
    want = Counter()
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        drop = gone.get((r[0], r[1]), set())
        text = None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in drop)
        want[r[0], text, len(lines or ()), len(drop), r[4] if not drop else len(text)] += 1
    assert got == want
    plain = line_dedup.dedup_lines(frame(spark))
    assert plain.columns == frame(spark).columns
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_line_dedup_recall(spark):
    """Every line pair of similarity 0.8 or more that edits of one in twelve words make is found."""
    import random

    from .fixtures import prose

    rnd, rows = random.Random(9), []
    for i in range(300):
        words = [w + str(rnd.randrange(100)) for w in prose(rnd, 36).split()]
        rows.append((2 * i, " ".join(words), "en", "a", 0, "", 0, "", "", 0))
        for _ in range(2):
            words[rnd.randrange(36)] = "changed"
        rows.append((2 * i + 1, " ".join(words), "en", "a", 0, "", 0, "", "", 0))
    out = line_dedup.dedup_lines(frame(spark, rows), counts=True).collect()
    want = sum(map(len, plain_line_dedup(rows).values()))
    assert want > 250 and sum(r.n_removed for r in out) >= 0.98 * want


def check_line_pairs(spark, pairs):
    """Of pairs of lines that resemble nothing else, those of similarity 0.8 or more lose a line each."""
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    want = sum(len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)) for x, y in pairs)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(x for pair in pairs for x in pair)], "doc_id long, text string")
    gone = line_dedup.dedup_lines(docs, counts=True).agg({"n_removed": "sum"}).first()[0]
    assert want >= 0.9 * len(pairs) and 0.99 * want <= gone <= want


def word(rnd, n=7):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_line_dedup_shared_passage(spark):
    """Families with a passage in common, as boilerplate makes them, are all compared."""
    import random

    rnd = random.Random(5)
    passage, pairs = " ".join(word(rnd) for _ in range(13)), []
    for _ in range(1500):
        own = [word(rnd) for _ in range(6)]
        line = f"{passage} {' '.join(own)}"
        at = rnd.randrange(len(passage) + 1, len(line))
        pairs.append((line, line[:at] + "#" + line[at + 1 :]))
    check_line_pairs(spark, pairs)


def test_line_dedup_copies_of_shared_passage(spark, monkeypatch):
    """With buckets of at most three lines and blocks of four, so that all large buckets take the exact way."""
    monkeypatch.setattr(line_dedup, "LIMIT", 3)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    test_line_dedup(spark)


def test_line_dedup_whatever_the_size_of_buckets(spark, monkeypatch):
    """Which lines are linked does not depend on LIMIT: large buckets link the lines that small ones do."""
    import random

    rnd, texts = random.Random(11), []
    passages = [" ".join(word(rnd) for _ in range(9)) for _ in range(6)]
    for k in range(500):
        own = [word(rnd) for _ in range(14)]
        line = f"{passages[k % 6]} {' '.join(own)}"
        texts += [line, " ".join([*line.split()[:-2], word(rnd), word(rnd)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for limit in (1, 1_000_000):
        monkeypatch.setattr(line_dedup, "LIMIT", limit)
        found.append({r.doc_id for r in line_dedup.dedup_lines(docs, counts=True).collect() if r.n_removed})
    assert len(found[0]) > 100 and found[0] == found[1]


def test_line_dedup_compares_few_lines_of_a_shared_passage_in_full(spark, monkeypatch):
    """Lines that share a passage, but aren't similar, meet in large buckets: the texts of few of all their pairs are compared."""
    import random

    rnd, compared = random.Random(12), []
    passage = " ".join(word(rnd) for _ in range(16))
    texts = [f"{passage} {' '.join(word(rnd) for _ in range(14))}" for _ in range(400)]
    # a line like another one, with which it isn't compared as the bucket's least line or neighbour
    texts += [" ".join([*x.split()[:-1], word(rnd)]) for x in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified = line_dedup._verified

    def counted(pairs, texts):
        compared.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs, counts=True).collect() if r.n_removed}
    assert gone == set(range(400, 440)) and sum(compared) <= 200


def test_line_dedup_sketches_lose_no_similar_lines(spark):
    import random

    rnd, lines = random.Random(13), []
    for k in range(400):
        words = [word(rnd, rnd.randrange(1, 9)) for _ in range(rnd.randrange(2, 300))]
        edited = list(words)
        for _ in range(rnd.randrange(1 + len(words) // 12)):
            edited[rnd.randrange(len(words))] = word(rnd)
        # repeated shingles count once
        again = " " + " ".join(words[:3]) if k % 2 else ""
        lines += [" ".join(words), " ".join(edited) + again * 9]
    texts = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(400)], "a long, b long")
    similar = {tuple(r) for r in line_dedup._verified(pairs, texts).collect()}
    kept = {tuple(r) for r in line_dedup._alike(pairs, line_dedup._sketches(texts)).collect()}
    assert len(similar) > 200 and similar <= kept < {tuple(r) for r in pairs.collect()}


def test_line_dedup_sketches_tell_long_lines_that_repeat_themselves(spark):
    """Lines of thousands of shingles, few of them distinct: only those that are similar are left to be compared in full."""
    lines = [f"{w} " * 500 for w in ("abcdefgh", "ijklmnop", "qrstuvwx")] + ["abcdefgh " * 480]
    texts = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    sketches = line_dedup._sketches(texts)
    assert {r.lid: r.sketch.size for r in sketches.collect()} == {i: 9 for i in range(4)}
    pairs = spark.createDataFrame([(a, b) for b in range(4) for a in range(b)], "a long, b long")
    assert [tuple(r) for r in line_dedup._alike(pairs, sketches).collect()] == [(0, 3)]


def test_line_dedup_without_spaces(spark):
    import random

    rnd = random.Random(6)
    head, pairs = "".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(12)), []
    for k in range(900):
        line = (head if k % 2 else "") + "".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(60 - 12 * (k % 2)))
        at = rnd.randrange(12 * (k % 2), 60)
        pairs.append((line, line[:at] + "x" + line[at + 1 :]))
    for _ in range(600):
        line = f"https://example.org/{word(rnd, 30)}/{word(rnd, 30)}"
        pairs.append((line, line[:-1] + "#"))
    check_line_pairs(spark, pairs)


def test_line_dedup_short_lines(spark):
    import random

    rnd = random.Random(7)
    check_line_pairs(spark, [(x, x + ".") for x in (f"{word(rnd, 8)} {word(rnd, 8)}" for _ in range(500))])


def test_simhash(spark):
    rows = documents()
    prints = [simhash.fingerprint(r[1]) for r in rows]
    for r, f in zip(rows, prints, strict=True):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert f == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, prints, root, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(frame(spark)).collect()) == want
    kept = simhash.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least[k]) for k in set(root))
    assert simhash.near_copies(frame(spark, [])).collect() == [] and simhash.keep_first(frame(spark, [])).collect() == []


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40)
    prints = sorted({int(b) ^ int(np.bitwise_xor.reduce(1 << rng.integers(0, 63, k))) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(4) if k or True})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.v: r.root for r in components(simhash.ball_links(df)).collect()}
    root = union(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert [got.get(p, p) for p in prints] == [prints[k] for k in root]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [tuple(map(int, rng.integers(2000, 2600, 2))) for _ in range(450)] + [(5, 5), (None, 3), (7000, 7000)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(7001, [e for e in edges if e[0] is not None])
    assert got == {v: want[v] for e in edges if e[0] is not None for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    from itertools import combinations

    for n, k in ((1, 3), (5, 2), (9, 3), (10, 4)):
        lengths = np.sort(rng.choice(np.arange(1, 60), n, replace=False))
        counts = rng.integers(1, 20, n)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost([*some, lengths[-1]]) for r in range(min(k, n)) for some in combinations(lengths[:-1], r))
        bounds = packing.best_bounds(lengths, counts, k)
        assert bounds == sorted(bounds) and len(bounds) <= k and cost(bounds) == best


def test_packing(spark):
    rows = documents()
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = packing.pack(frame(spark), ranks, pattern, max_len=512, buckets=6, budget=2048).collect()
    sizes = Counter()
    for r in out:
        sizes[r.doc_id] += r.length
    want = Counter()
    for r in rows:
        want[r[0]] += len(bpe.coder(ranks, pattern)._bpe.encode_ordinary(r[1] or ""))
    assert sizes == want
    batches = defaultdict(list)
    for r in out:
        assert (r.batch is None) == (r.length == 0)
        if r.batch:
            batches[r.batch].append(r)
    for some in batches.values():
        assert len({r.bucket_length for r in some}) == 1 and sorted(r.slot for r in some) == list(range(len(some)))
        assert sum(r.bucket_length for r in some) <= max(2048, some[0].bucket_length) and all(r.length <= r.bucket_length for r in some)
    lengths = sorted(r.length for r in out if r.length)
    bounds = sorted({r.bucket_length for r in out if r.batch})
    assert bounds == packing.best_bounds(np.unique(lengths), np.unique(lengths, return_counts=True)[1], 6)
    assert packing.pack(frame(spark, []), ranks, pattern).collect() == []


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    """run() over nulls, empty and long texts, repeated rows and clashing columns, stage by stage; and over no rows."""
    import corpus_pipeline as p

    rows = documents()
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), [(r[0], r[1], r[2], r[3]) for r in rows]
    for (name, stage), columns in zip(p.STAGES, [docs.columns] * 4 + [None], strict=True):
        out = stage(spark, docs, str(tmp_path))
        if name == "quality rules":
            verdicts = plain_verdicts([(lang, source, plain_stats(t)) for _, t, lang, source in held])
            held = [r for r, k in zip(held, verdicts, strict=True) if k]
        elif name == "quality classifier":
            held = [r for r, s in zip(held, plain_scores([r[1] for r in held]), strict=True) if s >= 0]
        elif name == "line dedup":
            gone = plain_line_dedup(held)
            held = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())), *more) for i, t, *more in held]
        elif name == "SimHash near-dedup":
            prints = [simhash.fingerprint(r[1]) for r in held]
            root = union(len(held), [(i, j) for i in range(len(held)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
            told = lambda i: (held[i][0] is None, held[i][0] or 0, held[i][1] or "")  # noqa: E731, B023
            held = [held[min((i for i in range(len(held)) if root[i] == k), key=told)] for k in dict.fromkeys(root)]
        else:
            c = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            sizes = Counter()
            for r in out.collect():
                sizes[r.doc_id] += r.length
            want = Counter()
            for r in held:
                want[r[0]] += len(c._bpe.encode_ordinary(r[1] or ""))
            assert sizes == want
            break
        assert out.columns == columns
        got = out.collect()
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(held), name
        docs = spark.createDataFrame(got, frame(spark, []).schema)
    whole = p.run(spark, str(tmp_path)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in whole} == dict(want)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).collect() == []
