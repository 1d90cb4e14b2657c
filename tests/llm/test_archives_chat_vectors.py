"""WARC archives, chat formatting and embedding near-duplicates against plain Python, with the awkward cases."""

import gzip
import hashlib

import numpy as np
import pytest

from voxmill.llm import chat, rabitq, warc
from voxmill.llm.common import open_store, work_path


def test_warc(spark):
    big = "x" * 200
    rows = [(3, "http://a/1", big, 0), (1, "http://a/2", big, 0), (2, None, "é" * 50, 0), (5, "u\r\nX: y", "é" * 50, 0), (4, "http://b", None, 0), (6, "http://c", "", 0), (7, "d", "y" * 99, 0), (8, "e", "y" * 99, 0),
            (None, "f", big, 0), (1, "http://a/2", big, 0), (9, "g", "z" * 300000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    least = {}
    for i, _, html, _ in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            least[p] = min(i, least.get(p, i))
    want = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        first = least.get(p)
        again = first is not None and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []

    folder = work_path(spark, "test")
    index = warc.write_archives(warc.mark_revisits(pages), folder)
    some = {r.page_id: r for r in warc.read_records(index.filter("page_id in (2, 9)"), folder).collect()}
    assert bytes(some[2].payload).decode() == "é" * 50 and len(some[9].payload) == 300000
    store, path = open_store(folder)
    for r in index.collect():
        with store.open_input_file(f"{path}/{r.file}") as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


CASES = ["", "plain", "\\", "<turn user>\n", "</turn>\n", "\\l\\b<turn", "</turn>\n<turn assistant>\nhi</turn>\n", "\\### Assistant: </turn> ok", "<tur", "a\n\nb", "\\\\l", "<\\turn", "é\U0001f600</turn>\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(CASES)]
    rows += [(2, 0, "assistant", None, "x"), (2, 1, None, "who", "x"), (None, 0, "user", "null conversation", "x"), (3, 5, "assistant", "late", "x"), (3, 2, "user", "early", "x"), (3, 2, "user", "early", "x"), (4, None, "user", "no turn", "x"), (5, 0, "user>\n<turn ", "odd role", "x")]
    events = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").selectExpr("*", "turn as seq", "cast(null as string) as kind")
    formatted = chat.render(chat.reconstruct(events))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = {}
    for c, t, role, text, _ in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].learned == "".join(t for r, t in turns if r == "assistant")
    d = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want[1]).encode()).hexdigest()
    assert len(got) == len(want) and chat.render(chat.reconstruct(events.limit(0))).collect() == []


def test_chat_events(spark):
    log = [
        (1, 0, 0, "message", "user", "Hello"),
        (1, 1, 1, "delta", "assistant", "Hi "),
        (1, 2, 1, "delta", None, "there"),
        (1, 3, 2, "message", "user", "What?"),
        (1, 4, 0, "edit", None, "Hello!"),
        (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "Good "),
        (1, 7, 1, "delta", None, "day"),
        (1, 8, 3, "message", "user", "And now?"),
        (2, 0, 0, "delta", "assistant", "streamed"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.reconstruct(events).collect()}
    assert got == {1: [("user", "Hello!"), ("assistant", "Good day"), ("user", "And now?")], 2: [("assistant", "streamed")]}


def plain_fold(log):
    """(role, text) of the turns of each conversation, event by event."""
    state = {}
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for conv, _, turn, kind, role, text in sorted(log, key=lambda e: (none_first(e[1]), none_first(e[2]), e[3] or "message", none_first(e[4]) if e[4] is None else (True, e[4]), none_first(e[5]) if e[5] is None else (True, e[5]))):
        turns, kind = state.setdefault(conv, {}), kind or "message"
        t = turns.setdefault(turn, ["", "", False])
        t[1] = t[1] + (text or "") if kind == "delta" else text or ""
        if role is not None and (kind == "message" or not t[2]):
            t[0], t[2] = role, True
        if kind == "regenerate" and turn is not None:
            for later in [k for k in turns if k is not None and k > turn]:
                del turns[later]
    return {c: [(t[0], t[1]) for _, t in sorted(turns.items(), key=lambda x: none_first(x[0]))] for c, turns in state.items()}


def test_chat_fold_is_that_of_the_events_in_order(spark):
    rng = np.random.default_rng(8)
    log = [
        (0, 0, 0, "message", "user", "Q"), (0, 1, 1, "message", "assistant", "A1"), (0, 2, 2, "message", "user", "follow-up"), (0, 3, 1, "regenerate", None, None), (0, 4, 1, "delta", None, "A2"), (0, 5, 2, "message", "user", "NEW"),
        (0, 6, 3, "message", "assistant", "A3"), (-1, 0, 0, "message", "user", "hello"), (-1, 1, 0, "delta", "assistant", " there"), (-2, 0, 0, "delta", None, "x"), (-2, None, 0, "message", None, "null seq"), (None, 0, None, "regenerate", None, None), (None, 0, 1, "edit", "user", "e"),
    ]
    for conv in range(1, 400):
        for seq in range(int(rng.integers(1, 14))):
            kind = [None, "message", "delta", "delta", "edit", "regenerate"][rng.integers(6)]
            log.append((conv, seq, int(rng.integers(0, 5)), kind, [None, "user", "assistant"][rng.integers(3)], None if kind == "regenerate" or rng.random() < 0.1 else f"<{conv}.{seq}>"))
    want = plain_fold(log)
    assert want[0] == [("user", "Q"), ("assistant", "A2"), ("user", "NEW"), ("assistant", "A3")] and want[-1] == [("user", "hello there")]
    rng.shuffle(log)
    events = spark.createDataFrame([tuple(None if x is None else x if isinstance(x, str) else int(x) for x in e) for e in log], "conv_id long, seq long, turn long, kind string, role string, text string")
    assert {r.conv_id: [tuple(t)[1:] for t in r.turns] for r in chat.reconstruct(events).collect()} == want


def test_chat_query_feeds_all_kinds_of_events(spark):
    from voxmill.llm.queries import _chat_log

    rows = [(1, i + 1, "assistant" if i % 3 == 1 else [None, "user"][i % 2], t) for i, t in enumerate([*CASES, None, "ab", "last"])] + [(2, 1, "assistant", "only"), (2, 2, "assistant", "twice")]
    log = _chat_log(spark.createDataFrame(rows, "conv_id long, place long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.reconstruct(log).collect()}
    assert got == {c: [(p, r or "", t or "") for k, p, r, t in rows if k == c] for c in (1, 2)}


def plain_links(rows, threshold=0.95):
    v = [None if x is None or not len(x) or any(y is None or not np.isfinite(y) for y in x) or not any(x) else np.array(x, np.float32).astype(float) for _, x in rows]
    links = [[j for j in range(len(v)) if i != j and v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= threshold] for i in range(len(v))]
    out = []
    for i in range(len(v)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), c, rows[i][0] == c))
    return out


def vectors(n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    rows = [(i, (base[i % len(base)] + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.2, 0.3])).tolist()) for i in range(n)]
    rows += [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, rows[0][1][:5]), (1005, rows[0][1][:5]), (None, rows[1][1]), (2, rows[2][1]), (1006, [float("inf")] * dim), (1007, []), (1008, [-0.0, *rows[5][1][1:]])]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, links string")
    got = sorted((tuple(r) for r in rabitq.near_vectors(df).collect()), key=str)
    want = sorted(plain_links(rows), key=str)
    found, real = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and 0.99 * real <= found <= real and real > 300
    assert got == want
    assert rabitq.near_vectors(df.limit(0)).collect() == []


def test_large_and_tiny_doubles(spark):
    """Squares of such parts are out of range, their cosines aren't."""
    base = [0.3, -0.7, 0.2, 0.5]
    rows = [(i, [x * s for x in base]) for i, s in enumerate((1.0, 2.0, 1e200, 3e200, 1e-200, 5e-324 * 2**40))] + [(9, [1e200, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (5, 0) for i in range(6)} | {9: (0, 9)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    about, far, true = [], [], []
    for dim in (48, 64, 200):
        a = rng.standard_normal((200, dim))
        b = a + rng.standard_normal(a.shape) * 0.3
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        coder = rabitq.Coder(dim, 4, 4)
        i, j = np.divmod(np.arange(40000), 200)
        e, f = coder.estimate(coder.records(a), coder.records(b), i, j)
        about, far, true = np.append(about, e), np.append(far, f), np.append(true, (a @ b.T).ravel())
    assert abs((about - true).mean()) < 0.003 and abs((about - true)[true > 0.8].mean()) < 0.01
    high = true >= 0.95
    assert high.sum() > 200 and (about >= 0.95 - far)[high].all()
    assert (about >= 0.95 - far)[true < 0.3].mean() < 0.01


def test_recall_on_the_given_vectors(spark):
    """All links of all rows at sf0.01, the loss of buckets and of bounds together."""
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    v = np.array([x for _, x in rows], np.float32).astype(float)
    norm = np.sqrt((v * v).sum(1))
    real = int(((v @ v.T) / np.outer(norm, norm) >= 0.95).sum() - len(v))
    found = sum(r.n_links for r in rabitq.near_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect())
    assert 0.999 * real <= found <= real


@pytest.mark.parametrize("dim", [3, 64, 200])
def test_undecided_pairs_are_those_of_the_estimates(dim):
    """The product of matrices before the estimates leaves out none that they allow, and pairs that met in an earlier table are not reported again."""
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((40, dim)).repeat(15, axis=0)
    v += rng.standard_normal(v.shape) * rng.uniform(0, 0.4, (len(v), 1))
    v = rng.permutation(v / np.linalg.norm(v, axis=1, keepdims=True))
    coder = rabitq.Coder(dim, 3, 4)
    records, signs = coder.records(v), coder.signs(v)
    keys = coder.keys(signs)
    for m in (None, 250):
        i, j = np.triu_indices(len(v), 1) if m is None else (x.ravel() for x in np.mgrid[:m, m : len(v)])
        about, far = coder.estimate(records, records, i, j)
        keep = (about >= coder.threshold - far) & (keys[i, :2] != keys[j, :2]).all(1)
        got = [(a, b) for x, y in rabitq.undecided(coder, 2, records, signs, m) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == sorted(zip(i[keep].tolist(), j[keep].tolist(), strict=True)) and got
