"""Whitening, line dedup and periodic runs against plain versions, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from locusloom.llm import line_dedup, periodic, whitening

VECTORS = "vec_id bigint, embedding array<float>, n string, component string"
DOCS = "doc_id bigint, text string, n_lines string, h1 string"


# -- whitening --------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)


def plain_whitening(rows, k):
    x = np.floor(1024 * np.array(rows, dtype=np.float32).astype(float)) + 100_000
    own = x - x.mean(axis=0)
    cov = own.T @ own / len(x)
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    whole = x.astype(np.int64)
    deviation = ((len(x) * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    return own @ q / np.sqrt(values), values / np.trace(cov), deviation


@pytest.mark.parametrize("d, guard", [(5, 24), (40, 4), (64, 24)])
def test_whitening_equals_plain_decomposition(spark, monkeypatch, d, guard):
    monkeypatch.setattr(whitening, "GUARD", guard)
    rng = np.random.default_rng(d)
    rows = [[float(c) for c in v] for v in (rng.normal(size=(300, d)) * np.linspace(2, 0.5, d)).astype(np.float32)]
    rows += rows[:1] * 60  # one vector many times
    got = whitening.fitted(vectors(spark, enumerate(rows)), 8, guard)
    out = {r.vec_id: r for r in got.transformed().collect()}
    own, explained, deviation = plain_whitening(rows, min(8, d))
    mine = np.array([out[i].whitened for i in range(len(rows))])
    signs = np.sign((mine * own).sum(axis=0))
    assert np.abs(mine - own * signs).max() < 1e-9
    assert np.abs(got.explained / explained - 1).max() < 1e-9 and got.identity_error < 1e-9
    assert [int(out[i].deviation) for i in range(len(rows))] == deviation.tolist()
    assert got.spectrum.passes == 1 if d == 5 else got.spectrum.passes > 4


def test_whitening_of_close_and_equal_eigenvalues():
    for values in (np.ones(50), np.concatenate([np.full(12, 3.0), np.full(38, 1.0)]), np.linspace(1.001, 1, 50), np.r_[1e6, np.linspace(2, 1, 49)]):
        turn = np.linalg.qr(np.random.default_rng(1).normal(size=(50, 50)))[0]
        v = (turn * values) @ turn.T
        got = whitening.leading(lambda block: (v @ block, values.sum()), 50, 8, guard=12)
        assert np.abs(got.values / np.sort(values)[::-1][:8] - 1).max() < 1e-9
        assert np.abs(v @ got.vectors - got.vectors * got.values).max() < 1e-8 * values.max()


def test_whitening_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 3)).astype(np.float32)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows = list(enumerate(good)) + [(None, good[0]), (3, good[3])] + [(100 + i, v) for i, v in enumerate(odd)]
    out = whitening.whitened(vectors(spark, rows), 8).collect()
    assert len(out) == 42 * 3 and {r.n for r in out} == {42} and {r.component for r in out} == {1, 2, 3}
    own, _, deviation = plain_whitening(good + [good[0], good[3]], 3)
    assert sorted(int(r.deviation) for r in out if r.component == 1) == sorted(deviation.tolist())
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [0.0]), (2, [0.0])]):
        assert whitening.whitened(vectors(spark, few)).count() == 0  # no variance, no component
    flat = [(i, [float(i % 7), 0.0, 5.0]) for i in range(30)]
    assert {r.component for r in whitening.whitened(vectors(spark, flat)).collect()} == {1}
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    assert whitening.whitened(vectors(spark, huge)).count() > 0


def test_sums_stay_exact_for_large_entries():
    fit = whitening.Means(3, np.array([10**15, 0], dtype=np.int64), np.array([1.0, 2.0]))
    assert fit.deviations(np.array([[10**15 + 10**12, 7]])) == [(3 * 10**12 - 1) ** 2 + (21 - 2) ** 2]


# -- lines ------------------------------------------------------------------------------


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def plain_lines(rows):
    """Kept text, lines and dropped lines of (doc_id, text) rows; None is a document after all others."""
    keys = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            first[keys(line)] = min(first.get(keys(line), float("inf")), order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(keys(x)) < 10 or first[keys(x)] == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_equal_plain_version(spark, batches):
    rng = random.Random(batches)
    pool = ["Shared line number %d" % i for i in range(30)] + ["short", "ÄÖÜ äöü ßßß ÄÖ", "äÖü äöü ßßß ÄÖ", "İstanbul İİİ x", "ten chars!", "9 chars!!"]
    texts = []
    for i in range(120):
        lines = [rng.choice([" ", "", "\t\v"]) + rng.choice([str, str.upper])(rng.choice(pool)) + rng.choice(["", " \r"]) for _ in range(rng.randint(0, 12))]
        texts.append("\n".join(lines + [f"line of document {i} alone"] * rng.randint(0, 2)))
    texts += [None, "", "\n", "\n\n", "the hot line of them all"] + ["the hot line of them all\nx"] * 200
    ids = [*range(len(texts) - 6), None, None, 3, 3, 3, 5]
    rows = list(zip(ids, texts))
    out = line_dedup.deduplicated(documents(spark, texts, ids), batches)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "n_dropped", "h1"}
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert sorted_rows(got) == sorted_rows(plain_lines(rows))


def test_lines_of_no_documents_and_of_a_long_one(spark):
    assert line_dedup.deduplicated(documents(spark, [])).count() == 0
    long = "\n".join(f"line number {i % 50_000}" for i in range(100_000))
    got = {r.doc_id: r for r in line_dedup.deduplicated(documents(spark, ["line number 7", long, long])).collect()}
    assert got[1].n_dropped == 2 and got[1].text == "\n".join(x for x in long.split("\n") if x != "line number 7")
    assert got[2].n_dropped == 100_000 and got[2].text == ""
    same = line_dedup.deduplicated(documents(spark, ["one line of its own"] * 50, [None] * 25 + [4] * 25), 3).collect()
    assert {(r.doc_id, r.n_dropped) for r in same} == {(None, 1), (4, 0)} and len(same) == 50


def test_runs_are_levelled_and_hold_each_key_once(spark):
    store, seen, sizes = line_dedup.LineRuns(spark, fanout=2), set(), []
    for batch in range(6):
        texts = ["\n".join(f"key {k} of the store" for k in range(batch * 5, batch * 5 + 12))]
        lines = line_dedup.hashed_lines(documents(spark, texts, [batch]))
        going = {r["at"] for r in store.add(lines).collect()}
        assert going == {k - batch * 5 for k in range(batch * 5, batch * 5 + 12) if k in seen}
        seen |= set(range(batch * 5, batch * 5 + 12))
        sizes.append([len(level) for level in store.levels])
    assert sizes == [[1], [2], [1, 1], [2, 1], [1, 0, 1], [2, 0, 1]]
    held = [r for run in store.runs() for r in run.collect()]
    assert len(held) == len(seen) == len({(r.h1, r.h2) for r in held})
    store.close()


def test_lines_plan_is_native(spark):
    plan = line_dedup.deduplicated(documents(spark, ["a line of text\nb"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# -- periodic runs ----------------------------------------------------------------------


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def test_runs_equal_plain_version():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 4, 8, 20, 60])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 4:
                a, q, m = rng.randrange(n), rng.randint(1, 15), rng.randint(12, 60)
                words[a:a + m] = (words[a:a + q] * m)[:len(words[a:a + m])]
        assert periodic.runs(np.array(words, dtype=np.int32)) == plain_runs(words)


def test_splitting_loses_no_run(monkeypatch):
    rng = random.Random(4)
    text = [rng.randrange(4000) for _ in range(3000)]
    text[500:900] = (text[500:537] * 20)[:400]
    text[2000:2030] = [1, 2, 1] * 10
    ids = np.array(text, dtype=np.int32)
    found = periodic.runs(ids)
    assert {(37, 400), (3, 30)} <= {(q, n) for _, n, q in found} and found == plain_runs(text)
    assert sum(b - a for a, b in periodic.segments(ids)) < 1000
    monkeypatch.setattr(periodic, "LOOKS", 0)
    assert periodic.runs(ids) == found


@pytest.mark.parametrize("words", [["ab"] * 300_000, ["a", "b", "a"] * 100_000])
def test_runs_of_very_long_texts(words):
    (found,) = [r for r in periodic.runs(periodic.numbered([w.encode() for w in words])) if r[1] > 100]
    assert found == (0, len(words), len(set(words)) if len(set(words)) == 1 else 3)


def edited(doc_id, words):
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_digests_equal_plain_version(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    texts += [None, "", " \t\n", "one", "x " * 40, "é é é " * 30, "x " * 40, "a\x0bb\x0ca\rb " * 9]
    ids = [*range(len(texts) - 3), None, 85, 85]
    got = periodic.run_digests(documents(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    mine = {(r.doc_id, r.runs_sha256, r.collapsed_sha256): r for r in got}
    for doc_id, text in zip(ids, texts):
        words = edited(doc_id, (text or "").encode().split())
        found = plain_runs(words)
        out = {i for s, n, q in found for i in range(s + q, s + n)}
        runs_text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in out)
        r = mine[doc_id, hashlib.sha256(runs_text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert r.n_runs == len(found) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)


def test_periodic_runs_of_rows(spark):
    out = {r.doc_id: r for r in periodic.periodic_runs(documents(spark, ["so " * 12 + "it ends", None, "é " * 3])).collect()}
    assert [tuple(r) for r in out[0].runs] == [(0, 12, 1)] and out[0].collapsed == "so it ends"
    assert out[1].runs == [] and out[1].collapsed == "" and out[2].collapsed == "é é é"
    assert periodic.run_digests(documents(spark, [])).count() == 0
