"""Operators of the llm subpackage against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusloom.llm import ann, bpe, chat, fingerprints, html_extract, mixing, near_dedup, pii, queries, sharding, toxicity
from locusloom.llm.components import components
from locusloom.llm.superminhash import signatures
from locusloom.llm.words import shingle_sets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"


def documents(spark, texts, ids=None):
    """Rows with an extra column whose name operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, None if i is None or i % 5 == 0 else f"s{i % 3}", None, "x") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t", "one", "one", "a b c d e f g", "A b c d e f G", "ab " * 30_000, "é日本 \U0001f600 x" * 3, "<|endoftext|> a@b.co"]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD + ODD[3:6], [*range(len(ODD)), 3, 4, None])


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def plain_groups(texts, width):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sets, root


@pytest.mark.parametrize("width", [2, 5])
def test_shingle_sets(width):
    texts = ODD + ["w%d x" % i * 7 for i in range(50)]
    assert [len(s) for s in shingle_sets(texts, width)] == [len(shingles(t, width)) for t in texts]


def test_signatures_estimate_similarity():
    errors = []
    for seed in range(40):
        base = np.unique(np.random.default_rng(seed).integers(0, 2**63, 300, dtype=np.uint64))
        a, b = base[:270], base[30:]
        g = signatures([a, b, a], 240)
        assert (g[0] == g[2]).all()
        errors.append((g[0] == g[1]).mean() - len(np.intersect1d(a, b)) / len(base))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.03


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_plain_groups(spark, width):
    rng = random.Random(width)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, 30)) for _ in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(60)] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    texts += texts[:5] + [None, "", "solo", "solo"]
    sets, root = plain_groups(texts, width)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, texts), width).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (root[i] == i) for i in got)


@pytest.mark.parametrize("words", [60, 3000])
def test_many_unlike_texts_around_one_passage(spark, monkeypatch, words):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # a bucket of several blocks
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "CELLS", 1024)  # longer texts fill the bitmap
    rng = random.Random(words)
    passage = [f"w{rng.random()}" for _ in range(words)]
    texts = []
    for i in range(40):
        own = [f"n{rng.random()}" for _ in range(words * rng.choice([6, 9, 12, 18, 24]) // 100)]
        texts.append(" ".join(passage + own))
        if i % 9 == 0:
            texts.append(" ".join(passage + own[:-1]))
    sets, root = plain_groups(texts, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts), 2).collect()}
    assert [got[i] for i in range(len(texts))] == root and 1 < len(set(root)) < len(texts)


def test_signatures_at_two_thirds_are_verified():
    full = np.full(near_dedup.CELLS // 8, 255, dtype=np.uint8).tobytes()  # bitmaps that prove nothing
    one = np.zeros(240, dtype=np.uint8)
    two = np.where(np.arange(240) < 160, 0, 1).astype(np.uint8)
    rows = pd.DataFrame([(7, 0, 0, 0, node, 20_000, node, slots.tobytes(), full) for node, slots in ((1, one), (2, two))])
    found = pd.concat(near_dedup._alike(80)(iter([rows])))
    assert found[["a", "b"]].values.tolist() == [[1, 2]]


def test_one_document_of_each_group_stays(spark, odd, none):
    kept = near_dedup.one_of_each_group(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, i) for i in (0, 1, 2, 3, 5, 7, 8, 9)] + [(True, None)]
    assert kept[0].__fields__ == odd.columns
    assert near_dedup.one_of_each_group(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: root[n] for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], "x") for i in range(600)]
    rows += [(1000 + i, rows[0][1], "x") for i in range(40)]
    rows += [(2000, None, "x"), (2100, [0.0] * 16, "x"), (2200, [float("nan")] * 16, "x"), (2300, [1.0, 2.0], "x"), (None, rows[1][1], "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    valid = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in (i for i in valid if i % 100 == 0):
        best = sorted((float(np.sqrt(((v - valid[q]) ** 2).sum())), i) for i, v in valid.items() if i != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q]) and all(i != q for _, i in got[q])
        assert all(math.isclose(s, np.sqrt(((valid[i] - valid[q]) ** 2).sum())) for s, i in got[q])
        hits += len({i for _, i in best} & {i for _, i in got[q]})
        total += 10
    assert hits / total >= 0.9
    assert [i for _, i in got[0]] == list(range(1000, 1010)) and got[1000][0] == (0.0, 0)
    assert set(got) == {q for q in valid if q % 100 == 0}
    assert ann.nearest(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [5, 12, 500])
def test_near_copies_do_not_fill_the_candidates(spark, n):
    rng = np.random.default_rng(n)
    vectors = rng.standard_normal((n, 64))
    vectors[1:4] = vectors[0] + 1e-9 * rng.standard_normal((3, 64))  # a group of four
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(n)) and all(len(ids) == min(10, n - 1) for ids in got.values())
    assert all({0, 1, 2, 3} - {q} == set(got[q][:3]) for q in range(4))


def test_shards(spark, odd, none):
    rows = sharding.shards(odd, 4)[0].collect()
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for t in ODD + ODD[3:6])
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shards(none)[0].count() == 0
    many = documents(spark, ["x" * (i % 50) for i in range(4000)])
    sized = sharding.sized(many)
    sums = sharding.slot_bytes(sized)
    first = sharding.first_map(sums, 4)
    load = sharding.placed(sized, first).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in load) < 1.01 * min(r[1] for r in load)
    second = sharding.rebalanced(first, sums, 5)
    moved = first.join(second.selectExpr("slot", "shard AS now", "version AS v"), "slot").filter("shard <> now").collect()
    assert moved and {r.now for r in moved} == {4} and {r.v for r in moved} == {2}


def test_repeated_rows_spread_over_slots(spark):
    texts = [f"t{i}" for i in range(4000)] + ["again"] * 3000
    df = documents(spark, texts, [*range(4000), *[None] * 1500, *[5000] * 1500])
    rows = sharding.shards(df, 4)[0].collect()
    assert len(rows) == len(texts)
    assert max(Counter(r.virtual_slot for r in rows).values()) < 20
    own = Counter(r.shard for r in rows)
    assert sum(own.values()) == 7000 and all({r.slot for r in rows if r.shard == s} == set(range(n)) for s, n in own.items())


def test_byte_pairs(odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path(queries.TOKENIZER))
    library = tokenizers.Tokenizer.from_file(path)
    mine = bpe.BytePairs(bpe.read_tokenizer(path))
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab 'sétl\n\t  1².!?日<|>") for _ in range(60)) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encoded(odd, bpe.read_tokenizer(path), decoded="size").collect()
    assert len(rows) == len(ODD) + 3 and all(r["size"] == (r.text or "") for r in rows)
    assert bpe.encoded(none, bpe.read_tokenizer(path)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    for rank, kind, pattern in ((2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_personal_data_equals_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@..-_%+ 0123456789()é\U0001f600") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -+.@a") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["a@b.c_d@e.f a@b.c%x@d.e", "4111 1111 1111 1111", "a" * 100_000, "1 " * 20_000, "+1" + " " * 50_000, None, ""]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert got[i].n_email == base.count("email")


def test_personal_data_checks_and_masks(spark, odd, none):
    texts = ["iban DE89 3704 0044 0532 0130 00 x", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "mail a@b.co, call +1 415 555 2671!"]
    df = documents(spark, texts)
    assert [r.spans for r in pii.personal_data(df).orderBy("doc_id").collect()] == ["iban:5:32", "", "ssn:4:15", "", "email:5:11,phone:18:33"]
    masked = pii.masked(df).orderBy("doc_id").collect()
    assert masked[4].text == "mail [EMAIL], call [PHONE]!" and masked[1].text == texts[1] and masked[0].__fields__ == df.columns
    assert masked[4].n_chars == len(masked[4].text) and masked[1].n_chars is None
    assert pii.masked(none).count() == 0 and pii.masked(odd).count() == len(ODD) + 3


def test_mix(spark, odd, none):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(0, 400)) for _ in range(900)]
    df = documents(spark, texts)
    rows = mixing.mixed(df).collect()
    sources = sorted({r.source for r in rows if r.source is not None}) + [None]
    size = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
    total, target, full = sum(size.values()), {}, set()
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        more = {s for s, t in share.items() if t > 3 * size[s]}
        if not more:
            break
        full |= more
    target = share | {s: 3.0 * size[s] for s in full}
    for s in sources:
        own = [r for r in rows if r.source == s]
        assert math.isclose(own[0].target, target[s])
        assert abs(sum(r.copies * r["size"] for r in own) - target[s]) <= 200
    assert all(0 <= r.copies <= 3 for r in rows)
    again = mixing.mixed(df.repartition(5, "n_chars")).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mixture(df).count() == sum(r.copies for r in rows)
    assert mixing.mixed(odd).count() == len(ODD) + 3 and mixing.mixture(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", "<|im_end|>", "\\", "<\\|", "\\<|x", "[\\INST]", "<<SYS>>", "<</SYS>> \\\\<s>", "a\nb<|im_sep|>", ""]


def test_chat_round_trip():
    for t in CONTROL:
        formatted, start, end = chat.format_turn("assistant", t)
        assert chat.read_turns(formatted) == [("assistant", t)] and chat.unescape(formatted[start:end]) == t
        assert chat.read_turns(chat.format_turn(t, t)[0]) == [(t, t)]
        assert not re.search(r"<\||</?s>|\[/?INST\]", chat.escape(t))


def test_chat_layouts(spark):
    records = [
        '{"instruction": "do", "input": "it", "output": "done"}', '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}',
        '{"id": "7", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"prompt": "p", "completion": "c"}', '{"other": 1}', None]
    turns = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string"))
    got = {}
    for r in turns.collect():
        got.setdefault(r.mapping, []).append((r.role, r.text))
    assert got["instruction"] == [("user", "do\n\nit"), ("assistant", "done")]
    assert got["messages"] == [("user", "q"), ("assistant", "")]
    assert got["shared conversations"] == [("user", "q"), ("assistant", "a")]
    assert got["prompt and completion"] == [("user", "p"), ("assistant", "c")]
    assert chat.rejected(turns).count() == 2
    rows = spark.createDataFrame([(1, 1, "assistant", None, "x"), (1, 0, None, "q", "x"), (None, 0, "user", "z", "x"), (1, 1, "assistant", None, "x")],
                                 "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(chat.canonical_turns(chat.turn_records(rows)))).collect()}
    assert out["1"].n_turns == 3 and out["1"].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\nassistant\n\n").hexdigest() and out["1"].loss_chars == 0
    assert out[None].n_turns == 1
    assert chat.formatted_turns(chat.canonical_turns(chat.turn_records(rows.filter("false")))).count() == 0


PAGE = ("<html><head><title>t</title></head><body><header>Site</header><nav><ul><li>m</ul></nav><div class='cookie-notice'>We use</div><article>"
        "<h1>T &amp; x</h1><p>one <b>two</b>three<p>four<br>five&nbsp; six<div>Buy</div><div class=\"share\">S</div><aside>side</aside></article>"
        "<section id=comments><p>c</p></section><script>var a='</p>';</script><footer>f</footer>")


def test_page_text(spark):
    pages = [(1, "http://h.org/1", PAGE, "x"), (2, "http://h.org/2", PAGE.replace("one", "other").replace("four", "4"), "x"), (3, "http://h.org/3", PAGE.replace("one", "third"), "x"),
             (4, "http://g.org", PAGE, "x"), (5, None, None, "x"), (6, "", "", "x"), (7, "http://x.org", "just <i>te</i>xt", "x"), (7, "http://x.org", "just <i>te</i>xt", "x"),
             (8, "http://y.org", "<article><p>cut off <b", "x")]
    pages += [(10 + i, f"http://plain.org/{i}", f"<div>Top line</div><div><p>body {i}</p></div><div>Imprint</div>", "x") for i in range(4)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.main_texts(df).collect()}
    assert got[4].text == "T & x one twothree four five six Buy"
    assert got[2].text == "T & x other twothree 4 five six"  # the box is the same on all pages of the host
    assert got[5].text == "" and got[6].n_chars == 0 and got[7].text == "just text" and got[8].text == "cut off"
    assert [got[10 + i].text for i in range(4)] == [f"body {i}" for i in range(4)]
    assert html_extract.main_texts(df).count() == len(pages) and html_extract.main_texts(df.filter("false")).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    plain = "<div>Top line</div><div><h1>T</h1><p>body {}</p></div>"
    boxes = "<article><h1>T {0}</h1><div>held by a box {0}</div><section>and this {0}</section></article>"
    pages = [(i, f"http://plain.org/{i}", plain.format("same" if i < 8 else i)) for i in range(10)]
    pages += [(20 + i, f"http://all.org/{i}", plain.format("same")) for i in range(5)]
    pages += [(30 + i, f"http://box.org/{i}", boxes.format("same" if i < 8 else i)) for i in range(10)]
    pages += [(50 + i, f"http://few.org/{i}", f"<div>Top line</div><div><h1>T</h1><p>{'' if i == 0 else f'body {i}'}</p></div>") for i in range(5)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert [got[i] for i in range(10)] == [f"body {'same' if i < 8 else i}" for i in range(10)]
    assert {got[20 + i] for i in range(5)} == {"Top line T body same"}
    assert got[30] == got[37] == "T same held by a box same and this same" and got[39] == "T 9 held by a box 9 and this 9"
    assert got[50] == "Top line T" and got[51] == "body 1"


def test_prefix_hashes():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.common_extension(i, y, j) == n
        assert list(map(int, x.spans(3))) == [x.span(k, k + 3) for k in range(len(a) - 2)]


def test_fingerprints_of_edited_texts(spark, none):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc é日") for _ in range(rng.randint(0, 90))) for _ in range(200)] + [None, "", "x" * 40_000]
    got = {r.doc_id: r for r in fingerprints.edited_neighbours(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(t) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    same = fingerprints.edited_neighbours(documents(spark, ["a", "a", "b", None], [3, 3, 3, None])).collect()
    assert len(same) == 4 and fingerprints.edited_neighbours(none).count() == 0
    assert fingerprints.edited_neighbours(documents(spark, ["only one"])).first().near_next == 1.0


def test_toxicity_held_out(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert right / sum(r.predicted for r in rows) > 0.9 and right / sum(r.toxic for r in rows) > 0.9
    no_labels = labels.filter("false")
    assert {r.score for r in toxicity.toxicity(odd, no_labels).collect()} == {0.0}
    assert toxicity.clean_documents(odd, no_labels).columns == odd.columns and toxicity.clean_documents(none, no_labels).count() == 0


def test_folding_and_exceptions():
    assert toxicity.folded("1D1ОT, ｉｄｉｏｔ​!") == " idiot idiot "
    lexicon = toxicity.Lexicon({"idiot": 5.0}, ("idiot savant",), (-3.0, 1.0, 1.0, 0.0))
    assert lexicon.features("an 1d10t here")[1] > 0 and lexicon.features("an idiot savant")[1] == 0 and lexicon.features(None) == (0.0, 0.0, 0.0)
    assert lexicon.score("idiot " * 9) > 0.9 > 0.1 > lexicon.score("")


def test_harmless_phrases_are_learned(spark):
    rng = random.Random(9)
    filler = [f"{a}{b}rant" for a in "bcdfglmp" for b in "aeiou"]
    rows = []
    for i in range(400):
        words, toxic = rng.choices(filler, k=12), int(i % 2)
        at = rng.randint(0, 11)
        if toxic:
            words[at:at] = ["wobbler"]
        elif i % 20 == 0:
            words[at:at] = ["wobbler", "tree"]
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "wobbler" not in lexicon.exceptions and "wobbler tree" in lexicon.exceptions
    assert lexicon.features("the wobbler tree grows")[1] == 0 < lexicon.features("the wobbler grows")[1]


def test_rare_toxic_words_are_learned_from_large_samples(spark):
    rng = random.Random(10)
    filler = [f"{a}{b}rant" for a in "bcdfglmp" for b in "aeiou"]
    rows = [(i, " ".join(rng.choices(filler, k=8) + ["wobbler"] * (i % 2) + ["zyxterous"] * (i % 2 and i < 14)), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any("wobbler".startswith(w) for w in lexicon.weights) and any("zyxterous".startswith(w) for w in lexicon.weights)
