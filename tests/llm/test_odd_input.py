"""Inputs that operators must neither lose nor stop at."""

import json
import math
import random
import sys
import time
from functools import lru_cache

import pytest

from locusloom.llm import chat, html_extract, mixing, pii, toxicity

DOCS = "doc_id bigint, text string"


# -- account numbers --------------------------------------------------------------------


def accounts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    found = []
    for i, text in enumerate(texts):
        spans = [s.split(":") for s in out[i].split(",") if s.startswith("iban")]
        found.append([text[int(a):int(b)] for _, a, b in spans])
    return found


def test_words_behind_an_account_number(spark):
    spanish, german, norse = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    texts = [
        f"konto {spanish} BANK OF X", f"{spanish} international", f"{spanish} {german} and {norse} AB", f"{german}. {german}, x",
        german.replace(" ", "") + " BANK OF", f"iban {german.lower()} bitte zahlen", f"see {german.lower()}", german[:-1] + "1 BANK",
        "DE89 3704 0044 0532 0130 0", "x" + german, german.replace(" ", "") + "X" * 20, f"é\U0001f600 {norse}", "ab12 " * 2000]
    assert accounts(spark, texts) == [
        [spanish], [spanish], [spanish, german, norse], [german, german], [german.replace(" ", "")], [german.lower()], [], [], [], [], [], [norse], []]


# -- chat records -----------------------------------------------------------------------


def test_records_without_a_key_stay_apart(spark):
    record = json.dumps({"prompt": "p", "completion": "c"})
    more = json.dumps({"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "a"}], "category": 3})
    turns = chat.canonical_turns(spark.createDataFrame([(record,), (record,), (more,)], "record string"))
    groups = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        groups.setdefault(r.conv_id, []).append((r.role, r.text))
    assert sorted(groups.values()) == [[("user", "p"), ("assistant", "c")]] * 2 + [[("user", "u"), ("assistant", "a")]]
    digests = chat.conversation_digests(chat.formatted_turns(turns)).collect()
    assert sorted(r.n_turns for r in digests) == [2, 2, 2]


def test_records_that_cannot_be_read_are_unknown(spark):
    bad = [None, "", "{", "[]", '"x"', "5", '{"messages": ["x"]}', '{"messages": [1, null]}', '{"messages": 5}', "[" * 100_000, '{"a": ' * 50_000,
           '{"messages": []}', '{"prompt": "only"}']
    turns = chat.canonical_turns(spark.createDataFrame([(x,) for x in bad], "record string"))
    assert [r.mapping for r in turns.collect()] == ["unknown"] * len(bad) and chat.rejected(turns).count() == len(bad)
    odd = [{"conv_id": 7, "turn": t, "role": "user", "text": "\ud800x"} for t in ("3", "x", 2.5, 10**30, None, True, float("inf"))]
    rows = chat.canonical_turns(spark.createDataFrame([(json.dumps(r),) for r in odd], "record string")).collect()
    assert [r.turn for r in rows] == [3, None, None, None, None, 1, None] and {(r.conv_id, r.text) for r in rows} == {("7", "�x")}


# -- pages ------------------------------------------------------------------------------


def read(page):
    return [t for t in html_extract.skeleton(page)[3] if t]


def test_names_of_wrappers_empty_no_page():
    assert read('<div class="layout has-sidebar"><p>Hello world</p></div>') == ["Hello world"]
    assert read("<form><h1>T</h1><p>Hello</p><button>go</button></form>") == ["T", "Hello"]
    assert read('<article class="post comment-open social"><p>Hi</p></article>') == ["Hi"]
    assert read("<p title=it's>Hello you</p><p>don't</p>") == ["Hello you", "don't"]
    comments = '<div class="comments"><article class="comment"><p>' + "c " * 50 + "</p></article></div>"
    assert read(f'<h1>T</h1><div class="has-sidebar"><article><p>the text of the article</p></article></div>{comments}') == ["the text of the article"]
    assert read(f'<p>Text</p><form><p>mail</p></form><div class="sidebar">links</div>{comments}') == ["Text"]
    assert read("<p>a</p><script>if (1 > 0) b") == ["a"] and read("<p>a</p><!-- x > y") == ["a"] and read("<p>a</p>b <i") == ["a", "b"]
    assert read("a <p x='b'>c > d") == ["a", "c > d"]


def test_deep_long_and_broken_pages_take_seconds():
    started = time.time()
    deep, other = (html_extract.skeleton("<div>" * n + x + "</div>" * n) for n, x in ((5000, "x"), (4000, "<p>y</p>")))
    assert len(html_extract.align(deep[:2], other[:2])) >= 4000
    rng = random.Random(1)
    lists = [html_extract.skeleton("<ul>" + "".join(f"<li>{'<p>a</p>' * rng.randint(1, 3)}</li>" for _ in range(10_000)) + "</ul>") for _ in range(2)]
    pairs = html_extract.align(lists[0][:2], lists[1][:2])
    assert len(pairs) > 0.8 * min(len(x[0]) for x in lists) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    for page in ('<p title="x ' * 5000, "<a href='" * 9000, "<p " * 50_000, "<a b=\"c' " * 9000 + ">", "<" * 100_000, "<div " * 30_000 + ">"):
        html_extract.parse(page)
    assert time.time() - started < 60


def plain_size(a, b):
    below_a, below_b = html_extract._children(a[0]), html_extract._children(b[0])

    @lru_cache(None)
    def size(i, j):
        if a[1][i] != b[1][j]:
            return 0
        x, y = below_a[i], below_b[j]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + size(x[p - 1], y[q - 1]))
        return 1 + best[-1][-1]

    return size(0, 0), below_a, below_b


def test_alignment_equals_plain_tree_matching():
    rng = random.Random(3)

    def tree(n, k):
        depths, labels = [0], [1]
        for _ in range(n - 1):
            depths.append(rng.randint(1, min(depths[-1] + 1, 6)))
            labels.append(rng.randint(1, k))
        return depths, labels

    assert sys.getrecursionlimit() >= 500
    for _ in range(600):
        a = tree(rng.randint(1, 40), rng.choice([1, 2, 3]))
        b = tree(rng.randint(1, 40), rng.choice([1, 2, 3])) if rng.random() < 0.5 else (a[0], [1] + [x if rng.random() < 0.8 else 9 for x in a[1][1:]])
        want, below_a, below_b = plain_size(a, b)
        pairs = html_extract.align(a, b)
        assert len(pairs) == want == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        up_a, up_b = ({c: i for i, own in enumerate(below) for c in own} for below in (below_a, below_b))
        assert all(a[1][i] == b[1][j] and (i == 0 or (up_a[i], up_b[j]) in pairs) for i, j in pairs)
        assert [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)


# -- lexicon ----------------------------------------------------------------------------


def naive_features(lexicon, text):
    """Hits word by word, without an automaton."""
    words = toxicity.folded(text).split()
    harmless = set()
    for phrase in lexicon.exceptions:
        own = phrase.split()
        harmless |= {i + k for i in range(len(words)) if words[i:i + len(own)] == own for k in range(len(own))}
    total = 0.0
    for i, word in enumerate(words):
        hits = [w for p, w in lexicon.weights.items() if (word + " ").startswith(p)]
        total += max(hits) if hits and i not in harmless else 0.0
    return total


@pytest.fixture(scope="module")
def many_words(spark):
    """600 toxic words, each in about 30 toxic texts and in no clean one, and two short ones."""
    rng = random.Random(8)
    letters = "bcdfghjklmnprstvwz"
    made = sorted({"".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(5)) for _ in range(3000)})
    toxic, plain = made[:600], made[700:]
    rows, labels = [], []
    for i in range(4000):
        bad = i % 2
        words = [rng.choice(plain) for _ in range(30)]
        if bad:
            words += rng.sample(toxic, 12)
        words += rng.sample(["xq", "zzv"] if bad and i % 5 == 1 else ["of", "the"], 1)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, bad))
    docs = spark.createDataFrame(rows + [(5000 + k, rows[1][1]) for k in range(500)], DOCS)
    more = [(5000 + k, 0, 1) for k in range(500)]
    return toxic, rows, toxicity.learn(docs, spark.createDataFrame(labels + more, "doc_id bigint, quality int, toxic int"))


def test_every_toxic_word_is_learned(many_words):
    toxic, _, lexicon = many_words
    found = [w for w in toxic if any(w.startswith(p) for p in lexicon.weights)]
    assert len(found) >= 595 and {"xq ", "zzv "} <= set(lexicon.weights)
    assert lexicon.score("xq") > lexicon.score("xqa") and lexicon.score("a zzv b") > lexicon.score("a zzvb b")
    patterns = sorted(lexicon.weights)
    assert not any(b.startswith(a) for a, b in zip(patterns, patterns[1:]))


def test_matching_equals_a_plain_search(many_words):
    _, rows, lexicon = many_words
    rng = random.Random(2)
    for _, text in rng.sample(rows, 200):
        odd = text.replace("o", "0").replace("e", "е") if rng.random() < 0.5 else text.upper()
        assert abs(lexicon.features(odd)[1] - math.log1p(naive_features(lexicon, odd))) < 1e-9


# -- mixing -----------------------------------------------------------------------------


def test_rows_without_ids_spread_over_the_buckets(spark, monkeypatch):
    """A third of the rows without doc_id, and one doc_id many times, of one size and source: numbered and dealt out, none lost."""
    monkeypatch.setattr(mixing, "RUN", 64)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(None, "a b c", "s")] * 500 + [(7, "a b c", "s")] * 300 + [(i, "w " * (i % 40), "st"[i % 2]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    groups = mixing.sizes(docs).groupBy("doc_id", "source", "size").count().withColumnRenamed("count", "n")
    again = mixing.numbered(groups).collect()
    copies = sorted(r["copy"] for r in again if r.doc_id is None)
    assert len(again) == len(rows) and copies == list(range(500))
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 500 and max(r.copies for r in out) <= mixing.MOST_COPIES
    for source in "st":
        taken = sum(r.copies * r["size"] for r in out if r.source == source)
        (target,) = {r.target for r in out if r.source == source}
        assert abs(taken - target) <= 40
