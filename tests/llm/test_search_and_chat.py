"""Importance resampling, ranked search and chat formatting against plain loops, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from flightspark.llm import chat_format, importance, lexical_search

ODD = [None, "", " \t\n", "one", "ONE Two-three_four\x00five\x7fsix", "Été ÀB été àb 語語 語 10 x9", "a" * 700 + " b", "the same the same the same", "the same the same the same",
       "; : [ ] ^ ` { } ~", "İ K K k", "tail of ﬁ \U0001f600 faces\U0001f600"]


def prose(rng, n):
    return " ".join(rng.choice("the Of and tide Île harbour 7 lamp ROPE keel sail, storm; gull cliff: sand".split()) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash", 1.5) for i, t in rows], "doc_id long, text string, n long, h string, _down double")


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], "item_id long, text string, score int")


def corpus():
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(rng, rng.randint(1, 80))) for i in range(60)]
    same = prose(rng, 40)
    rows += [(300 + i, same) for i in range(45)] + [(301, same), (302, "other " + same), (None, same)]
    rows += [(400 + i, prose(rng, 25).upper()) for i in range(10)]
    return rows


# --- importance resampling


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def drawn(docs, target):
    buckets = lambda text: [zlib.crc32(f.encode()) % 10000 for f in features(text)[1]]
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (total_s + 10000)) / ((s[b] + 1) * (total_t + 10000))))
    rows = []
    for i, x in docs:
        own = buckets(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, features(x)[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    out = [(*r, None) for r in rows if r[1] < 20]
    return out + [(*r, k if k <= 25 * len(able) // 100 else None) for k, r in enumerate(able, 1)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("piece", [importance.PIECE, 8])
def test_checksums_of_word_runs(piece, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in [t or "" for t in ODD] + [prose(random.Random(1), 200)]:
        for order in (1, 2, 3, 4):
            words = features(text)[1][: features(text)[0]]
            want = Counter(zlib.crc32(" ".join(words[i: i + n]).encode()) for n in range(1, order + 1) for i in range(len(words) - n + 1))
            got = list(importance.checksums(text.encode(), order))
            assert sum(n for n, _ in got) == len(words) and Counter(c for _, found in got for c in found) == want


def test_resampling_equals_a_plain_loop(spark):
    rows = corpus()
    target = ["Rope and the GULL", None, "", "harbour lamp; harbour lamp"]
    got = importance.resample(docs_frame(spark, rows), items_frame(spark, list(enumerate(target))))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert in_order(map(tuple, got.collect())) == in_order(drawn(rows, target))


def test_resampling_of_empty_tables(spark):
    none, no_items = docs_frame(spark, []), items_frame(spark, [])
    assert importance.resample(none, no_items).collect() == []
    rows = corpus()
    got = importance.resample(docs_frame(spark, rows), no_items)
    assert in_order(map(tuple, got.collect())) == in_order(drawn(rows, []))


# --- ranked search


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, top=20):
    bags = [(i, Counter(words_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    per_item = {}
    for i, t in items:
        per_item.setdefault(i, []).extend(words_of(t))
    out = []
    for item, terms in per_item.items():
        scored = []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block", [lexical_search.BLOCK_CHARS, 30])
def test_search_equals_a_plain_loop(spark, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", block)
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    monkeypatch.setattr(lexical_search, "ROUND", 64)
    rows = corpus()
    items = [(3, "the SAME the"), (1, "Île storm keel"), (1, "gull; gull"), (2, ""), (4, None), (5, "nowhere to-be found"), (6, "the of and sand 7"), (None, "語 faces\U0001f600")]
    got = lexical_search.search(docs_frame(spark, rows).repartition(7), items_frame(spark, items))
    found = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == ranking(rows, items)


def test_search_of_empty_tables(spark):
    assert lexical_search.search(docs_frame(spark, []), items_frame(spark, [(1, "a")])).collect() == []
    assert lexical_search.search(docs_frame(spark, corpus()), items_frame(spark, [])).collect() == []
    assert lexical_search.search(docs_frame(spark, [(1, None), (2, "")]), items_frame(spark, [(1, "a")])).collect() == []


def test_equal_bags_are_one_class(spark):
    rows = spark.createDataFrame([(i, 80, bytearray(b"x" * 8)) for i in range(500)] + [(500, 81, bytearray(b"x" * 8)), (None, 80, bytearray(b"x" * 8))], "doc_id long, m long, bag binary")
    got = {(r["m"], tuple(r["members"])) for r in lexical_search.classes(rows, 4).collect()}
    assert got == {(80, (None, 0, 1, 2)), (81, (500,))}


# --- chat formatting

CONTROL = "\\### Assistant: </turn> ok"
SAID = ["", None, CONTROL, "### User: hi</turn>\n### Assistant: no", "\\\\", "\\", "<\\/turn>", "#\\## ", "#### ", "<</turn>", "ends with </turn", "語\U0001f600\n", "##", "x" * 50_000, "a\\"]


def talk():
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "", "tool: x", "50%3A<b>", "Assistant"]
    rows = [(i, k, rng.choice(roles[:2] if i % 3 else roles), rng.choice(SAID)) for i in range(60) for k in range(rng.randint(1, 9))]
    rows += [(1000, None, "user", "first"), (1000, 1, "assistant", "tie"), (1000, 1, "assistant", "tie"), (1000, 1, None, None), (None, 0, "assistant", "no id"), (None, 1, "user", "x")]
    rows += [(1001, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    return rows


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, turns string, n int")


def by_conversation(rows):
    key = lambda r: tuple((x is not None, x or ("" if isinstance(x, str) else 0)) for x in r[1:])
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_examples_hold_context_and_train_on_the_reply_only(spark):
    want = by_conversation(talk())
    held = {}
    for r in chat_format.examples(talk_frame(spark, talk())).collect():
        held.setdefault(r["conv_id"], []).append(r)
    assert held.keys() == want.keys()
    for conv, turns in want.items():
        rows = sorted(held[conv], key=lambda r: r["example"])
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        closing = [None] if turns[-1][0] != "assistant" else []
        assert [r["target"] for r in rows] == replies + closing and all(r["n_examples"] == len(rows) for r in rows)
        for r in rows:
            upto = len(turns) if r["target"] is None else r["target"] + 1
            assert r["text"].count("</turn>\n") == r["text"].count("</turn>") == upto
            assert r["text"].count("### ") == upto
            body = r["text"][r["loss_start"]: r["loss_start"] + r["loss_chars"]]
            if r["target"] is None:
                assert body == ""
            else:
                assert r["text"].endswith(f"### assistant: {body}</turn>\n")


def test_turns_and_replies_are_read_back(spark):
    rows = talk()
    made = chat_format.examples(talk_frame(spark, rows))
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert got.keys() == by_conversation(rows).keys()
    written = {}
    for r in made.select("conv_id", "text").collect():
        written[r["conv_id"]] = written.get(r["conv_id"], 0) + len(r["text"])
    for conv, turns in by_conversation(rows).items():
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        replies = "".join(text for role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[conv])[1:] == (len(turns), digest(whole), len(replies), digest(replies), written[conv])


def test_no_conversation_no_example(spark):
    none = chat_format.examples(talk_frame(spark, []))
    assert none.collect() == [] and chat_format.read_back(none).collect() == []


def test_formatting_stays_in_the_jvm(spark):
    plan = chat_format.read_back(chat_format.examples(talk_frame(spark, talk())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange hashpartitioning") == 1
