"""Quality rules, decontamination and the classifiers on small tables with odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flightspark.llm import decontaminate, quality_crf, quality_rules, toxicity
from flightspark.llm.bytes_kit import Rolling, U64, Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "one two\tthree\x0bfour", "é ü x \x1f y", "a a a a a a", "Line\nLine\nLine\n", "x" * 5000, "語" * 300 + " " + "#*$" * 9,
       "The same words here and the same words here again", "The same words here and the same words here again", "A!! B!! C!!\r\nA!! B!! C!!"]


def frame(spark, rows, schema="doc_id long, text string, lang string, n_words long, text_ string"):
    return spark.createDataFrame([(i, t, "en", 7, "clash") for i, t in rows], schema)


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, t in enumerate(tri) if tri.count(t) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_words_of_a_slice_keep_to_their_rows():
    data, off = next((d, o) for _, _, d, o in slices(pa.array(["ab cd", None, "ef", " gh "])))
    w = Words(data, off)
    assert w.count.tolist() == [2, 0, 1, 1]
    assert [data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [b"ab", b"cd", b"ef", b"gh"]


def test_rolling_fingerprints_depend_on_content_only():
    x = np.array([5, 6, 7, 1, 5, 6, 7], U64)
    g = Rolling(x).grams(3)
    assert g[0] == g[4] and len(set(g.tolist())) == 4


def test_ledger_measures_and_policies(spark):
    rows = list(enumerate(ODD)) + [(None, "no id at all"), (3, "again")]
    got = quality_rules.apply_policy(quality_rules.ledger(frame(spark, rows))).toPandas()
    want = sorted((-1 if i is None else i, *measured(t)) for i, t in rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(map(tuple, got[cols].astype(int).values.tolist())) == want
    few = quality_rules.mask(["few_words"])
    assert ((got.bits & few != 0) == (got.n_words < 50)).all() and not got[got.n_words < 50].kept.any()


def test_ablation_counts_what_one_rule_decides(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,), (0,)], "bits long")
    out = {r["rule"]: (r["failed"], r["only_this"], r["kept_without"]) for r in quality_rules.ablations(rows, "base-1").collect()}
    assert out == {"few_words": (3, 2, 3), "repeat_words": (2, 1, 2)}
    empty = quality_rules.ablations(rows.limit(0), "base-1").collect()
    assert all((r["failed"], r["only_this"], r["kept_without"]) == (0, 0, 0) for r in empty)


def test_reject_keeps_columns_and_good_prose(spark):
    good = "This is a sentence with several different words. " * 1 + " ".join(f"word{i}" for i in range(60))
    docs = frame(spark, [(1, good), (2, "short"), (3, None)])
    out = quality_rules.reject(docs.withColumnRenamed("text_", "_m"))
    assert out.columns == ["doc_id", "text", "lang", "n_words", "_m"] and [r["doc_id"] for r in out.collect()] == [1]


def edit(text, n, rng):
    t = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.34:
            t[p] = "q"
        elif kind < 0.67:
            del t[p]
        else:
            t.insert(p, "z")
    return "".join(t)


def distance_in(item, text):
    """Least edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontamination_agrees_with_full_alignment(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    items = [(k, say(rng.randrange(6, 16))) for k in range(8)] + [(8, None), (9, "tiny"), (10, "")]
    items.append((11, items[0][1]))
    docs = []
    for k in range(40):
        body = items[k % 8][1]
        m = len(body)
        inner = edit(body, rng.choice([0, 1, m // 12, m // 10, m // 5]), rng) if k % 3 else ""
        docs.append((k, f"{say(10)}  {inner.upper() if k % 2 else inner}\n{say(5)}"))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (10_000, 60):
        got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), table, block_chars=block).collect()
        found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
        fold = lambda s: " ".join((s or "").lower().split())
        want = {}
        for d, text in docs:
            for k, item in items:
                item = fold(item)
                if len(item) >= decontaminate.Q:
                    e = distance_in(item, fold(text))
                    if e <= decontaminate.budget(len(item)):
                        want[d, k] = e
        assert found == want and sum(r["doc_id"] == 102 for r in got) == 2
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), table)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if not any(d == x for x, _ in want))


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.decontaminate(docs, none).count() == 1
    assert decontaminate.matches(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("module, target", [(toxicity, "toxic"), (quality_crf, "quality")])
def test_scores_on_held_out_rows(spark, module, target):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = module.fit(docs, labels)
    got = module.score(docs, model).join(labels.select("doc_id", target), "doc_id").toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0) == got.held_out).all()
    held = got[got.held_out]
    y, s = held[target] == 1, held.score.rank()
    auc = (s[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95 and got.score.between(0, 1).all()
    assert (held.predicted == held[target]).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality_crf])
def test_scores_of_odd_rows(spark, module):
    rows = list(enumerate(ODD)) + [(None, "no id"), (5, "twice")]
    docs = frame(spark, rows)
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id long, toxic int, quality int")
    for labels in (one_class, one_class.limit(0)):
        got = module.score(docs, module.fit(docs, labels)).toPandas()
        assert len(got) == len(rows) and got.score.isin([0.0, 1.0]).all()
    texts = pa.array(["bad line!! ###", "good line.", "", None] * 30)
    model = module.train(texts, np.array([0, 1, 0, 1] * 30))
    got = module.score(docs, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got.score.notna().all()
    assert module.score(docs.limit(0), model).count() == 0


def test_offending_sentences_are_located(spark):
    texts = pa.array(["All is fine here. You awful troll! Bye.", "All is fine here. Bye."] * 40)
    model = toxicity.train(texts, np.array([1, 0] * 40))
    docs = spark.createDataFrame([(1, "Hello there. What an awful troll! Yes."), (2, None)], "doc_id long, text string")
    out = toxicity.locate(docs, model).collect()
    assert [(r["doc_id"], r["sentence"]) for r in out] == [(1, "What an awful troll!")]


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    row = np.array([0, 0, 0, 2, 2, 5])
    e, t = rng.normal(size=6), rng.normal(size=(2, 2))
    odds = quality_crf.Chains(row).marginals(e, t)
    for r in set(row.tolist()):
        at = np.flatnonzero(row == r)
        weight = np.zeros((len(at), 2))
        for code in range(2 ** len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            score = np.exp(sum(e[i] * v for i, v in zip(at, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            for k, v in enumerate(y):
                weight[k, v] += score
        assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), odds[at])


def test_a_long_labelled_text_costs_the_sample_nothing_but_itself(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:60]
    texts = {i: "word " * 20 for i in ids} | {ids[0]: "x" * 5000, ids[1]: "y" * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("text", docs_unique())
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["label"] for r in toxicity.sample(docs, labels, "toxic", 60, 4000).collect()}
    assert set(got) == set(ids[2:]) and sum(got.values()) == 29
    assert toxicity.sample(docs, labels, "toxic", 60, 10).collect() == []


def docs_unique():
    from pyspark.sql import functions as F

    return F.concat("text", F.col("doc_id").cast("string"))


def _mixed_texts():
    """Random texts of few words with repeated rows, odd rows and a text of many lines; every other one is labelled."""
    rnd = random.Random(11)
    words = ["river", "Stone", "awful", "troll", "garden", "###", "walks!", "home.", "a|b", "Why?", "42", "ÜBER", "the", "of", "long" * 6]
    texts = ["\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))) for _ in range(rnd.randrange(1, 7))) for _ in range(120)]
    texts += texts[:10] + ODD + ["\n".join(f"line {k % 50} of {rnd.choice(words)}" for k in range(4000))]
    return texts, np.array([int(t is not None and ("awful" in t or "###" in t)) for t in texts])


def _offence(model, text):
    """Noisy-or over sentences, word by word."""
    data = (text or "").encode()
    found, last = [], None
    for w in re.finditer(rb"[^\x20\x09-\x0D]+", data):
        if last is None or data[last - 1: last] in (b".", b"!", b"?") or b"\n" in data[last: w.start()]:
            found.append([])
        last = w.end()
        found[-1] += re.sub(rb"[!-/:-@\[-`{-~]", b" ", w.group()).lower().split()
    if not found:
        return model.prior
    none = 1.0
    for sentence in found:
        z = model.bias
        for word in sentence:
            z += model.weights[toxicity.sentences(np.frombuffer(word, np.uint8), np.array([0, len(word)])).feature].sum()
        none *= 1 - 1 / (1 + np.exp(-z))
    return 1 - none


def _good_share(model, text):
    """Features of lines by plain counting, forward and backward sums by hand, and the curve over the weighted share."""
    data = (text or "").encode()
    per_line = [(x, re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in data.split(b"\n")]
    per_line = [(x[x.index(ws[0]): x.rindex(ws[-1]) + len(ws[-1])], ws) for x, ws in per_line if ws]
    if not per_line:
        return model.prior
    flat = [w for _, ws in per_line for w in ws]
    tri = [tuple(flat[i:i + 3]) for i in range(len(flat) - 2)]
    often = {t for t, n in zip(*np.unique(np.array([b"\0".join(t) for t in tri], dtype=object), return_counts=True)) if n > 1} if tri else set()
    own, sizes, at, seen = [], [], 0, set()
    for body, ws in per_line:
        n, size = len(ws), sum(map(len, ws))
        many = lambda chars: sum(body.count(bytes([c])) for c in chars)
        upper, lower = sum(65 <= c <= 90 for c in body), sum(97 <= c <= 122 for c in body)
        again = sum(b"\0".join(tri[i]) in often for i in range(at, min(at + n, len(tri))))
        own.append([min(many(b"#*$%&|<>") / n, 2), upper > lower, min(many(b"!") / n, 2), many(b"0123456789") / size, min(many(b"|") / n, 2),
                    sum(a == b for a, b in zip(ws, ws[1:])) / n, again / n, body in seen, body[-1:] in [bytes([c]) for c in b".!?:;\"')"], n < 4, size > 15 * n])
        sizes.append(size)
        seen.add(body)
        at += n
    zero = [0.0] * quality_crf.NEAR
    near = lambda i: own[i][:quality_crf.NEAR] if 0 <= i < len(own) else zero
    e = [float(np.dot(np.array([*own[i], *near(i - 1), *near(i + 1), 1.0], float), model.emit)) for i in range(len(own))]
    ahead, back = [np.array([0.0, e[0]])], [np.zeros(2)]
    for x in e[1:]:
        ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.move, axis=0) + np.array([0.0, x]))
    for x in e[:0:-1]:
        back.append(np.logaddexp.reduce(model.move + (back[-1] + np.array([0.0, x]))[None, :], axis=1))
    odds = np.array([f + b for f, b in zip(ahead, back[::-1])])
    good = 1 / (1 + np.exp(odds[:, 0] - odds[:, 1]))
    share = np.clip(np.dot(sizes, good) / sum(sizes), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift)))


@pytest.mark.parametrize("module, plain", [(toxicity, _offence), (quality_crf, _good_share)])
def test_scores_equal_plain_loops(spark, module, plain):
    texts, labels = _mixed_texts()
    model = module.train(pa.array(texts), labels)
    got = {r["doc_id"]: r for r in module.score(frame(spark, list(enumerate(texts))), model).collect()}
    assert len(got) == len(texts) and len({round(r["score"], 6) for r in got.values()}) > 20
    for k, text in enumerate(texts):
        assert got[k]["score"] == pytest.approx(plain(model, text), abs=1e-6)
    for k in range(10):
        assert got[k]["score"] == got[120 + k]["score"]  # repeated rows
