"""Near duplicates, repeated words and repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flightspark.llm import probminhash, runlength, seeds, substring
from flightspark.llm.bytes_kit import mix, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 5) for i, t in rows], "doc_id long, text string, lang string, spans int, seed int")


def corpus(seed, docs=120, vocabulary=400):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    common, rows = [say(80), say(55)], []
    for i in range(docs):
        kind = i % 6
        words = say(rng.randrange(0, 160))
        if kind == 1:
            words = words[:40] + common[i % 2] + words[40:]
        elif kind == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = "edited"
        elif kind == 3:
            words = common[0][10:70] + words[:5] + common[0][:60]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows + [(docs, None), (docs + 1, ""), (docs + 2, "one two"), (docs + 3, "one two"), (None, rows[1][1]), (7, rows[7][1]), (docs + 4, "é ü " * 200)]


def shingle_sets(texts):
    out = {}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        out[k] = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return out


def probability_jaccard(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in both) for d in set(a) & set(b))


def test_similarity_is_the_probability_jaccard():
    rng = random.Random(1)
    for _ in range(50):
        a, b = Counter(rng.choices(range(12), k=15)), Counter(rng.choices(range(12), k=15))
        pair = [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        exact, plain = probminhash.similarity(*pair)
        assert exact == pytest.approx(probability_jaccard(a, b)) and plain == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))


def test_components_agree_as_often_as_the_similarity_says():
    a, b = {k: 1 + k % 3 for k in range(1, 60)}, {k: 1 + k % 2 for k in range(15, 75)}
    rows = np.array([0] * len(a) + [1] * len(b))
    items = mix(np.array([*a, *b], np.uint64))
    sig = probminhash.signatures(rows, items, np.array([*a.values(), *b.values()]), 2, 6000)
    want = probability_jaccard(Counter(a), Counter(b))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_classes_against_all_pairs(spark):
    rows = corpus(3)
    got = {r["doc_id"]: r for r in probminhash.classes(table(spark, rows)).collect()}
    texts = defaultdict(list)
    for i, t in rows:
        if i is not None:
            texts[i].append(t or "")
    sets = shingle_sets({(i, k): t for i, ts in texts.items() for k, t in enumerate(ts)})
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            same = texts[a[0]][a[1]] == texts[b[0]][b[1]]
            pa, pb = sets[a], sets[b]
            if same or (set(pa) & set(pb) and max(probability_jaccard(pa, pb), len(set(pa) & set(pb)) / len(set(pa) | set(pb))) >= 0.8):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in texts}
    kept = probminhash.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "spans", "seed"]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([-1] + [i for i in texts if find(i) == i])


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        for p in rng.sample(range(200), 2):
            words[p] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:20] + [f"y{i}_{k}" for k in range(100)])) for i in range(100)]
    got = probminhash.classes(table(spark, rows)).toPandas()
    assert (got[got.doc_id < 300].class_id == 0).all() and (got[got.doc_id >= 1000].class_id == got[got.doc_id >= 1000].doc_id).all()


def test_links_inside_a_family_alike_just_below_the_limit(spark):
    """Pairs at 0.81 within a family at 0.78, of which a bucket's hubs are no part."""
    base, rows = [f"b{i}" for i in range(104)], []
    for i in range(80):
        rows.append((i, " ".join(base + [f"p{i // 2}_{k}" for k in range(2)] + [f"u{i}_{k}" for k in range(12)])))
    sets = shingle_sets(dict(rows))
    alike = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8}
    assert alike == {(i, i + 1) for i in range(0, 80, 2)}
    got = {r["doc_id"]: r for r in probminhash.classes(table(spark, rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: i // 2 * 2 for i in range(80)}
    assert {r["n_links"] for r in got.values()} == {1}


def test_near_copies_by_plain_jaccard_only(spark):
    """One passage of a copy comes 50 times, so the probability Jaccard similarity is about 0.25 and the plain one 0.94."""
    rows = []
    for i in range(0, 40, 2):
        text, passage = [f"w{i}_{k}" for k in range(204)], [f"r{i}_{k}" for k in range(12)]
        rows += [(i, " ".join(text)), (i + 1, " ".join(text + passage * 50))]
    a, b = (shingle_sets(dict(rows))[i] for i in (0, 1))
    assert probability_jaccard(a, b) < 0.3 and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.9
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(table(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}


def word_cut(rows, length):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k:k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = {k + d for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k:k + length])] < i for d in range(length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, seed", [(50, 10), (12, 4)])
def test_words_cut_against_all_windows(spark, length, seed):
    rows = corpus(5)
    unit = seeds.Unit(words=True, length=length, seed=seed)
    out = substring.remove_repeats(table(spark, rows), unit)
    got = out.selectExpr("coalesce(doc_id, -1) d", "_cut.n_words", "_cut.n_removed", "_cut.kept_sha256").collect()
    assert sorted(map(tuple, got)) == word_cut(rows, length)
    texts = {r["doc_id"]: r["text"] for r in substring.dedup_text(table(spark, rows), unit).collect()}
    want = {d: s for d, _, _, s in word_cut(rows, length)}
    assert all(hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest() == want[-1 if i is None else i] for i, t in texts.items())


def byte_cut(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        lost = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                lost[k:k + length] = True
        kept = bytes(c for c, x in zip(b, lost) if not x)
        spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if len(b) else 0
        out.append((-1 if i is None else i, len(b), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, seed, kinds, block", [(400, 32, 600, 1 << 19), (60, 12, 600, 500), (60, 12, 1, 1 << 19)])
def test_bytes_cut_against_all_strings(spark, length, seed, kinds, block):
    rows = corpus(6, 80) + [(500, "ab" * 400), (501, "漢字かな" * 120)]
    unit = seeds.Unit(words=False, length=length, seed=seed)
    out = runlength.remove_repeats(table(spark, rows), unit, block_kinds=kinds, block_bytes=block)
    got = out.selectExpr("coalesce(doc_id, -1) d", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256").collect()
    assert sorted(map(tuple, got)) == byte_cut(rows, length)


def test_matching_statistics_of_a_block():
    rng = random.Random(2)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    bodies += [bodies[0] + b"c", bodies[3]]
    size = [len(b) for b in bodies]
    for length in (1, 5, 12):
        count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
        want = {(k, i) for k, b in enumerate(bodies) for i in range(size[k] - length + 1) if count[b[i:i + length]] > 1}
        got = {(int(w), int(a) + d) for w, a, n in zip(*runlength.repeated_in(bodies, length)) for d in range(n)}
        assert got == want


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).limit(0)
    assert probminhash.classes(none).count() == 0 and probminhash.keep_one(none).count() == 0
    assert substring.remove_repeats(none).count() == 0 and runlength.remove_repeats(none).count() == 0


def test_shingles_of_slices_do_not_cross_rows():
    import pyarrow as pa

    data, off = next((d, o) for _, _, d, o in slices(pa.array(["a b c d e f", "g h", None])))
    row, _, count = probminhash.shingles(data, off)
    assert row.tolist() == [0, 0, 1] and count.tolist() == [1, 1, 1]


def test_contested_members_meet_on_early_shingles_only(spark):
    """A family of one text, each copy changed in places of its own: alike below the limit, some pairs above it."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]

    def changed(words, n, tag):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"{tag}x{k}"
        return words

    family = [changed(base, 6, f"m{i}") for i in range(120)]
    for i in range(0, 40, 2):  # every second one gets a partner of its own
        family[i + 1] = changed(family[i], 1, f"p{i}")
    family += [changed(base, rng.randrange(0, 3), f"n{i}") for i in range(20)]
    family += [f * 2 for f in family[:6]] + [family[3] + family[3][:10]]  # weights other than one
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    sets = shingle_sets(dict(rows))
    want = {(a, b) for a in sets for b in sets if a < b and max(probability_jaccard(sets[a], sets[b]), len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) >= 0.8}
    ranked = spark.createDataFrame([(1, i, len(rows)) for i, _ in rows], "key long, doc_id long, n long")
    alone = spark.createDataFrame([(i, i) for i, _ in rows], "doc_id long, class_id long")
    found = {tuple(r) for r in probminhash.rest(table(spark, rows), ranked, alone).collect()}
    top = max(i for i, _ in rows)  # the largest of equal classes; who is inside it needs no other member of it
    assert {p for p in want if p != (top, top)} <= found and len(found) < 3 * len(want) < len(rows) ** 2 / 8
