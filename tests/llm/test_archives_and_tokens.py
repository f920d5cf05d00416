"""WARC files, token counts, pieces, and the pipeline as a whole."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from flightspark.llm import sentencepieces, token_counts, warc

sentencepiece = pytest.importorskip("sentencepiece")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, digest string")


ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, "<p>x</p>"), (4, "http://a/4\r\nX: y", None), (5, "u", ""), (9, "u", "<p>x</p>"),
        (9, "again", "<p>x</p>"), (7, "big", "z" * 300_000), (8, "gz", "a\r\n\r\nWARC/1.1\r\n"), (None, "nokey", "alone"), (None, "nokey", "<p>é</p>")]


def test_archives_round_trip_and_are_deterministic(spark, tmp_path):
    seen = []
    for k, parts in enumerate((1, 5)):
        folder = str(tmp_path / f"w{k}")
        manifest = warc.write_archives(pages(spark, ROWS).repartition(parts), folder, shard_bytes=100, file_bytes=150)
        back = warc.read_archives(manifest, folder, payloads=True).collect()
        assert len(back) == len(ROWS) and all(r["intact"] for r in back)
        seen.append(sorted((r["path"], r["sha256"], r["records"]) for r in manifest.collect()))
        groups = {}
        for i, _, h in ROWS:
            groups.setdefault(h or "", []).append(-1 if i is None else i)
        for r in back:
            text = next(h for h in groups if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r["payload_digest"])
            top = max(groups[text])
            if r["record_type"] == "response":
                assert (-1 if r["page_id"] is None else r["page_id"]) == top and r["payload"] == text.encode() and r["refers_to"] is None
            else:
                assert r["refers_to"] == top and r["payload"] is None
            assert r["payload_bytes"] == len(text.encode())
        assert sum(r["record_type"] == "response" for r in back) == len(groups)
        raw = b"".join(gzip.decompress((tmp_path / f"w{k}" / p).read_bytes()) for p, _, _ in seen[-1])
        assert raw.count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)
        assert not list((tmp_path / f"w{k}" / "_temporary").glob("*"))
    assert seen[0] == seen[1] and len(seen[0]) > 3


def test_archive_of_nothing(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS).limit(0), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_archives(manifest, str(tmp_path / "w")).count() == 0


def test_commit_can_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(pages(spark, ROWS), folder)
    assert manifest.mapInArrow(warc._committer(folder), warc.MANIFEST).count() == manifest.count()


def test_counts_follow_random_edits():
    encoding = token_counts.Tokenizer.load().encoding()
    rng = random.Random(11)
    words = ["the", "a1", "über", "x", "  ", "\n", "don't", "I'll", "漢字", "12345", "!!", "foo", " bar"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))).encode()
        ends = token_counts.leaf_ends(np.frombuffer(text, np.uint8), 40)
        nodes = token_counts.grow(token_counts._tokens(encoding, [text[a:b] for a, b in zip([0, *ends], ends)]))
        assert (nodes[1] if nodes else 0) == len(encoding.encode_ordinary(text.decode()))
        s = text.decode()
        cuts = sorted(rng.choices(range(len(s) + 1), k=2 * rng.randrange(0, 5)))
        edits = [(len(s[:a].encode()), len(s[:b].encode()), rng.choice(["", " new ", "é", "x" * 99, " a b c " * 20]).encode()) for a, b in zip(cuts[::2], cuts[1::2])]
        want = text
        for a, b, put in reversed(edits):
            want = want[:a] + put + want[b:]
        r = token_counts.apply_edits(text, ends, nodes, edits, encoding, 40)
        assert r.text == want and (r.nodes[1] if r.nodes else 0) == len(encoding.encode_ordinary(want.decode()))
        assert r.nodes == token_counts.grow(r.nodes[len(r.nodes) // 2:][: len(r.ends)]) or not r.ends


def test_edits_touch_few_leaves(spark):
    text = " ".join(f"word{'abc'[i % 3]} more" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (None, "no id", 0), (3, "", 0), (1, text, 0)], "doc_id long, text string, leaves int")
    edits = spark.createDataFrame([(1, 100, 105, "here"), (1, 90_000, 90_000, "there "), (77, 0, 1, "")], "doc_id long, start int, end int, put string")
    out = token_counts.follow(token_counts.with_counts(docs), edits).select(
        "doc_id", token_counts.total("_tree").alias("a"), token_counts.total("_edited.tree").alias("b"), "_edited.text", "_edited.encoded").collect()
    encoding = token_counts.Tokenizer.load().encoding()
    want = text[:100] + "here" + text[105:90_000] + "there " + text[90_000:]
    for r in out:
        if r["doc_id"] == 1:
            assert (r["a"], r["b"], r["text"]) == (len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(want)), want) and r["encoded"] < 12
        elif r["doc_id"] is not None:
            assert (r["a"], r["b"], r["encoded"]) == (0, 0, 0)
    assert len(out) == 5 and token_counts.follow(token_counts.with_counts(docs.limit(0)), edits).count() == 0


def test_line_edits_of_two_texts_with_one_id(spark):
    texts = ["a b\na b\nc é\na b", "a much longer line\nx\nx\n\n\nx", "no line twice\nhere", "é\né\n", None]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(8, texts[0])], "doc_id long, text string")
    out = token_counts.follow(token_counts.with_counts(docs), token_counts.line_edits(docs)).select("text", "_edited.text")
    got = sorted(tuple(r) for r in out.toDF("before", "after").na.fill("").collect())

    def once(text):
        lines, seen, kept = (text or "").split("\n"), set(), []
        for i, line in enumerate(lines):
            if line == "" or line not in seen:
                kept.append(line + ("\n" if i < len(lines) - 1 else ""))
            seen.add(line)
        return "".join(kept)

    assert got == sorted((t or "", once(t)) for t in [*texts, texts[0]])


def test_overlapping_edits_are_refused():
    encoding = token_counts.Tokenizer.load().encoding()
    for edits in ([(0, 3, b""), (2, 4, b"")], [(5, 9, b"")], [(None, 1, b"")]):
        with pytest.raises(ValueError):
            token_counts.apply_edits(b"abcd", [4], [0, 1], edits, encoding)


TEXTS = ["", " ", "  a", "foo   bar \n\n  x", "é漢😀\t x", " " * 40 + "z" + " " * 7, "a" * 300, "<s> <unk> <0x0A>", "ab" * 90 + "!!" + "." * 70,
         "Hello, world... (test) 12345", "\x00 a", "x " * 5, " " * 100, "Hello, world... (test) 12345", "ünïcödé " * 50]


@pytest.mark.parametrize("hot", [64, 100_000])
def test_pieces_equal_the_library(spark, hot):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "null id", 3), (99, None, 3), (4, TEXTS[4], 3)], "doc_id long, text string, ids int")
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    coded = sentencepieces.encode(docs, hot_units=hot).withColumn("back", sentencepieces.decoder(spark)("ids")).collect()
    assert len(coded) == len(TEXTS) + 3
    for r in coded:
        text = "null id" if r["doc_id"] is None else "" if r["doc_id"] == 99 else TEXTS[r["doc_id"]]
        assert r["ids"] == model.encode(text) and r["n_pieces"] == len(r["ids"]) and r["back"] == text
    assert sentencepieces.encode(docs.limit(0)).count() == 0


def test_long_units_equal_the_library(spark):
    """Runs of one sign, periods, random signs and letters, a sign without a piece; the longest in one task of seconds."""
    rng = random.Random(4)
    texts = ["=" * 5_000, "x" + "=" * 300_001, "-=" * 40_000 + "=", "".join(rng.choice("=-_.#*") for _ in range(30_000)), "a" * 9_999,
             "".join(rng.choice("abcdeinorst") for _ in range(600_000)), "=" * 2_500 + "\U0001F9EC" * 3 + "=" * 4_001, "=" * ((1 << 22) + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    for r in sentencepieces.encode(docs).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]]), r["doc_id"]


@pytest.mark.parametrize("seed", range(6))
def test_chunks_join_without_loss(seed):
    """Random vocabularies with pieces of equal score, and chunks so small that many are joined."""
    rng = random.Random(seed)
    pieces = {"ab", "ba", "aa"}
    while len(pieces) < 14:
        pieces.add(rng.choice(sorted(pieces) + ["a", "b", "c"]) + rng.choice(sorted(pieces) + ["a", "b", "c"]))
    order = {p: len(p) * 2 + rng.randrange(2) for p in pieces}
    longest = max(map(len, pieces))
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "c", "ab", "aab"]) for _ in range(rng.randrange(300)))
        sizes = list(text)
        while True:
            open_ = [(order[a + b], i) for i, (a, b) in enumerate(zip(sizes, sizes[1:])) if a + b in order]
            if not open_:
                break
            i = min(open_)[1]
            sizes[i: i + 2] = [sizes[i] + sizes[i + 1]]
        want = [sum(map(len, sizes[:k])) for k in range(len(sizes) + 1)]
        assert sentencepieces.queue_merge(text, order, longest) == want
        assert sentencepieces.long_bounds(text, order, longest, chunk=8 * longest, overlap=6) == want


def test_viterbi_finds_the_best_sum(spark):
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {"a", "b", "▁"})
    vocabulary = sentencepieces.Vocabulary([(p, k + 1, -rng.random() * 5 * len(p) ** 0.7) for k, p in enumerate(pieces)], None, 0, False, len(pieces) + 1)
    words = ["".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["aaza"]
    got = {r["uid"]: r["ids"] for r in sentencepieces.encode_units(spark.createDataFrame(list(enumerate(words)), "uid long, unit string"), vocabulary).collect()}
    score, name = {k: s for _, k, s in vocabulary.pieces}, {k: p for p, k, _ in vocabulary.pieces}
    for k, w in enumerate(words):
        best = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            for p, _, s in vocabulary.pieces:
                if w[:e].endswith(p):
                    best[e] = max(best[e], best[e - len(p)] + s)
            best[e] = max(best[e], best[e - 1] - 1e6)
        ids = got[k]
        assert "".join(name.get(i, "z") for i in ids) == w
        assert sum(score.get(i, -1e6) for i in ids) == pytest.approx(best[-1])


def test_pipeline_against_brute_force(spark):
    """run() against the five stages done plainly on the smallest table."""
    import corpus_pipeline
    import duckdb
    from test_duplicates import WORD, probability_jaccard, shingle_sets, word_cut
    from test_rules_and_text import distance_in

    from flightspark.llm import decontaminate, quality_rules, registered

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({registered.ORACLES['op4_quality_rules']}) WHERE kept").fetchall()}
    texts = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    sets = shingle_sets(texts)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if b < a and (texts[a] == texts[b] or len(set(sets[a]) & set(sets[b])) > 0.5 * max(len(sets[a]), len(sets[b]))):
                x, y = set(sets[a]), set(sets[b])
                if texts[a] == texts[b] or len(x & y) / len(x | y) >= 0.8 or probability_jaccard(sets[a], sets[b]) >= 0.8:
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    rows = [(i, t) for i, t in texts.items() if find(i) == i]
    digests = {d: s for d, _, _, s in word_cut(rows, 50)}
    items = [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    stage = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    cut = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert {i: hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest() for i, t in cut.items()} == digests
    fold = lambda s: " ".join(s.lower().split())
    clean = {}
    for i, t in cut.items():
        own = fold(t)
        # Full alignment is slow: it is run where an item shares a stretch of 24 characters with the text, as planted items do.
        close = [x for x in map(fold, items) if any(x[k:k + 24] in own for k in range(0, len(x) - 23, 8))]
        if all(distance_in(x, own) > decontaminate.budget(len(x)) for x in close):
            clean[i] = t
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(clean) and quality_rules.DEFAULT_POLICY == "prose-2"
    assert all(got[i]["ids"] == model.encode(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items())


def test_line_edits_of_a_text_of_very_many_lines(spark):
    import time

    rows = [(1, "\n".join(["again", *(f"line {k}" for k in range(200_000)), "again", "é"])), (2, "é\n\né\nx\né"), (3, ""), (4, "one"), (5, "a\na\n")]
    start = time.time()
    got = sorted(tuple(r) for r in token_counts.line_edits(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "start", "end").collect())
    assert time.time() - start < 60
    size = len(rows[0][1].encode())
    assert got == [(1, size - 8, size - 2), (2, 4, 7), (2, 9, 11), (5, 2, 4)]
