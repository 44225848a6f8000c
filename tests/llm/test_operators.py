"""The operators against brute force, and on hostile rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagespark.llm import ann, bpe, common, exact_dedup, language, line_spread, mixing, near_dedup, queries, toxicity, url_filter, windows

PATH = public_tokenizers.path(queries.RANKS)
RANKS = bpe.read_ranks(None, PATH)
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts_of(sf):
    return duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# 1 ------------------------------------------------------------------------------------------------------------------

def test_bpe_query(spark, sf):
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, sf).collect()}
    for doc_id, text in texts_of(sf):
        ids = REAL.encode_ordinary(text)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert got[doc_id]["decoded_sha256"] == sha(text)


def test_bpe_pieces_and_lookback(monkeypatch):
    rng = random.Random(3)
    machine = bpe.Transducer(RANKS, max_arcs=3000)
    tokens = list(RANKS)
    for i in range(3000):
        piece = [bytes(rng.choice(b"abcdehilnorst ") for _ in range(rng.randrange(1, 40))), b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))),
                 bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))][i % 3]
        assert machine.encode(piece) == REAL._encode_single_piece(piece)
    monkeypatch.setattr(bpe, "LOOKBACK", 600)
    for _ in range(40):
        piece = bytes(rng.choice(b"abcdehilnorst") for _ in range(rng.randrange(500, 5000)))
        assert machine.encode(piece) == REAL._encode_single_piece(piece)


def test_bpe_odd_texts():
    rng = random.Random(4)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, max_pieces=50)
    for text in ["", " ", "  a", "a ", "a \n b", "\x1c a", "it's", "x" * 5000] + ["".join(rng.choice("ab1 ! '\n\t\u00a0\x1c\u00e9\u4e16s") for _ in range(14)) for _ in range(3000)]:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == REAL.encode_ordinary(text)


def test_utf8_machine_is_split_invariant():
    rng = random.Random(5)
    for _ in range(5000):
        data = bytes(rng.choice([rng.randrange(256), 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xA9]) for _ in range(rng.randrange(12)))
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            step = rng.randrange(1, 4)
            out += machine.feed(data[at:at + step])
            at += step
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_bpe_rows(documents, nothing):
    apart = bpe.decode(bpe.encode(documents, RANKS, public_tokenizers.PATTERN), RANKS)
    together = bpe.round_trip(documents, RANKS, public_tokenizers.PATTERN)
    assert together.columns == apart.columns
    for out in (apart.collect(), together.collect()):
        assert len(out) == 9
        for r in out:
            assert r["ids"] == REAL.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["row"] == "x"
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_decodes_lists_together():
    """Ids whose bytes are no UTF-8, or only together with another list's, give what decoding each list alone gives."""
    decoder = bpe.Decoder(RANKS)
    decoder_alone = [RANKS[bytes([b])] for b in "\u4e16".encode()]
    lists = [REAL.encode_ordinary("a \u4e16 b"), [], decoder_alone[:2], decoder_alone[2:], decoder_alone]
    for part in (lists, lists[:2], [], [[]]):
        ids = pa.array([[7], *part], pa.list_(pa.int32())).slice(1)
        assert decoder.decode_all(ids).to_pylist() == [b"".join(map(decoder.bytes_of.__getitem__, x)).decode("utf-8", "replace") for x in part]


def test_documents_go_to_python_in_small_batches(spark):
    before = spark.conf.get(common.BATCH)
    seen = lambda: [r["n"] for r in spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 3000) AS t").mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long").collect()]
    try:
        spark.conf.set(common.BATCH, "64m")
        corpus_pipeline.encode(spark, spark.createDataFrame([], "doc_id long, source string, text string"), "")
        rows = seen()
        assert sum(rows) == 4000 and max(rows) * 3000 <= 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH, "1000b")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH) == "1000b"
    finally:
        spark.conf.set(common.BATCH, before)


# 2 ------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits,entries,depth", [(64, 100_000, 16), (3, 2, 6), (64, 1, 8)])
def test_exact_dedup(documents, nothing, bits, entries, depth):
    out = exact_dedup.deduplicate(documents, hash_bits=bits, bucket_entries=entries, max_depth=depth).collect()
    groups = defaultdict(list)
    for r in documents.collect():
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha(text)) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out) == want
    if bits == 3:
        assert max(r["chain"] for r in out) > 1
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_directory_doubles_only_where_it_must():
    rows = exact_dedup.directory({0: 9, 1: 1, 7: 1}, 4, 3)
    assert [s for s, _, _ in rows] == list(range(8))
    assert [(b, d) for _, b, d in rows] == [(0, 3), (1, 3), (2, 2), (2, 2)] + [(4, 1)] * 4


# 3 ------------------------------------------------------------------------------------------------------------------

def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = [r for r in queries.op3_language(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) > 200
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_ppm(train, context, byte):
    """Code length of a byte by recursion over the training bytes, as the definition says."""
    shut, bits = set(), 0.0
    for order in (3, 2, 1, 0):
        ctx = context[3 - order:]
        seen = Counter(t[i] for t in train for i in range(3, len(t)) if t[i - order:i] == ctx)
        seen = {b: n for b, n in seen.items() if b not in shut}
        if not seen:
            continue
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return bits - np.log2(seen[byte] / total)
        bits -= np.log2(len(seen) / total)
        shut |= set(seen)
    return bits + np.log2(256 - len(shut))


def test_language_code_lengths():
    data = {"x": [b"banana bandana", b"ananas"], "y": [b"the cat sat on the mat", b"a hat"]}
    lang, gram = [], []
    for name, texts in data.items():
        for t in texts:
            g = language._grams(language.PAD + t)
            gram += g.tolist()
            lang += [name] * len(g)
    model = language.fit(["x", "y"], np.array(lang, object), np.array(gram, np.int64), np.ones(len(gram), np.int64))
    for text in (b"ban the cat", b"zzz", b"a\xff"):
        want = [sum(plain_ppm([language.PAD + t for t in data[n]], (language.PAD + text)[i - 3:i], text[i - 3]) for i in range(3, 3 + len(text))) for n in ("x", "y")]
        assert np.allclose(language.code_lengths(model, [text])[0], want, rtol=1e-5)


def test_language_slices(monkeypatch):
    model = language.fit(["x"], np.array(["x"] * 4, object), np.array([1, 2, 3, 4 << 8 | 7], np.int64), np.ones(4, np.int64))
    texts = [b"", b"a", bytes(range(256)) * 20, b"xyz"]
    whole = language.code_lengths(model, texts)
    monkeypatch.setattr(language, "SLICE", 100)
    assert np.allclose(language.code_lengths(model, texts), whole)


def test_language_rows(documents, nothing):
    model = language.train(documents)
    out = {r["doc_id"]: r for r in language.predict(documents, model).collect()}
    assert out[3]["lang_pred"] == "und" and out[4]["lang_pred"] == "und" and out[1]["lang_pred"] in ("de", "en", "fr")
    assert language.train(nothing) is None
    assert {r["lang_pred"] for r in language.predict(documents, None).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------

def test_ann_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op4_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        want = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        assert len(got[ids[i]]) == 20
        assert np.allclose([s for _, s in got[ids[i]]], [x[list(ids).index(v)] @ x[i] for v, _ in got[ids[i]]])
        hits += len({ids[j] for j in want} & {v for v, _ in got[ids[i]]})
    assert hits / (20 * len(got)) >= 0.99


def test_ann_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((5, 64))
    centre, turn = x.mean(0), ann.rotation(64)
    bits, length, align, near = ann.codes(x, centre, turn)
    i, j, score = ann.search_block(q, x, bits, length, align, near, centre, turn, 10)
    for n in range(5):
        assert set(np.argsort(-(x @ q[n]))[:10]) == set(j[i == n])
    assert np.allclose(np.sort(turn @ turn.T), np.sort(np.eye(64)), atol=1e-9)


def test_ann_hostile_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [1.0, None]), (None, [1.0, 1.0]),
                                                  (104, [2.0, 0.0]), (104, [2.0, 0.0]), (105, [1.0]), (106, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit(1)).withColumn("x", F.lit("z"))
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, v) for v in (104, 1, 2, 3, 4)] + [(20, v) for v in (104, 0, 1, 2, 3)]
    assert [r["rank"] for r in out] == [1, 2, 3, 4, 5] * 2
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.filter("vec_id in (0, 1, 104)")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(few, F.col("vec_id") == 0, k=20).orderBy("rank").collect()] == [(104, 2.0), (1, 1.0)]


# 5 ------------------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://example.org/en/1234", "http://example.org/en/2", "ftp://com/fr/", "http://x.com/de/#a", "http://notcom/de/",
            "no scheme", None, "http://", "http://a.b.c.com/fr/de/", "http://com/de", "x://org?/", "http://org./", "http://example.org/es/", "http://example.org/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("block", F.lit(2))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["block"]) for r in url_filter.judge(df, url_filter.rules_table(spark)).collect()}
    assert len(got) == len(urls)
    assert got[0][:4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1][2:4] == ("example.org/en/1", "block") and got[2][2:4] == ("org/", "allow") and got[3][2:4] == ("com/fr/", "allow")
    assert got[4][:4] == ("x.com", "/de/", "com/de/", "block") and got[5][2:4] == (None, "allow")
    assert got[6][:4] == ("", "", None, "allow") == got[7][:4] and got[9][2] == "com/fr/" and got[10][2] is None and got[11][2] is None
    assert got[13] == got[14]
    assert url_filter.judge(df.limit(0), url_filter.rules_table(spark)).count() == 0


@pytest.mark.parametrize("blocks", [1, 64])
def test_url_rules_against_all_pairs(spark, blocks):
    """A filter far too small for its rules lets false hits through; the join removes them."""
    rng = random.Random(6)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(df, url_filter.rules_table(spark, rules), blocks=blocks).collect():
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fits)[3:] if fits else (None, "allow"))


# 6 ------------------------------------------------------------------------------------------------------------------

def cut_repeats(texts, width):
    count = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int(gone[:1].sum() + ((~gone[:-1]) & gone[1:]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_windows_query(spark, sf):
    rows = texts_of(sf)
    want = {i: w for (i, _), w in zip(rows, cut_repeats([t.encode() for _, t in rows], 400))}
    got = queries.op6_repeated_windows(spark, sf).collect()
    assert sum(w[1] for w in want.values()) > 0
    for r in got:
        n, gone, runs, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, runs, sha(kept))


@pytest.mark.parametrize("seed,block", [(1, 1 << 18), (2, 300)])
def test_windows_on_small_alphabets(spark, monkeypatch, seed, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(seed)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randrange(30, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(stock + ["c", "dd", "", "a" * 70, "\u00e9"]) for _ in range(rng.randrange(14))) for _ in range(60)] + ["", "a" * 400, "a" * 41]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in windows.remove_repeated(df, width=40, gram=5, node=12, fine=4).collect()}
    for i, w in enumerate(cut_repeats([t.encode() for t in texts], 40)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), bytes(got[i]["kept"])) == w, i
    assert got[99]["n_bytes"] == 0


def test_windows_rows(documents, nothing):
    out = windows.remove_repeated(documents, width=10, gram=3, node=4, fine=2).collect()
    assert len(out) == 9 and all(r["n_removed"] == r["n_bytes"] for r in out if r["doc_id"] == 6)
    assert windows.remove_repeated(nothing).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------

def test_line_spread(spark, nothing):
    rows = [(i, f"unique line number {i}\n Footer text \nanother {i}\n", f"s{i}") for i in range(12)]
    rows += [(50 + i, f"\n{'edge':s}\nbody of this text {i}", f"s{i}") for i in range(9)] + [(70, "edge\nbody long enough here", None), (71, None, "s1"), (72, "", "s1")]
    rows += [(80 + i, "Footer text", f"s{i}") for i in range(3)] + [(0, rows[0][1], "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rk", F.lit(0)).withColumn("marks", F.lit(0))
    got = line_spread.remove_spread_lines(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[3]["text"] == "unique line number 3\nanother 3\n" and by[3]["n_lines"] == 4 and by[3]["n_removed"] == 1
    assert by[50]["text"] == "\nbody of this text 0" and by[70]["n_removed"] == 1  # nine sites and the null site
    assert by[71]["text"] is None and by[71]["n_lines"] == 0 and by[72]["text"] == ""
    assert by[80]["text"] == "Footer text"  # nothing but the line: a copied document
    assert line_spread.remove_spread_lines(nothing).count() == 0


def test_line_spread_large_counts(spark):
    """Thresholds where sketches are no longer exact: the lines in the margin are counted."""
    lines = spark.range(990, 1012).select(F.col("id").alias("lh"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("id"))).alias("s")).select(
        "lh", F.col("s").cast("string").alias("site"))
    lines = lines.unionByName(spark.range(3000).selectExpr("5000L as lh", "cast(id as string) as site"))
    got = {r[0] for r in line_spread.spread_lines(lines, 1000, 8).collect()}
    assert got == set(range(1000, 1012)) | {5000}


# 8 ------------------------------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(t == p for t, _, p in rows) / len(rows) > 0.9
    # A third of this table's toxic labels are on texts without any mark of it; the rest must be ranked on top.
    pos, neg = sorted((s for t, s, _ in rows if t), reverse=True), [s for t, s, _ in rows if not t]
    assert np.mean([a > b for a in pos[:len(pos) // 2] for b in neg]) > 0.95


def test_segments_are_all_maximal():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randrange(1, 25)
        weights = [rng.choice([None, 3.0, 1.5, 0.25, -2.0]) for _ in range(n)]
        steps = [(0.0 if w is None else w) - toxicity.DRIFT for w in weights]

        def best(lo, hi):  # definition: take the best segment, then the rest on both sides
            top = max(((sum(steps[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if top is None or top[0] <= 1e-12:
                return []
            return best(lo, top[3]) + [(top[3], top[4], top[0])] + best(top[4], hi)

        got = toxicity.segments([(i, w) for i, w in enumerate(weights) if w is not None], n)
        want = best(0, n)
        assert np.isclose(sum(s for _, _, s in got), sum(s for _, _, s in want)) and len(got) == len(want)


def test_toxicity_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents, labels)
    out = toxicity.score(documents, model).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out) and out[0]["row"] == "x"
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.train(documents, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(documents, none).collect()} == {0}


# 9 ------------------------------------------------------------------------------------------------------------------

def brute_links(texts, words, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("words,threshold", [(3, 0.85), (5, 0.8)])
def test_near_dedup_with_a_large_group(spark, words, threshold):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    text = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(330):  # near copies of one text: more than a node takes
        copy = list(text)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["a b", "A B", "a", "", None, "a b c d e f", "a  b\tc d\ne f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("cid", F.lit(7)).withColumn("node", F.lit(7))
    sizes, roots = brute_links(texts, words, round(100 * threshold))
    got = {r["doc_id"]: r for r in near_dedup.link(df, words=words, threshold=threshold).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[i], roots[i], roots[i] == i), i


def test_near_dedup_joins_components_before_it_tries_all_pairs(spark, monkeypatch):
    """Many chains of near copies in one large node: what the best links join is not tried pair by pair."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 12)
    rng = random.Random(8)
    text = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):  # neighbours in the chain are similar, ends are not
        text[rng.randrange(len(text))] = f"x{i}"
        texts.append(" ".join(text))
    tried, confirm = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, *rest: tried.append(pairs.count()) or confirm(pairs, *rest))
    got = near_dedup.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, threshold=0.85).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_links(texts, 3, 85)[1]
    assert len(tried) == 3 and sum(tried) < 4 * len(texts), tried


def test_near_dedup_rows(documents, nothing):
    got = near_dedup.link(documents, words=3, threshold=0.85).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[4]["kept"]
    assert near_dedup.link(nothing).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------

def filled(sizes, weights, times):
    """Targets by resharing the excess until no source is above its cap."""
    total, cap, fixed = sum(sizes), [times * s for s in sizes], {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        heavy = sum(weights[i] for i in free)
        share = {i: (total - sum(fixed.values())) * weights[i] / heavy for i in free} if heavy else {}
        above = [i for i in free if share[i] > cap[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap[i] for i in above}


def test_mixing_targets_and_takes(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a"] * 30 + ["b", "c", "c", "\u00e9", "z", None])) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("src", F.lit(1)).withColumn("block", F.lit(1))
    plan = mixing.mix(df, block_words=64)
    out = plan.documents.collect()
    assert len(out) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, filled(sizes, [1 + i % 3 for i in range(len(names))], 3)))
    took = Counter()
    for r in out:
        name = r["src"][1:] if r["src"] else None
        assert abs(r["target"] - want[name]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        took[name] += r["taken"]
    for name in names:
        assert abs(took[name] - want[name]) <= 1
    assert sum(r["words"] for r in plan.schedule.collect()) == sum(took.values())
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7), block_words=64).documents.collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    mixed = Counter(r["source"] for r in mixing.mixed_documents(df, block_words=64).select("source", F.explode(F.filter(F.split("text", " "), lambda x: x != ""))).collect())
    assert abs(mixed["a"] - want["a"]) / want["a"] < 0.05


def test_mixing_schedule_is_even(spark):
    """Every stretch of slots is close to the targets."""
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(600)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=64).schedule.orderBy("slot").collect()
    for start in range(0, len(plan) - 60, 20):
        seen = Counter(r["src"] for r in plan[start:start + 60])
        assert abs(seen["=c"] - 30) <= 4 and abs(seen["=a"] - 10) <= 4


def test_mixing_rows(documents, nothing):
    out = mixing.mix(documents).documents.collect()
    assert len(out) == 9 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(nothing).documents.count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_documents(documents).columns == documents.columns
