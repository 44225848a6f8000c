"""The stages of the corpus pipeline against plain Python."""

import math
import random
import re

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from pagespark.llm import bpe, line_spread, queries, toxicity


def _cleaned(rows, min_sites=10):
    """Each distinct text speaks for its smallest site; lines of ``min_sites`` such sites go everywhere."""
    site_of = {}
    for _, text, site in rows:
        if text is not None:
            key = "" if site is None else "=" + site
            site_of[text] = min(site_of.get(text, key), key)
    sites = {}
    for text, site in site_of.items():
        for line in text.split("\n"):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(site)
    spread = {line for line, on in sites.items() if len(on) >= min_sites}
    return [(i, None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in spread)) for i, text, _ in rows]


def test_line_stage_of_short_pages_and_copies(spark, nothing):
    notice = "All rights reserved, reproduction of any part of this page is forbidden"
    rows = [(i, f"own {i}\n {notice} \n", f"s{i:02}") for i in range(12)]  # the notice is most of each page
    rows += [(20 + i, "a text of two lines\nthat twelve sites copied", f"s{i:02}") for i in range(12)]
    rows += [(40, notice, "s01"), (41, None, "s02"), (42, "", None), (43, f"x\n{notice}", None)]
    rows += [(50 + i, f"nine\npage number {i} of the nine", f"s{i:02}") for i in range(9)] + [(60, "nine\npage number 0 of the nine", "s11")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_spread_lines(spark, df, "").collect()}
    assert {i: r["text"] for i, r in got.items()} == dict(_cleaned(rows))
    assert got[3]["text"] == "own 3\n" and got[3]["n_chars"] == 6 and got[40]["text"] == ""
    assert got[25]["text"] == "a text of two lines\nthat twelve sites copied" and got[50]["text"].startswith("nine")
    assert line_spread.remove_spread_lines(nothing, copied_share=None).count() == 0


# All stages on planted documents, each recomputed in plain Python from its own input ---------------------------------

RAW = "doc_id long, text string, lang string, source string, n_chars long"
SAFE = "river garden morning letter window market summer teacher village bridge simple paper colour winter music island travel kitchen yellow forest".split()
NASTY = "scumbag vermin idiotic filthy worthless".split()


def _planted():
    rng = random.Random(21)
    prose = lambda n, bad=(): " ".join(rng.choice(bad) if bad and i % 4 == 0 else rng.choice(SAFE) + str(rng.randrange(60)) for i in range(n))
    rows, toxic = [], {}

    def add(text, source):
        rows.append([len(rows), text, "en", source, 0 if text is None else len(text)])
        return len(rows) - 1

    for i in range(240):  # labelled: a third is toxic
        bad = i % 3 == 0
        toxic[add(prose(40, NASTY if bad else ()), f"s{i % 12:02}")] = int(bad)
    for i in range(40):
        add(prose(30, NASTY if i % 4 == 0 else ()), "s00")
    for i in range(14):  # a line on many sites
        add(f"{prose(12)}\nall rights reserved by whoever it was\n{prose(9)}", f"s{i % 12:02}")
    for i in range(12):  # groups of near copies, across sources
        words = prose(60).split()
        for j in range(1 + i % 4):
            copy = words[:]
            if j:
                copy[rng.randrange(60)] = f"changed{j}"
            add(" ".join(copy), f"s{(i + j) % 12:02}")
    add(prose(5000), "huge")
    add(prose(700), "alone")  # one document, far larger than its source's share may be
    for text, source in ((None, "s01"), ("", None), ("two words", None), ("  \n ", "s02"), ("dup text of a repeated id row here", "s03"), ("dup text of a repeated id row here", "s03")):
        add(text, source)
    rows[-1][0] = rows[-2][0]
    return rows, toxic


def _predicted(model, text):
    """The model's rule by its definition: every maximal segment by splitting at the best one."""
    words = toxicity.TOKEN.findall(text.lower()) if text else []

    def weight(w):
        found = model.weights.get(w)
        for n in toxicity.STEMS:
            if found is None and len(w) > n:
                found = model.weights.get(w[:n] + "*")
        return (0.0 if found is None else found) - toxicity.DRIFT
    scores = [weight(w) for w in words]

    def segments(lo, hi):
        best, at, sums = 0.0, None, [0.0]
        for x in scores[lo:hi]:
            sums.append(sums[-1] + x)
        low = 0
        for e in range(1, len(sums)):
            if sums[e - 1] < sums[low]:
                low = e - 1
            if sums[e] - sums[low] > best + 1e-12:
                best, at = sums[e] - sums[low], (lo + low, lo + e)
        return [] if at is None else [best, *segments(lo, at[0]), *segments(at[1], hi)]
    found = segments(0, len(scores))
    x = [model.rate * max(found, default=0.0), math.log1p(sum(math.expm1(min(40.0, model.rate * s)) for s in found)), math.log1p(len(words))]
    return model.base + sum(a * b for a, b in zip(model.logit, x)) >= 0


def _near(rows):
    """Ids that stay: the smallest of each group linked by five-word shingles at 0.8."""
    sets, ids = [], []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
        ids.append(i)
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i] for i in range(len(rows)) if least[root(i)] == ids[i]}


def _mixed(rows, home):
    """Texts of the mix from the words that SQL says are taken of each document."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{home}/*.parquet'")
    cur = con.execute(queries.oracle_sql()["op10_mixing"])
    names = [d[0] for d in cur.description]
    taken, n = {}, {}
    for r in cur.fetchall():
        r = dict(zip(names, r))
        taken[r["doc_id"]] = r["taken"]  # of all rows of the id together
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    out = []
    for i, text, _, source, _ in rows:
        pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text or "")
        words = taken.get(i, 0) // n.get(i, 1)
        if words and pieces:
            out += [(i, text, source)] * (words // len(pieces))
            if words % len(pieces):
                out.append((i, "".join(pieces[:words % len(pieces)]), source))
    return out


def test_every_stage_and_the_whole(spark, tmp_path):
    rows, marks = _planted()
    home = str(tmp_path)
    docs = spark.createDataFrame([tuple(r) for r in rows], RAW)
    docs.coalesce(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in marks.items()], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    key = lambda r: tuple("" if x is None else str(x) for x in r)

    def stage(name, rows):
        path = f"{home}/in-{name}"
        spark.createDataFrame([tuple(r) for r in rows], RAW).coalesce(2).write.parquet(path)
        got = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(path), home)
        if name != "byte_bpe":
            assert got.columns == docs.columns
        return sorted(map(list, got.collect()), key=key), path

    model = toxicity.train(docs, spark.read.parquet(f"{home}/labels.parquet"))
    kept, _ = stage("toxicity", rows)
    assert kept == sorted([r for r in rows if not _predicted(model, r[1])], key=key)
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert gone == {r[0] for r in rows if r[1] and any(w in r[1] for w in NASTY)}  # the planted ones and no clean one

    cleaned, _ = stage("line_dedup", kept)
    texts = _cleaned([(r[0], r[1], r[3]) for r in kept])
    assert cleaned == sorted([[i, t, r[2], r[3], None if t is None else len(t)] for r, (i, t) in zip(kept, texts)], key=key)
    assert not any("all rights reserved" in (r[1] or "") for r in cleaned)

    single, _ = stage("near_dedup", cleaned)
    stay = _near(cleaned)
    assert single == [r for r in cleaned if r[0] in stay] and len(single) < len(cleaned)

    mixed, path = stage("mixing", single)
    want = _mixed(single, path)
    assert sorted([(r[0], r[1], r[3]) for r in mixed], key=key) == sorted(want, key=key)
    assert {r[3] for r in single if (r[1] or "").split()} == {r[3] for r in mixed}  # no source leaves
    assert all(r[4] == len(r[1]) for r in mixed)

    coded, _ = stage("byte_bpe", mixed)
    ranks = bpe.read_ranks(spark, public_tokenizers.path(corpus_pipeline.RANKS))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted([r[0], r[1], r[2], list(r[3]), r[4]] for r in coded) == sorted([i, s, len(ids), ids, True] for i, t, s in want for ids in [real.encode_ordinary(t)])

    whole = sorted([r["doc_id"], r["source"], r["n_tokens"], list(r["ids"]), r["round_trip"]] for r in corpus_pipeline.run(spark, home).collect())
    assert whole == sorted([r[0], r[1], r[2], list(r[3]), r[4]] for r in coded)


def test_stages_without_rows(spark, tmp_path):
    home = str(tmp_path)
    empty = spark.createDataFrame([], RAW)
    empty.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    assert corpus_pipeline.run(spark, home).collect() == []


def test_stages_keep_null_ids_and_clashing_columns(spark, documents, tmp_path):
    """The hostile rows go through every stage with their columns; nothing toxic was labelled, so all are judged clean."""
    home = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    df = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, home)
        assert df.columns == documents.columns, name
        df.write.parquet(f"{home}/{name}")
        df = spark.read.parquet(f"{home}/{name}")
        assert df.count() >= 4 and {r["row"] for r in df.collect()} == {"x"}, name
