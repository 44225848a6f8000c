"""Operators 11 to 13 against plain Python, and on hostile rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagespark.llm import block_tables as bt
from pagespark.llm import licenses, merkle, queries, repair


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11 -----------------------------------------------------------------------------------------------------------------

def leaf_of(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def plain_tree(digests):
    """(root, for each leaf its steps as (left, right) texts)."""
    steps, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, over = [], []
        for i in range(0, len(digests), 3):
            run = digests[i:i + 3]
            for j in range(len(run)):
                for leaf in groups[i + j]:
                    steps[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            over.append(sum(groups[i:i + 3], []))
        digests, groups = up, over
    return digests[0], steps


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, steps) of every row."""
    per = defaultdict(list)
    for r in rows:
        per[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r["doc_id"]))
    keys = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(per[k])]) for k in keys}
    root, upper = plain_tree([trees[k][0] for k in keys])
    return sorted((repr(x[3]), x[2], trees[k][0], root, tuple(steps + upper[n]))
                  for n, k in enumerate(keys) for x, steps in zip(sorted(per[k]), trees[k][1], strict=True))


def manifest_rows(df):
    return sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["steps"])) for r in df.collect())


def test_manifest_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {row[0]: row for row in plain_manifest(docs)}
    got = queries.op11_merkle_manifest(spark, sf).collect()
    assert len(got) == len(docs) and len({r["doc_id"] for r in got}) == len(docs)
    texts = {r["doc_id"]: r for r in docs}
    for r in got:
        _, leaf, subroot, root, steps = want[repr(r["doc_id"])]
        text = texts[r["doc_id"]]["text"]
        if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        folded = leaf_of(texts[r["doc_id"]], text)
        for left, right in steps:
            folded = sha(left, folded, right)
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, subroot, root, sha(*[s for step in steps for s in step]))
        assert (r["folded_root"], r["verified"]) == (folded, folded == root)


def test_manifest_of_hostile_rows(documents, nothing):
    out = merkle.manifest(documents)
    assert set(documents.columns) <= set(out.columns)
    assert manifest_rows(out) == plain_manifest(documents.collect())
    assert {r["row"] for r in out.collect()} == {"x"}
    assert merkle.manifest(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 81, 82, 244, 700])
def test_manifest_over_several_buckets(spark, n):
    docs = spark.range(n).selectExpr("(id * 7919) % 100003 as doc_id", "if(id % 5 = 0, 'b', 'a') as source", "cast(null as string) as lang",
                                     "id as n_chars", "concat('text ', id % 3) as text")
    out = merkle.manifest(docs, keep=["doc_id"])
    assert manifest_rows(out) == plain_manifest(docs.collect())
    assert out.filter(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0


def test_manifest_of_one_repeated_row(spark):
    docs = spark.range(500, numPartitions=7).selectExpr("1L as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "'same' as text")
    assert manifest_rows(merkle.manifest(docs, keep=["doc_id"])) == plain_manifest(docs.collect())


# 12 -----------------------------------------------------------------------------------------------------------------

def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_places(words):
    out = []
    for label, phrase in licenses.PHRASES:
        want = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i:i + len(want)] == want]
    return out


def plain_labels(words):
    joined = " " + " ".join(words) + " "
    return {t.label for t in licenses.TEMPLATES if re.search(licenses.as_regex(t.markup), joined)}


def test_license_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_license_scan(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        words = plain_words(docs[r["doc_id"]])
        places = plain_places(words)
        starts = [i for _, i in places]
        base = {label for label, _ in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | plain_labels(words))))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert any(r["labels"] != r["base_labels"] for r in got)


NOTICE = dict(licenses.NOTICES)
FULL = {label: licenses.MARK.sub(lambda m: "The Holders of it" if m[1].startswith("var") else "its" if m[1].startswith("alt") else "", markup) for label, markup in NOTICE.items()}


@pytest.mark.parametrize("text,labels", [
    ("x " + FULL["mit"].upper() + " y", {"mit"}),
    (FULL["mit"].replace("merge, ", ""), set()),  # a mandatory word is missing
    (FULL["bsd-2-clause"], {"bsd-2-clause"}),
    (FULL["bsd-3-clause"].replace("its contributors", "the contributors"), {"bsd-3-clause"}),
    (FULL["bsd-2-clause"].replace("1 ", ""), {"bsd-2-clause"}),  # an optional word is missing
    (FULL["bsd-2-clause"].replace("The Holders of it", "w " * 13), set()),  # a replaceable region is too long
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("gnu general public\nlicense", {"gpl"}),
    ("CC BY-NC 4.0, CC-BY/4.0", {"cc-by", "cc-by-nc-4.0", "cc-by-4.0"}),
    ("Copyright (c) 2001 by A and B. All rights reserved", {"all-rights-reserved"}),
    ("SPDX-License-Identifier: GPL-3.0", {"gpl-3.0"}),
    ("gnüu general public license, gnu general öpublic license", set()),
    ("", set()), (None, set()),
])
def test_license_wording(spark, text, labels):
    machine = licenses.automaton(licenses.BASE + licenses.TEMPLATES)
    n, found = licenses.scan((text or "").encode(), machine)
    assert n == len(plain_words(text))
    assert {machine.templates[t].label for t, _, _ in found} == labels


def test_license_automaton_on_random_words():
    rng = random.Random(5)
    markups = ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e", "a <<var;max=2>> b", "<<alt;a b|c>> d <<var;max=1>> <<alt;e|a a>>",
               "a a <<beginOptional>>b<<endOptional>>", "a <<var;max=0>> c <<var;max=3>> <<beginOptional>>d<<endOptional>>"]
    templates = [licenses.Template(str(i), m, 1.0) for i, m in enumerate(markups)]
    for max_states in (20_000, 3):
        machine = licenses.Automaton(templates, max_states)
        for _ in range(1500):
            words = [rng.choice("aaabbccdef") for _ in range(rng.randrange(12))]
            data = rng.choice(["", ", "]).join([""] + ["%s%s" % (w, rng.choice([" ", "\n", ". "])) for w in words]).encode()
            want = []
            for at in range(len(words)):
                rest = " " + " ".join(words[at:]) + " "
                for i, m in enumerate(markups):
                    ends = [k for k in range(len(words) - at + 1) if re.fullmatch(licenses.as_regex(m)[:-1], "".join(" " + w for w in words[at:at + k]))]
                    if ends:
                        assert re.match(licenses.as_regex(m), rest)
                        want.append((i, at, max(ends)))
            assert licenses.scan(data, machine) == (len(words), sorted(want, key=lambda f: (f[1], f[0])))


def test_license_markup_errors():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "<<var;max=3>> a", ""):
        with pytest.raises(ValueError):
            licenses.parse(bad)


def test_license_rows(documents, nothing):
    out = licenses.find_licenses(documents).collect()
    assert len(out) == 9 and all(r["row"] == "x" and r["score"] == "s" and r["matches"] == [] for r in out)
    assert sorted(r["n_words"] for r in out) == sorted(len(plain_words(r["text"])) for r in documents.collect())
    assert licenses.find_licenses(nothing).collect() == []


# 13 -----------------------------------------------------------------------------------------------------------------

def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, digest) of rows (role, text) in order: search over edits by cost and audit."""
    seen, faults = set(), ""
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
        seen.add((role, text))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
    heap, done, follow = [(0, "", 0, 0, ())], set(), {0: 2, 1: 2, 2: 3, 3: 2}
    while True:
        cost, audit, i, q, said = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            break
        name = {2: "user", 3: "assistant"}[follow[q]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, follow[q], said + (name + ":",)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, said))
            if faults[i] not in "bd":
                cut = 3 * (faults[i] == "t")
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if to is not None:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, to, said + (f"{role}:{text}",)))
                heapq.heappush(heap, (cost + cut + 3, audit + "R", i + 1, follow[q], said + (f"{name}:{text}",)))
    return *[faults.count(c) for c in "bdt"], illegal, cost, audit, sha("\n".join(said))


def plain_damage(talk):
    out = []
    for conv, turn, role, text in talk:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [] if hit == 0 else [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def plain_results(talks, damage=True):
    per = defaultdict(list)
    for r in talks:
        per[r[0]].append(r)
    out = {}
    for conv, talk in per.items():
        rows = plain_damage(talk) if damage else sorted([r[1:] for r in talk], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in rows if t is not None}
        blank, duplicate, truncated, illegal, cost, audit, digest = plain_repair([r[1:] for r in rows])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


def results(done):
    rows = done.keys.join(done.conversations, "k").join(repair.transcript_digests(done), "k", "left").collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) + (r["digest"] or sha(""),) for r in rows}


def test_repair_query(spark, sf):
    talks = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
           for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == plain_results(talks)


def test_block_tables_against_search():
    rng, tables = random.Random(1), bt.tables()
    for _ in range(3000):
        n = rng.randrange(14)
        rows = [(rng.choice(["system", "system", "user", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["a.", "b.", "c.", "d.", "e", "f", ""]) + " " * i) for i in range(n)]
        want = plain_repair(rows)
        seen, faults = set(), ""
        for role, text in rows:
            bare = text.strip()
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] != "." else "."
            seen.add((role, text))
        syms = bt.symbols("".join(r[0] if r[0] in "sua" else "o" for r, _ in rows), faults)
        codes, place, cost = tables.trace(syms, bt.END, bt.START)
        assert (cost + bt.END[place], ("".join(codes) + bt.trailing(place)).translate(bt.LETTERS)) == want[4:6]


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_repair_across_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rng = random.Random(7)
    talks = []
    for conv in [None, 0, 1, 2, 3, 4]:
        for turn in range({0: 150, 1: 1, 2: 7}.get(conv, 25)):
            talks.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", "assistant", "assistant", "system", "sys", "tool", "", " "]),
                          rng.choice(["Yes.", "No", "Why?\n", "  ", "", f"Say {turn}!", f"Cut {turn}", "é世. "])))
    talks += [(9, None, None, None), (9, 3, None, "null role."), (9, 3, None, "null role."), (10, None, "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame([t + (1, "c") for t in talks], "conv_id long, turn long, role string, text string, k int, chunk string")
    assert results(repair.repair(repair.damaged(df), everyone=df)) == plain_results(talks)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talks]
    done = repair.repair(df)
    assert results(done) == plain_results(plain, damage=False)
    said = defaultdict(list)
    for r in repair.messages(done).orderBy("k", "at", "part").collect():
        said[r["k"]].append(f"{r['role']}:{r['text']}")
    digests = {r["k"]: r["digest"] for r in repair.transcript_digests(done).collect()}
    assert {k: sha("\n".join(said[k])) for k in digests} == digests


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.repair(repair.damaged(empty), everyone=empty)
    assert results(done) == {} and repair.messages(done).collect() == []
    lost = spark.createDataFrame([(c, 0, "user", "x") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0], empty.schema)
    assert set(results(repair.repair(repair.damaged(lost), everyone=lost)).values()) == {(0, 0, 0, 0, 0, 0, "", sha(""))}
