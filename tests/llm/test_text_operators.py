"""The corpus operators against brute force, on texts with every oddity that their contracts name."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cairn.llm import bpe_lexicon, components, exact_dedup, line_dedup, mixing, near_dup, neural_lm, quality, sketches, token_files
from cairn.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, uid int, pos string, shard long, t string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def odd_rows():
    r = random.Random(3)
    words = ["the", "And", "été", "Straße", "日本", "a", "b,", "c.", "##", "🙂", "don't"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(n) for n in (1, 2, 3, 5, 30, 400)]
    texts = [None, "", " \t\n ", "x", *base, base[3].upper(), base[4], base[4] + "\n", base[5] + " tail", text(6000), "y" * 9000, "a shared long line\nunique one here\n a shared LONG line \n\n", "other\nA shared long line", "<|endoftext|> in text", "z z  z", "q\r\nq\x0b\x0cq"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "b", i, "p", 1, "t") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a row that repeats
    rows.append((None, "no id at all here", None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(odd, empty):
    rows = odd_rows()
    got = exact_dedup.exact_groups(odd).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1] or "")].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(empty).collect() == []


def test_recipes_alone_decide(spark):
    rows = [(1, 10, b"s", [(1, 0), (1, 1)]), (2, 11, b"s", [(1, 1), (1, 0)]), (3, 12, b"s", [(1, 0), (1, 1)]), (4, 13, b"e", [])]
    lists = spark.createDataFrame(rows, "uid long, id long, sha binary, recipe array<struct<u:long,p:int>>").selectExpr("*", "1L key")
    assert sorted((r["keep"].id, r.group_size) for r in exact_dedup.same_recipes(lists).collect()) == [(11, 1), (12, 2), (13, 1)]
    with pytest.raises(Exception, match="different SHA-256"):
        exact_dedup.same_recipes(lists.selectExpr("uid", "id", "CAST(string(uid) AS BINARY) sha", "recipe", "key")).collect()


def test_line_index_is_over_all_lines(spark):
    lines = spark.createDataFrame([(0, k * 7919, k, 1 + k % 3, k) for k in range(500)], "shard long, h1 long, h2 long, n long, lo long")
    index = line_dedup.build_index(lines).collect()
    assert len(index) == 1 and len(index[0].holders) == 4 * 500
    asked = lines.selectExpr("shard", "h1", "h2 + IF(h1 % 2 = 0, 0, 1) h2", "5L block").unionByName(spark.createDataFrame([(0, 5, 5, 5)], "shard long, h1 long, h2 long, block long"))
    got = line_dedup.probe(line_dedup.build_index(lines), asked).collect()
    assert sorted(r["first"] for r in got) == [k for k in range(500) if k % 3 and k % 2 == 0]


def test_chunks_are_the_text(odd):
    from pyspark.sql import functions as F

    text = exact_dedup.lower_ascii(F.coalesce("text", F.lit("")))
    rows = odd.select(text.alias("t"), F.array_join(exact_dedup.chunks(text), "").alias("j"), F.size(exact_dedup.chunks(text)).alias("n")).collect()
    assert all(r.t == r.j for r in rows) and max(r.n for r in rows) > 3


def test_near_groups(odd, empty):
    rows = odd_rows()

    def fingerprint(t):
        w = WORD.findall(low(t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))

    got = near_dup.near_groups(odd).collect()
    fps = [fingerprint(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter(zip([r[0] for r in rows], fps, strict=True))
    component = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    component[i] = component[j] = min(component[i], component[j])
    name = {}
    for i, c in enumerate(component):
        ids = [rows[k][0] for k in range(len(rows)) if component[k] == c and rows[k][0] is not None]
        name[i] = min(ids) if ids else None
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((rows[i][0], name[i]) for i in range(len(rows)))
    assert near_dup.near_groups(empty).collect() == []
    kept = near_dup.drop_near(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({n for n in name.values() if n is not None})


def test_containment_of_short_text_is_unknown():
    long = np.random.default_rng(1).integers(0, 2**64, 8000, dtype=np.uint64)
    L = sketches.Sketch.of(long)
    high, low = long[long >= 2**61][:5], long[long < 2**61][:5]
    assert sketches.Sketch.of(high).contained(L) is None and sketches.Sketch.of(low).contained(L) == 1
    assert sketches.Sketch.of(long[:0]).contained(L) == 1


def test_similar_texts_go(spark):
    import corpus_pipeline

    r = np.random.default_rng(3)
    texts, pairs = {}, []
    for k in range(40):  # copies with some words changed, at most a fifth of all shingles
        words = [f"w{x}" for x in r.integers(0, 5000, 200)]
        copy = list(words)
        for at in r.choice(200, 1 + k % 4, replace=False):
            copy[at] = "changed"
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(copy)
        a, b = ({tuple(w[i : i + 5]) for i in range(196)} for w in (words, copy))
        pairs.append(len(a & b) / len(a | b))
    texts |= {100: "", 101: None, 102: "one two", 103: "One  two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    want = {2 * k for k in range(40)} | {2 * k + 1 for k, j in enumerate(pairs) if j < 0.8} | {100, 102}
    assert kept == want and sum(0.8 <= j < 0.96 for j in pairs) > 30


def test_similar_candidates_come_from_the_gray_index(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "changed"])), (3, "a b c d e f g h"), (4, "a b c d e f g h i")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.drop_similar(docs).collect()) == [1, 3]
    seen = []
    monkeypatch.setattr(near_dup, "fingerprint_links", lambda fps, *_, **__: seen.append(fps) or spark.createDataFrame([], "u long, v long"))
    assert sorted(r.doc_id for r in near_dup.drop_similar(docs).collect()) == [1, 2, 3, 4] and len(seen) == 1


@pytest.mark.parametrize("common, a, b", [(4, 0, 1), (8, 1, 1), (12, 1, 2), (160, 20, 20)])
def test_fingerprints_of_sets_at_the_least_similarity(common, a, b):
    r = np.random.default_rng(common)
    found, tags = 0, np.zeros((0, near_dup.PRINTS), np.uint64)
    for _ in range(300):
        x = r.integers(0, 2**63, common + a + b).astype(np.uint64)
        both = np.stack([near_dup.signature(v).view(np.uint8) for v in (x[: common + a], np.delete(x, slice(common, common + a)))])
        tags = near_dup.tagged(both)
        found += (np.bitwise_count(tags[0] ^ tags[1]) <= near_dup.BITS_APART).any()
    assert found >= 299 and all(np.bitwise_count(tags[0] ^ np.roll(tags[0], k)).min() > near_dup.BITS_APART for k in range(1, near_dup.PRINTS))


def test_near_rows_that_repeat_an_id(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(999)) for _ in range(60)) for _ in range(3)]
    docs = spark.createDataFrame([(4, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2]), (6, texts[1]), (None, texts[0]), (None, "only here")], "doc_id long, text string")
    for drop in (near_dup.drop_near, near_dup.drop_similar):
        assert sorted(map(repr, map(tuple, drop(docs).collect()))) == sorted(map(repr, [(4, texts[0]), (5, texts[1]), (5, texts[2]), (None, "only here")]))


def test_set_forest():
    r = np.random.default_rng(5)
    sets, groups = [], 30
    for g in range(groups):  # in a group each set shares 0.75 to 0.95 with the first
        base = r.integers(0, 2**63, 120).astype(np.uint64)
        for k in range(8):
            own = base.copy()
            own[: 2 * k] = r.integers(0, 2**63, 2 * k).astype(np.uint64)
            sets.append(np.unique(own))
    signs = [np.array([near_dup.mix(s * f).min() >> np.uint64(56) for f in near_dup._FACTORS], np.uint8) for s in sets]
    rows = [{"fp": k, "c": -k, "values": v.tobytes(), "shingles": s.tobytes()} for k, (s, v) in enumerate(zip(sets, signs, strict=True))]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    for left, right in ((rows, None), (rows[::2], rows[1::2])):
        every, cut = left + (right or []), len(left) if right else 0
        want, got = np.arange(len(every)), np.arange(len(every))
        pairs = [(i, j) for i in range(cut or len(every)) for j in range(max(cut, i + 1), len(every)) if alike(sets[every[i]["fp"]], sets[every[j]["fp"]])]
        components.union(want, *np.array(pairs).T)
        at = {x["fp"]: k for k, x in enumerate(every)}
        u, v = near_dup.set_forest(left, right)
        components.union(got, np.array([at[x] for x in u]), np.array([at[x] for x in v]))
        assert got.tolist() == want.tolist() and len(u) < len(every) and len(pairs) > len(u)


def test_large_bucket_moves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 8)
    r = random.Random(2)
    base, texts = [f"w{k}" for k in range(150)], []
    for k in range(60):  # all share about 0.7 with each other, some 0.9
        own = [x if r.random() > 0.012 else f"z{k}{x}" for x in base]
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    want = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    got = near_dup.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(want)) and 3 < len(set(want)) < 60


def test_prune_report(spark):
    fps = spark.range(40000).selectExpr("xxhash64(id) fp")
    got = {x["size"]: x for x in near_dup.prune_report(fps).collect()}
    assert set(got) == set(near_dup.LEVELS) and all(x.left <= x.looked for x in got.values())
    n = 40000 / near_dup.LEVELS[-1]
    assert got[near_dup.LEVELS[-1]].left < n * n / 2 / 3 and got[near_dup.LEVELS[-1]].looked < 0.8 * n * n / 2


def test_half_forest_links_all_of_few_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 38, 2000).astype(np.uint64)
    near = base[:800].copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 38, len(near)).astype(np.uint64)
    fps = np.unique(np.concatenate((base, near, base[:1] ^ np.arange(40, dtype=np.uint64)))) | np.uint64(15 << 60)
    left = np.arange(len(fps)) % 2 == 0
    for a, b, same in ((fps, fps, True), (fps[left], fps[~left], False)):
        every = fps if same else np.concatenate((a, b))
        want, got = np.arange(len(every)), np.arange(len(every))
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
        components.union(want, i, j + (0 if same else len(a)))
        order = np.argsort(every)
        at = lambda x: order[np.searchsorted(every, x, sorter=order)]
        u, v = near_dup.half_forest(a, b, same)
        components.union(got, at(u), at(v))
        assert got.tolist() == want.tolist() and 0 < len(u) < len(i)
    # unlike fingerprints: a pair of blocks compares a few of each, not all with all
    some, counts = np.unique(r.integers(0, 1 << 38, 60_000).astype(np.uint64)), np.zeros(1, np.int64)
    near_dup.half_forest(some, some, True, counts=counts)
    assert counts[0] < 6 * len(some)
    # nor do many near copies compare all with all
    copies, counts = np.unique(np.bitwise_xor.reduce(np.where(r.random((6000, 38)) < 0.07, np.uint64(1) << np.arange(38, dtype=np.uint64), np.uint64(0)), axis=1)), np.zeros(1, np.int64)
    u, v = near_dup.half_forest(copies, copies, True, counts=counts)
    i, j = np.nonzero(np.bitwise_count(copies[:, None] ^ copies[None, :]) <= 3)
    want, got = np.arange(len(copies)), np.arange(len(copies))
    components.union(want, i, j)
    components.union(got, np.searchsorted(copies, u), np.searchsorted(copies, v))
    assert got.tolist() == want.tolist() and counts[0] < len(copies) ** 2 / 8


@pytest.mark.parametrize("block", [16, 200, 5000])
def test_gray_index_links_all(spark, block, monkeypatch):
    r = np.random.default_rng(block)
    base = r.integers(0, 2**63, 60).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False))) for b in base for _ in range(12)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), np.zeros(1, np.uint64)]))
    monkeypatch.setattr(near_dup.index_blocks, "__defaults__", (block,))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {x.node: x.least for x in components.components(near_dup.fingerprint_links(df)).collect()}
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(a ^ fps) <= 3)[0]:
            x, y = find(int(fps.view(np.int64)[i])), find(int(fps.view(np.int64)[j]))
            parent[max(x, y)] = min(x, y)
    want = {a: find(a) for a in parent}
    assert all(got.get(a, a) == c for a, c in want.items())


@pytest.mark.parametrize("task_links", [10, 1_000_000])
def test_components(spark, task_links):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    got = {x.node: x.least for x in components.components(spark.createDataFrame(links, "u long, v long"), task_links).collect()}
    parent = {n: n for e in links for n in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got.get(n, n) == p for n, p in parent.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_drop_lines(odd, empty):
    rows = odd_rows()
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -(2**63) if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(order(r[0]))
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(r[0])]
        want[r[0], len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    got = line_dedup.drop_lines(odd)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == want
    assert sum(k[2] * v for k, v in want.items()) > 2
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert line_dedup.drop_lines(empty).collect() == []
    again = line_dedup.drop_lines(got)
    assert again.columns[-2:] == ["n_lines_", "n_dropped_"] and again.where("n_dropped_ > 0").count() == 0


def test_perfect_hash():
    h = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    p = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(h).dump())
    assert sorted(p.index(h).tolist()) == list(range(len(h)))
    assert line_dedup.PerfectHash.build(h[:0]).index(h).max() == -1


def test_mix(odd, empty):
    rows = odd_rows()
    got = mixing.mix(odd).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    source = {(r[0], size(r[1])): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in names)
    assert sorted(map(tuple, mixing.mix(odd).drop("uid").collect()), key=repr) == sorted((tuple(r)[1:] for r in got), key=repr)
    assert mixing.mix(empty).collect() == []


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 3000)], "source string, size long")
    plan = mixing.stage(mixing.source_plan(plan, block_tokens=8))
    slots = mixing.schedule(plan, 8).orderBy("place").collect()
    share = Counter(s.sid for s in slots)
    for k in range(0, len(slots) - 200, 100):
        part = Counter(s.sid for s in slots[k : k + 200])
        assert all(abs(part[s] - 200 * share[s] / len(slots)) < 12 for s in share)
    for s in share:
        own = [x for x in slots if x.sid == s]
        assert [x.rank for x in own] == list(range(len(own)))


def test_token_files(odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = odd_rows()
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    want = Counter((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    got = token_files.token_digests(odd, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda i: -1 if i is None else i)
    assert token_files.token_digests(empty, path).collect() == []


def test_pack():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        x = r.integers(0, 2 ** r.integers(1, 33, n, dtype=np.int64)).astype(np.uint32) if n else np.zeros(0, np.uint32)
        assert token_files.unpack(*token_files.pack(x), n).tolist() == x.tolist()


def test_word_encoder_agrees():
    path = tokenizer("word_bpe_49k.json")
    r, e = random.Random(5), token_files.WordEncoder(path)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "é", " ", "　", "The", "1", ".", "!!", "<|endoftext|>", "\x1c", "\x85", "ß", "日本", "'ll", "İ", "ΑΣ", "½", "̸"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(800)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.ids([t.encode() for t in texts])] == want


def test_edit_report(odd, empty, monkeypatch):
    for run in (1024, 4):
        monkeypatch.setattr(sketches, "RUN_DOCS", run)
        got = sketches.edit_report(odd).collect()
        rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in odd_rows()), key=lambda r: (-r[0], r[1]))
        want = Counter()
        for k, (i, t) in enumerate(rows):
            new = sketches.edited(t, rows[(k + 1) % len(rows)][1])
            want[None if i == -(2**63) else i, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert sketches.edit_report(empty).collect() == []
    one = odd.where("doc_id = 5")
    assert sketches.edit_report(one).first().near_next == 1


def test_sketch_estimates():
    r = np.random.default_rng(4)
    a = r.integers(0, 2**63, 8000).astype(np.uint64) * np.uint64(2)
    b = np.concatenate([a[:4000], r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)])
    A, B, small = sketches.Sketch.of(a), sketches.Sketch.of(b), sketches.Sketch.of(a[:300])
    assert A.likeness(B) == pytest.approx(1 / 3, abs=0.05) and small.contained(A) == 1 and A.contained(small) == pytest.approx(300 / 8000, abs=0.02)
    assert str(sketches.Sketch.parse(str(A))) == str(A)
    assert str(A.merge(B)) == str(sketches.Sketch.of(np.concatenate([a, b])))


def test_bpe(odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids for r in odd_rows()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((r[0], len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for r, i in zip(odd_rows(), ids, strict=True))
    assert Counter(map(tuple, bpe_lexicon.encode_digests(odd, path).collect())) == want
    assert Counter((r.doc_id, tuple(r.ids)) for r in bpe_lexicon.encode(odd, path).collect()) == Counter((r[0], tuple(i)) for r, i in zip(odd_rows(), ids, strict=True))
    assert bpe_lexicon.encode_digests(empty, path).collect() == []


def test_lexicon_and_merges():
    path = tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, rules, r = Tokenizer.from_file(path), bpe_lexicon.Merges.of(path), random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", " ", "　", "the", "22", ".", "<|endoftext|>", "\x1c", "\x85", "日本", "🙂", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(500)] + ["a" * 3000, "%#@!" * 300]
    raw = [x.encode() for x in texts]
    words = sorted({w for x in raw for w in bpe_lexicon._WORDS.findall(x) if len(rules.segments(w)) == 1 and not bpe_lexicon._WIDE_SPACE.search(w)})[::2]
    lexicon = bpe_lexicon.Lexicon.build(words, [rules.word(w) for w in words])
    joined, ends = b"".join(words), np.cumsum([len(w) for w in words])
    assert lexicon.numbers(np.frombuffer(joined, np.uint8), ends - [len(w) for w in words], ends).tolist() == list(range(len(words)))
    got = bpe_lexicon.encode_slice(raw, rules, lexicon)
    assert [g.tolist() for g in got] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    some = [w for w in words if len(w) <= bpe_lexicon.LONG_PIECE and len(rules.pieces(w.decode())) == 1]
    assert [np.frombuffer(x, "<u4").tolist() for x in rules.merge_all(some)] == [rules.merge(w) for w in some]


EVERY = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point(name):
    from tokenizers import Tokenizer

    path = tokenizer(name)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    r = random.Random(11)
    # each in a word, beside a digit, beside a sign, and among random others
    step = 7 if name.startswith("byte") else 1
    texts = [f"a{c}b 1{c}! {c} {r.choice(EVERY)}{c}{r.choice(EVERY)}" for c in EVERY[:0x3000] + EVERY[0x3000::step] if c not in "\n"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    raw = [x.encode() for x in texts]
    if name.startswith("byte"):
        rules, empty = bpe_lexicon.Merges(path), bpe_lexicon.Lexicon.build([], [])
        got = [x.tolist() for k in range(0, len(raw), 4096) for x in bpe_lexicon.encode_slice(raw[k : k + 4096], rules, empty)]
    else:
        e = token_files.WordEncoder(path)
        got = [np.frombuffer(x, f"<u{np.dtype(e.kind).itemsize}").tolist() for k in range(0, len(raw), 4096) for x in e.ids(raw[k : k + 4096])]
    assert [x for x, g, w in zip(texts, got, want, strict=True) if g != w][:20] == []


def test_letters_agree_below_first():
    from cairn.llm import letters

    low = "".join(c for c in EVERY if c < letters.Pieces.FIRST)
    import regex

    for kind in letters.KINDS:
        own = {c for a, b in letters.ranges(kind) for c in range(a, b + 1)}
        assert {c for c in low if ord(c) in own} == set(regex.findall(kind, low))
    assert {c for c in low if c.isalpha()} == set(regex.findall(r"\p{L}", low))


def test_wide_spaces_and_special_tokens():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t, rules, r = Tokenizer.from_file(path), bpe_lexicon.Merges.of(path), random.Random(9)
    parts = ["a", "bc", " ", "\n", "\u00a0", "\u3000", "\u2003", "\u1680", "\u205f", "\x85", "é", "\u200b", "<|endoftext|>", "日", "1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(20000)]
    raw = [x.encode() for x in texts]
    words = sorted({b"a", b" a", b"bc", b" bc", b"\n", b" ", "é".encode()})
    lexicon = bpe_lexicon.Lexicon.build(words, [rules.word(w) for w in words])
    assert [g.tolist() for g in bpe_lexicon.encode_slice(raw, rules, lexicon)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_wide_spaces_leave_the_lexicon_in_use(monkeypatch):
    path = tokenizer("byte_bpe_50k.json")
    rules = bpe_lexicon.Merges.of(path)
    words = sorted({b"word", b" word", "\u00a0".encode()})
    lexicon = bpe_lexicon.Lexicon.build(words, [rules.word(w) for w in words])
    monkeypatch.setattr(bpe_lexicon.Merges, "words", lambda self, new: [] if not new else pytest.fail(f"merged {new}"))
    assert len(bpe_lexicon.encode_slice(["word\u00a0word word word".encode()], rules, lexicon)[0]) > 3


def test_large_arrow_types(spark, odd):
    path, old = tokenizer("word_bpe_49k.json"), spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes")
    make = (lambda d: token_files.token_digests(d, path), lambda d: bpe_lexicon.encode_digests(d, tokenizer("byte_bpe_50k.json")), line_dedup.drop_lines, sketches.edit_report, near_dup.near_groups, near_dup.drop_similar, neural_lm.lm_scores)
    want = [Counter(map(repr, f(odd).collect())) for f in make]
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        for f, w in zip(make, want, strict=True):
            assert Counter(map(repr, f(odd).collect())) == w
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", old)


def test_lm(odd, empty, monkeypatch):
    rows = odd_rows()
    tokens = [[w.encode() for w in WORD.findall(low(r[1] or ""))] + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for r, x, h in zip(rows, tokens, held, strict=True))
    for head, least in ((neural_lm.HEAD, neural_lm.MIN_COUNT), (4, 2), (4, 10**9)):
        monkeypatch.setattr(neural_lm, "HEAD", head)
        monkeypatch.setattr(neural_lm, "MIN_COUNT", least)
        got = neural_lm.lm_scores(odd).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert neural_lm.lm_scores(empty).collect() == []


def test_lm_stream_and_batches():
    row, place = neural_lm.stream(np.array([5, 6, 7, 8]), np.array([0, 3, 4]), 99)
    s = [99] * 8
    assert row.tolist() == [*s, 5, 6, 7, *s, 8] and (row[place + 8]).tolist() == [5, 6, 7, 8]
    assert neural_lm.CONTEXT == 8 and neural_lm.BATCH == 1024
    ids = np.arange(3000, dtype=np.int32)
    row, _ = neural_lm.stream(ids, np.array([0, 3000]), 9999)
    seen = []
    for lines in neural_lm.batches_of(row, 9999, 1):
        for line in lines.tolist():
            for k in range(8, len(line)):
                if line[k] != 9999:
                    seen.append(line[k])
                    assert line[k - 8 : k] == [9999 if line[k] - 8 + j < 0 else line[k] - 8 + j for j in range(8)]
    assert sorted(seen) == ids.tolist()


def slow_probability(m, context):
    """By the definition, a word at a time."""
    w = m.words
    q = sum(m.place[i].astype(float) * m.in_[c] for i, c in enumerate(context))
    e = [math.exp(q @ m.out[o] + m.bias[o]) for o in range(w.outputs)]
    first = [x / sum(e) for x in e]
    out = {}
    for k in range(w.start):
        if k < w.singles:
            out[k] = first[k]
        elif k >= w.words:
            out[k] = first[w.singles + w.classes + k - w.words]
        else:
            c = (k - w.singles) // w.run
            own = [j for j in range(w.singles, w.words) if (j - w.singles) // w.run == c]
            e = {j: math.exp(q @ m.own[j] + m.own_bias[j]) for j in own}
            out[k] = first[w.singles + c] * e[k] / sum(e.values())
    return out


def trained_lm(words=300):
    r = np.random.default_rng(2)
    w = neural_lm.Words.of(words)
    n = np.concatenate([np.sort(r.integers(30, 4000, words))[::-1], r.integers(0, 90, neural_lm.GROUPS)])
    t = neural_lm.Trainer(neural_lm.Model.start(w, n), n)
    ids = r.choice(w.start, 40000, p=n / n.sum())
    ids[1::2] = (ids[::2] * 7 + 3) % words  # each second follows from the one before
    row, place = neural_lm.stream(ids, np.array([0, 9, 9, 40000]), w.start)
    for lines in neural_lm.batches_of(row, w.start, 0):
        t.step(lines)
    return t.model, row, place, ids

def plain_sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_move(m, k, at, rows):
    """A step of part k against the sum of the rows that each of its rows gets."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    g, at = np.add.reduceat(rows[order], first) * np.float32(32 / neural_lm.BATCH), at[first]
    x, s = m.parts[k], m.squares[k]
    s[at] += (g * g).mean(1) if g.ndim > 1 else g * g
    rate = neural_lm.RATE / np.sqrt(s[at])
    x[at] -= (rate[:, None] if g.ndim > 1 else rate) * g


def plain_step(t, lines):
    """Trainer.step() by its definition: the same draws, targets, rows and sums, one after another."""
    m, w, row, c = t.model, t.model.words, lines.ravel(), neural_lm.CONTEXT
    x = m.in_[row]
    there = np.nonzero((np.arange(len(row)) % lines.shape[1] >= c) & (row != w.start))[0]
    ids = row[there]
    q = sum(x[there - 1 - i] * m.place[i] for i in range(c))
    at, noise = w.output(ids), t.rng.choice(w.outputs, neural_lm.NOISE, p=t.noise_p)
    out, drawn = m.out[at], m.out[noise]
    g_own = plain_sigmoid((q * out).sum(1) + m.bias[at] - t.log_noise[at]) - 1
    g_other = plain_sigmoid(q @ drawn.T + (m.bias[noise] - t.log_noise[noise]))
    dq = g_own[:, None] * out + g_other @ drawn
    rows = np.concatenate([g_own[:, None] * q, g_other.T @ q])
    plain_move(m, 2, np.concatenate([at, noise]), rows)
    plain_move(m, 3, np.concatenate([at, noise]), np.concatenate([g_own, g_other.sum(0)]))
    inner = np.nonzero((ids >= w.singles) & (ids < w.words))[0]
    if len(inner):
        own, qi, k = ids[inner], q[inner], neural_lm.CLASS_NOISE
        lo, hi = w.span((own - w.singles) // w.run)
        size = (hi - lo).astype(np.float32)
        draws = lo[:, None] + (t.rng.random((len(inner), k), np.float32) * size[:, None]).astype(np.int64)
        both = np.concatenate([own[:, None], np.minimum(draws, hi[:, None] - 1)], 1)
        vectors = m.own[both]
        g = plain_sigmoid((qi[:, None] * vectors).sum(2) + m.own_bias[both] - np.log(k / size)[:, None])
        g[:, 0] -= 1
        dq[inner] += (g[:, :, None] * vectors).sum(1)
        plain_move(m, 4, both.ravel(), (g[:, :, None] * qi[:, None]).reshape(-1, neural_lm.WIDTH))
        plain_move(m, 5, both.ravel(), g.ravel())
    g_in, g_place = np.zeros_like(x), np.empty_like(m.place)
    for i in range(c):
        g_in[there - 1 - i] += dq * m.place[i]
        g_place[i] = (dq * x[there - 1 - i]).sum(0)
    plain_move(m, 0, row, g_in)
    plain_move(m, 1, np.arange(c), g_place)


def lm_case(words):
    """Two trainers of the same start, and batches of texts of Zipf's words; the last is short."""
    r = np.random.default_rng(5)
    w = neural_lm.Words.of(words)
    n = np.concatenate([(4e6 / np.arange(3, words + 3)).astype(np.int64), r.integers(0, 90000, neural_lm.GROUPS)])
    ids = r.choice(w.start, 45000, p=n / n.sum())
    upto = np.concatenate([[0], np.sort(r.integers(0, 45000, 90)), [45000]])
    batches = list(neural_lm.batches_of(neural_lm.stream(ids, upto, w.start)[0], w.start, 0))
    return [neural_lm.Trainer(neural_lm.Model.start(w, n), n) for _ in range(2)], batches


@pytest.mark.parametrize("words", [20, 60, 3000, 16384])
def test_lm_step_by_definition(words):
    (one, two), batches = lm_case(words)
    for lines in [*batches[:20], batches[-1], np.full_like(batches[0], one.model.words.start)]:
        one.step(lines)
        plain_step(two, lines)
    for x, y in zip(one.model.parts + one.model.squares, two.model.parts + two.model.squares, strict=True):
        assert np.allclose(x, y, rtol=2e-3, atol=2e-4)
    # the draws are the same ones
    assert one.rng.random() == two.rng.random()


def test_lm_step_sums_only_what_goes_to_the_same_place(monkeypatch):
    """Most of a batch's rows go to places of their own; a sum for each of those took a sixth of a training step."""
    (one, _), batches = lm_case(16384)
    summed, add = [], np.add

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:  # noqa: N801
            @staticmethod
            def reduceat(rows, at, *more):
                summed.append(len(at))
                return add.reduceat(rows, at, *more)

    monkeypatch.setattr(neural_lm, "np", Counting())
    for lines in batches[:10]:
        one.step(lines)
    assert 0 < sum(summed) / 10 < 3500


def test_lm_tokens_of_many_texts_are_those_of_each():
    texts = [t.encode() for t in ["", "a", " ", "\n", "A bc  Bc", "x" * 300, "éÉ \t word"]] * 40
    h, g, upto = neural_lm.tokens(texts)
    each = [neural_lm.tokens([t]) for t in texts]
    assert np.array_equal(h, np.concatenate([x[0] for x in each])) and np.array_equal(g, np.concatenate([x[1] for x in each]))
    assert upto.tolist() == np.cumsum([0, *(len(x[0]) for x in each)]).tolist()
    assert [len(x) for x in neural_lm.tokens([])] == [0, 0, 1]


def test_lm_probabilities_by_definition():
    m, row, place, ids = trained_lm()
    got = m.log_probabilities(row)[place]
    for k in (0, 1, 8, 9, 20, 500, 39999):
        want = slow_probability(m, row[place[k] : place[k] + 8][::-1].tolist())
        assert sum(want.values()) == pytest.approx(1, abs=1e-6)
        assert got[k] == pytest.approx(math.log(want[ids[k]]), abs=1e-4)
    # what training found
    assert got[1001::2].mean() > got[1000::2].mean() + 0.5
    again = neural_lm.Model.of(m.words, m.flat())
    assert np.array_equal(again.log_probabilities(row), m.log_probabilities(row))


def test_lm_scores_by_definition(spark, odd, monkeypatch):
    """A text's score: of each token the probability of its word, or of its group times its smoothed share of the group's count."""
    monkeypatch.setattr(neural_lm, "MIN_COUNT", 3)
    learn = odd.where(neural_lm.training("doc_id")).selectExpr("text t")
    counts = neural_lm.gather(neural_lm.stage(neural_lm.token_counts(learn)))
    model = neural_lm.train(learn, counts)
    assert counts.words.words > 8
    monkeypatch.setattr(neural_lm, "train", lambda *_: model)
    got = {r.doc_id: r.score for r in neural_lm.lm_scores(odd).collect()}
    rows = [r for r in odd_rows() if r[0] in (2, 5, 7, 16)]
    every = Counter(w for r in odd_rows() if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 for w in [*WORD.findall(low(r[1] or "")), None])
    hashes = {}
    for w in every | Counter(w for r in rows for w in WORD.findall(low(r[1] or ""))):
        h, g, _ = neural_lm.tokens([w.encode()] if w else [b""])
        hashes[w] = h[0], int(g[0])
    known = {w: int(counts.model.get(np.array([h]), -1)[0]) for w, (h, _) in hashes.items()}
    assert {w for w, i in known.items() if i >= 0} <= set(every)
    for r in rows:
        total, context = 0.0, [counts.words.start] * 8
        for w in [*WORD.findall(low(r[1] or "")), None]:
            p, g = slow_probability(model, context), hashes[w][1]
            share = 1.0
            if known[w] < 0:
                share = (every[w] + 0.1) / (0.1 + sum(n + 0.1 for x, n in every.items() if known[x] < 0 and hashes[x][1] == g))
            k = known[w] if known[w] >= 0 else counts.words.words + g
            total += math.log10(p[k] * share)
            context = [k, *context[:7]]
        assert got[r[0]] == pytest.approx(total, abs=1e-3)


def test_lm_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = neural_lm.lm_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n", "avg(CAST(score > base_score AS INT)) better").first()
    assert (held.s - held.b) / held.n > 0.25 and held.better > 0.9


def test_lm_gain_does_not_follow_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gain = lambda d: neural_lm.lm_scores(d).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) g").first().g
    assert abs(gain(docs.repartition(16)) - gain(docs.coalesce(1))) < 0.05


def test_lm_words_follow_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("text t")
    few, all_ = (neural_lm.gather(neural_lm.stage(neural_lm.token_counts(d))).words.words for d in (docs.limit(100), docs))
    assert 191 < 4 * few < all_


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 20)] + [(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    got = quality.quality_report(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert quality.quality_report(empty, labels).collect() == []
    assert {r.score for r in quality.quality_report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_quality_learns_from_one_of_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {k}") for k in range(500)] + [(2, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "ftrl", lambda found, seen=seen: (_ for _ in ()).throw(ValueError(f"learnt {len(found)}")))
    with pytest.raises(Exception, match="learnt [12]\\b"):
        quality.train(docs, labels)


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.quality_report(docs, labels).where("held_out").join(labels, "doc_id").selectExpr("avg(CAST(predicted = quality AS INT)) a").first().a
    assert held > 0.95


def slow_features(text):
    """A text's features by name: words, pairs, and triples of shapes."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\t-\r 0-9A-Za-z\x80-\xff]+", text)]
    out, shapes = [], []
    for k, (w, a, _) in enumerate(words):
        before = words[k - 1] if k else None
        signs = not re.match(rb"[0-9A-Za-z\x80-\xff]", w)
        own = w if signs else (len(re.findall(rb"[A-Z]", w)) > 1, bool(re.search(rb"[a-z]", w)), bool(re.search(rb"[0-9]", w)), bool(re.match(rb"[A-Z]", w)))
        shapes.append((own, bool(before and before[2] == a), bool(before and before[0] == w)))
        out += [("word", w), ("pair", before and before[0], w), ("shapes", *shapes[max(0, k - 2) : k + 1])]
    return out


def test_features_by_definition():
    r = random.Random(6)
    parts = ["One", "two", "USA", "x9", "9", "##", ".", "...", "été", "\n", " ", "  ", "\t", "-", "a", "a a"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))).encode() for _ in range(400)]
    at, upto = quality.features(texts)
    number = {}
    for t, a, b in zip(texts, upto[:-1], upto[1:], strict=True):
        names = slow_features(t)
        assert len(names) == b - a
        for name, x in zip(names, at[a:b].tolist(), strict=True):
            assert number.setdefault(name, x) == x  # one place each
    assert len(set(number.values())) > 0.96 * len(number)  # few share one


def test_ftrl_by_definition():
    r = np.random.default_rng(0)
    examples = [quality.example(" ".join(f"w{x}" for x in r.integers(0, 40 + 30 * (k % 2), 30)).encode(), k % 2) for k in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, x, y in examples:
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.ftrl(examples)
    assert all(got[i] == pytest.approx(weight(i), abs=1e-5) for i in z) and np.count_nonzero(got) == sum(weight(i) != 0 for i in list(z))
    text = b"w1 w2 unseen w1"
    at, x, _ = quality.example(text, 0)
    assert quality.scores([text], got)[0] == pytest.approx(1 / (1 + math.exp(-sum(got[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True)))), abs=1e-6)


def slow_likeness(a, b):
    sets = []
    for t in (a, b):
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_likeness_by_definition(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000000 doc_id", "text").distinct())
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    want = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        want[i] = slow_likeness(t, sketches.edited(t, after)), slow_likeness(t, after)
    whole = {r.doc_id: (r.near_edited, r.near_next) for r in sketches.edit_report(docs, fraction=1.0).collect()}
    assert all(whole[i] == pytest.approx(w) for i, w in want.items())  # with all hashes it is no estimate
    got = {r.doc_id: r for r in sketches.edit_report(docs).collect()}
    errors = [abs(got[i].near_edited - w[0]) for i, w in want.items()] + [abs(got[i].near_next - w[1]) for i, w in want.items()]
    assert np.mean(errors) < 0.05 and max(errors) < 0.3
    for r in got.values():  # the fingerprint holds all that the columns tell
        a, b = sketches.Sketch.parse(r.fingerprint), sketches.Sketch.parse(r.edited_fingerprint)
        assert a.likeness(b) == r.near_edited
    strict = {r.doc_id: sketches.Sketch.parse(r.fingerprint) for r in sketches.sketches(docs, floor=0).collect()}
    assert {s.limit for s in strict.values()} == {1 << 61} and all((s.hashes < np.uint64(1 << 61)).all() for s in strict.values())


def test_features_do_not_span_texts():
    texts = [b"one two three ### FOUR", b"", b"x", b"5 six"]
    at, upto = quality.features(texts)
    assert [at[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [quality.features([t])[0].tolist() for t in texts]
