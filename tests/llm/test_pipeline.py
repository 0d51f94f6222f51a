from collections import Counter

import pytest
from conftest import DATA

import corpus_pipeline as P
from cairn.llm import bpe_lexicon, line_dedup, mixing, quality
from cairn.llm.queries import tokenizer


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage kept, written and read as the driver does it."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1]) and steps[-1].columns == ["doc_id", "ids", "n_tokens"]


def test_classifier_keeps_what_it_predicts(spark, steps):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality.quality_report(steps[0], labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows(steps[1])} == good


def test_lines(steps):
    before = {r["doc_id"]: r["text"] for r in rows(steps[1])}
    seen: dict = {}
    for i in sorted(before):
        for k in {line_dedup.line_key(x.encode()) for x in (before[i] or "").split("\n")} - {None}:
            seen.setdefault(k, i)
    for r in rows(steps[2]):
        want = [x for x in (before[r["doc_id"]] or "").split("\n") if seen.get(line_dedup.line_key(x.encode()), r["doc_id"]) == r["doc_id"]]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])


def test_near(steps):
    before = rows(steps[2])
    sets = {}
    for r in before:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in rows(steps[3])} == {i for i in parent if parent[i] == i}


def test_mix(steps):
    taken = {r.doc_id: round(r.taken / r["size"] + 1e-12) for r in mixing.mix(steps[3]).where("size > 0").collect()}
    got = Counter(r["doc_id"] for r in rows(steps[4]))
    assert all(abs(got[i] - n) <= 1 for i, n in taken.items()) and sum(got.values()) > 0 and max(got.values()) <= 3


def test_encoding(steps):
    rules = bpe_lexicon.Merges.of(tokenizer("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in rows(steps[4])}
    for r in rows(steps[5]):
        assert bpe_lexicon.decode(r["ids"], rules) == text[r["doc_id"]] and len(r["ids"]) == r["n_tokens"]


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, nth string, n_lines long"
    data = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, "x", 1), (2, "word", None, None, 4, 1, "x", 1), (2, "word", None, None, 4, 1, "x", 1)]
    for docs in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        for _, f in P.STAGES[:-1]:
            docs = P.stage(f(spark, docs, DATA))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        P.STAGES[-1][1](spark, docs, DATA).collect()
