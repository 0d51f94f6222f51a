import gzip
import hashlib
import io
from collections import Counter, defaultdict

from cairn.llm import warc
from cairn.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, sha1 string, size long, id int, key string"


def rows():
    big = "<p>été " * 200
    pages = [None, "", "small", "small", big, big, big, big + "!", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40, "a\r\n\r\nb\n" * 200, "ab\n" * 20000]
    out = [(i, None if i == 2 else f"http://h/{i} x\n", t, "s", 1, 2, "k") for i, t in enumerate(pages)]
    return [*out, out[5], (None, "u", big, None, None, None, None)]


def test_report(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    groups = defaultdict(list)
    for r in rows():
        groups[r[2] or ""].append(r[0])
    want = Counter()
    for i, _, t, *_ in rows():
        data = (t or "").encode()
        last = max((x for x in groups[t or ""] if x is not None), default=None)
        revisit = len(data) >= 1000 and i != last
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert Counter(map(tuple, warc.page_report(df).collect())) == want
    assert warc.page_report(df.limit(0)).collect() == []


def test_captures_nest_their_records(spark):
    path = shared_dir(spark)
    warc.write_captures(spark.createDataFrame(rows(), SCHEMA), path)
    got = warc.captures(warc.read_records(spark, path)).collect()
    assert len(got) == len(rows()) and all(len(r.request) == 1 and len(r.metadata) == 1 for r in got)
    by_page = {r.metadata[0].fields["pageId"]: r for r in got}
    assert bytes(by_page["8"].response.payload).decode() == rows()[8][2]
    assert by_page["4"].response.type == "revisit" and bytes(by_page["4"].response.payload) == b"" and by_page["4"].response.digest == by_page["6"].response.payload_digest


def test_parses_many_members_and_odd_lines():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Type: text/plain\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(b"\r\n" + record)
    found = list(warc.parse_records(io.BufferedReader(gzip.open(io.BytesIO(data)))))
    assert [r["payload"] for r in found] == [b"WARC/1.1\r\n\r\n"] * 2


def _raw(kind, name, others=(), body=b"x"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"WARC-Concurrent-To: <{o}>" for o in others), f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _assemble(spark, tmp_path, *records):
    for k, r in enumerate(records):  # some in one file, some in another
        with open(tmp_path / f"f{k % 2}.warc", "ab") as f:
            f.write(r)
    found = warc.captures(warc.read_records(spark, f"file://{tmp_path}")).collect()
    ids = lambda x: sorted(r.record_id.strip("<>") for r in x)
    return {r.capture_id.strip("<>"): (r.response and r.response.record_id.strip("<>"), ids(r.request), ids(r.metadata), ids(r.other)) for r in found}


def test_every_layout_is_assembled(spark, tmp_path):
    records = [
        _raw("warcinfo", "i"),
        _raw("request", "q1", ["r1"]), _raw("response", "r1"), _raw("metadata", "m1", ["r1"]),  # both name the response
        _raw("response", "r2", ["q2"]), _raw("request", "q2"), _raw("metadata", "m2", ["q2", "r2"]),  # the response names its request, metadata both
        _raw("response", "r3", ["q3", "m3"]), _raw("request", "q3"), _raw("metadata", "m3"),  # the response names all
        _raw("revisit", "r4", ["q4"]), _raw("request", "q4"), _raw("metadata", "m4", ["q4"]), _raw("metadata", "n4", ["m4"]),  # through others
        _raw("response", "r5"),  # alone
        _raw("request", "q6", ["gone"]), _raw("metadata", "m7", ["q7"]), _raw("request", "q7"), _raw("metadata", "n7", ["m7"]),  # no response
        _raw("resource", "r8"), _raw("metadata", "m8", ["r8", "r8"]), _raw("conversion", "c8", ["r8"]), _raw("conversion", "c9"),
        _raw("response", "a"), _raw("response", "b"), _raw("request", "q", ["b", "a"]),  # two responses
    ]
    assert _assemble(spark, tmp_path, *records) == {
        "r1": ("r1", ["q1"], ["m1"], []), "r2": ("r2", ["q2"], ["m2"], []), "r3": ("r3", ["q3"], ["m3"], []), "r4": ("r4", ["q4"], ["m4", "n4"], []), "r5": ("r5", [], [], []),
        "q6": (None, ["q6"], [], []), "m7": (None, ["q7"], ["m7", "n7"], []), "r8": ("r8", [], ["m8"], ["c8"]), "a": ("a", ["q"], [], []), "b": ("b", [], [], []),
    }


def test_files_are_sized(spark, monkeypatch):
    path = shared_dir(spark)
    monkeypatch.setattr(warc, "FILE_BYTES", 4096)
    pages = spark.range(200).selectExpr("id page_id", "'u' url", "repeat(md5(string(id)), 40) html").coalesce(1)
    warc.write_captures(pages, path)
    assert len(spark.read.format("binaryFile").load(path).select("path").collect()) > 20
    monkeypatch.undo()
    assert warc.page_report(pages.selectExpr("CAST(NULL AS LONG) page_id", "url", "'same' html")).count() == 200
