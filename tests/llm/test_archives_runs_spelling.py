"""WARC archives (11), periodic runs (12) and spelling variants (13)."""

import gzip
import hashlib
import io
import json
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.llm import periodic_runs, queries, spelling_variants, warc
from tests.compare import differences
from tests.conftest import SMALL

PAGES = "page_id long, url string, html string, payload string, key string, record_type string, `group` string, n long, largest long, hash string"


@pytest.mark.parametrize("name", ["op11_warc", "op12_periodic_runs", "op13_spelling_variants"])
def test_queries_agree_with_sql(spark, con, name):
    problem, rows = differences(spark, con, name, SMALL)
    assert not problem and rows > 0


# --- archives ---


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Nulls, empty and very long payloads, equal payloads under and over the least size, ties, repeated rows, clashing columns."""
    big, other = "<p>" + "same text " * 200, "<p>" + "ü" * 500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (7, "http://b/ x\r\nWARC-Type: evil", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None),
            (6, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", other), (11, "u", other), (11, "u", other), (12, "u", "y" * 3_000_000),
            (None, "u", big), (13, "é%/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 30), (None, None, None)]
    return spark.createDataFrame([(*r, *("c",) * 3, "g", 5, 6, "h") for r in rows], PAGES)


def archived(spark, frame, folder, **options):
    warc.archive(frame, folder, date="2026-01-01T00:00:00Z", **options)
    return folder


def by_hand(rows):
    largest = {}
    for r in rows:
        p = (r["html"] or "").encode()
        if len(p) >= 1000:
            key = -1 if r["page_id"] is None else r["page_id"]
            largest[p] = max(largest.get(p, -1), key)
    out = Counter()
    for r in rows:
        p = (r["html"] or "").encode()
        key = -1 if r["page_id"] is None else r["page_id"]
        again = key < largest.get(p, -1)
        out[r["page_id"], len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", largest[p] if again else None] += 1
    return out


def test_pages_there_and_back(spark, odd_pages, tmp_path):
    for k, (frame, options) in enumerate([(odd_pages, {}), (odd_pages.repartition(5), {"max_file_bytes": 2000, "level": 1}), (odd_pages.limit(0), {})]):
        folder = archived(spark, frame, str(tmp_path / str(k)), **options)
        got = warc.archived_pages(spark, folder, T.LongType()).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(map(tuple, got.collect())) == by_hand(odd_pages.limit(0).collect() if k == 2 else odd_pages.collect())


def test_payloads_and_headers_come_back(spark, odd_pages, tmp_path):
    folder = archived(spark, odd_pages, str(tmp_path / "w"))
    records = warc.read_warc(spark, folder).collect()
    assert Counter(r["record_type"] for r in records)["warcinfo"] == len(warc.committed_files(folder))
    responses = [r for r in records if r["record_type"] == "response"]
    texts = {r["page_id"]: r["html"] or "" for r in odd_pages.where("page_id is not null").collect()}
    for r in responses:
        assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_sha1"] and r["http_status"] == 200
        key = r["record_id"].removeprefix("<urn:row:").removesuffix(">")
        assert not key or r["payload"].decode() == texts[int(key)]
    assert next(r for r in responses if r["record_id"] == "<urn:row:7>")["target_uri"] == "http://b/%20x%0D%0AWARC-Type:%20evil"
    assert all(r["payload"] == b"" for r in records if r["record_type"] == "revisit")


def test_filters_reach_the_source_and_skip_payloads(spark, odd_pages, tmp_path, monkeypatch):
    folder = archived(spark, odd_pages, str(tmp_path / "w"))
    frame = warc.read_warc(spark, folder, ["record_type", "target_uri", "payload"]).where(
        "record_type = 'response' and target_uri like 'http://a/%' and not target_uri <=> 'http://a/1' and length(payload) > 1")
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in text and "record_type#" in text and "= response" not in text  # decided by the source
    assert [r["target_uri"] for r in frame.collect()] == ["http://a/4"]
    # Payloads of records that don't pass are not decoded, nor are those that no column asks for.
    decoded = []
    original = warc._Members.rest
    monkeypatch.setattr(warc._Members, "rest", lambda self: decoded.append(self.left) or original(self))
    reader = warc.WarcReader({"path": folder}, ["record_type", "payload"])
    left = list(reader.pushFilters([D.EqualTo(("record_type",), "revisit"), D.EqualTo(("payload",), b"x"), D.EqualTo(("headers", "x"), "y")]))
    assert [f.attribute for f in left] == [("payload",), ("headers", "x")]
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 4 == len(decoded)
    decoded.clear()
    reader = warc.WarcReader({"path": folder}, ["record_type", "http_headers"])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) > 16 and not decoded


@pytest.mark.parametrize("test, value, passes", [
    (D.EqualTo(("c",), "a"), "a", True), (D.EqualTo(("c",), "a"), None, False), (D.EqualNullSafe(("c",), None), None, True), (D.In(("c",), ("a", "b")), "b", True),
    (D.Not(D.In(("c",), ("a", None))), "b", False), (D.Not(D.EqualTo(("c",), "a")), None, False), (D.IsNull(("c",)), None, True), (D.IsNotNull(("c",)), None, False),
    (D.IsNotNull(("c",)), "a", True), (D.Not(D.IsNull(("c",))), "a", True), (D.GreaterThan(("c",), 3), 4, True), (D.LessThanOrEqual(("c",), 3), 4, False),
    (D.GreaterThanOrEqual(("c",), "b"), "a", False), (D.LessThan(("c",), "b"), "a", True), (D.StringStartsWith(("c",), "a"), "ab", True),
    (D.StringEndsWith(("c",), "a"), "ab", False), (D.StringContains(("c",), "b"), "abc", True), (D.Not(D.EqualNullSafe(("c",), "a")), None, True),
])
def test_filters_by_the_rules_of_sql(test, value, passes):
    assert warc.passes(value, test) is passes


def record(kind, uri, block, **headers):
    return warc.record_bytes({"WARC-Type": kind, "WARC-Target-URI": uri, **headers}, block)


@pytest.mark.parametrize("form", ["plain", "members", "one member", "several a member"])
def test_foreign_files(spark, tmp_path, form):
    """Plain files, members without stated length, and one member over several records; blocks that look like records."""
    trap = record("response", "inner", b"x" * 10)
    records = [record("warcinfo", None, b"a: b\r\n"), record("response", "http://x", b"HTTP/1.0 404 Gone\r\nA: 1\r\n B\r\n\r\nbody", **{"Content-Type": "application/http; msgtype=response"}),
               record("resource", "file", trap * 3), record("conversion", "empty", b""), record("response", "broken", b"no header end", **{"Content-Type": "application/http"})]
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "one member": gzip.compress(b"".join(records)),
            "several a member": gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))}[form]
    path = tmp_path / ("f.warc" if form == "plain" else "f.warc.gz")
    path.write_bytes(data)
    rows = {r["target_uri"]: r for r in warc.read_warc(spark, str(path)).collect()}
    assert len(rows) == 5 and rows["file"]["payload"] == trap * 3 and rows["empty"]["payload"] == b""
    assert (rows["http://x"]["http_status"], rows["http://x"]["payload"], rows["http://x"]["http_headers"]) == (404, b"body", {"a": "1 B"})
    assert rows["broken"]["payload"] == b"" and rows["broken"]["http_status"] is None
    assert warc.read_warc(spark, f"file:{path}", ["target_uri", "record_type"]).where("target_uri is null").count() == 1
    path.write_bytes(data[:-30] if form == "plain" else b"WARC/1.1\r\nX: y\r\n\r\n")
    with pytest.raises(Exception, match="ends within|content length"):
        warc.read_warc(spark, str(path)).collect()


def test_files_are_planned_by_size_and_only_committed_ones_count(spark, odd_pages, tmp_path):
    folder = archived(spark, odd_pages.repartition(6), str(tmp_path / "w"), max_file_bytes=1000)
    files = warc.committed_files(folder)
    (tmp_path / "w" / "part-999999-failed-0000.warc.gz").write_bytes(b"half a recor")
    assert warc.committed_files(folder) == files
    assert [s for _, s in warc.committed_files(f"file://{folder}")] == [s for _, s in files]
    reader = warc.WarcReader({"path": folder, "split_bytes": str(max(s for _, s in files))}, ["record_type"])
    runs = [p.value for p in reader.partitions()]
    assert [f for run in runs for f in run] == [f for f, _ in files] and 1 < len(runs) <= len(files)
    before = warc.read_warc(spark, folder, ["record_id"]).count()
    archived(spark, odd_pages.limit(3), folder)
    assert warc.read_warc(spark, folder, ["record_id"]).where("record_id like '<urn:row%'").count() == before - len(files) + 3
    odd_pages.limit(0).transform(lambda f: warc.page_rows(f, "page_id", "url", "html", date="x")).write.format("warc").mode("overwrite").save(folder)
    assert warc.read_warc(spark, folder, ["record_id"]).count() == 0
    assert all(json.loads((tmp_path / "w" / n).read_text()) == [] for n in os.listdir(folder) if n.startswith("_commit"))
    with pytest.raises(ValueError, match="no columns"):
        warc.read_warc(spark, folder, ["nonsense"])


# --- runs ---


def runs_by_hand(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1) if words[i] == words[i + q] else i + 1
    return sorted((i, length, q) for (i, length), q in found.items())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 80), st.sampled_from([1, 2, 3, 20]), st.sampled_from([2, 5, 12, 13]))
def test_runs_against_loops(seed, n, letters, least):
    rng = random.Random(seed)
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(a, min(n, a + rng.randrange(40))):
                words[i] = words[a + (i - a) % p]
    expected = sorted(runs_by_hand(words, least), key=lambda r: (r[0], r[2]))
    assert [tuple(r) for r in periodic_runs.runs_of_words(words, least).tolist()] == expected


def test_extensions_against_loops():
    rng = random.Random(4)
    text = [rng.randrange(1, 4) for _ in range(200)]
    ext = periodic_runs.Extensions(*periodic_runs.SuffixTree(text).tour())
    pairs = [(i, j) for i in range(0, 200, 7) for j in range(0, 201, 3) if i != j]

    def agree(i, j):
        k = 0
        while max(i, j) + k < 200 and text[i + k] == text[j + k]:
            k += 1
        return k
    import numpy as np
    got = ext.of(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got.tolist() == [agree(*p) for p in pairs]


def test_runs_of_odd_and_long_texts(spark, odd_docs, no_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and periodic_runs.find_runs(no_docs).count() == 0
    for r in odd_docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        mine = next(x for x in rows if x["doc_id"] == r["doc_id"] and (len(words) > 2000 or [tuple(y) for y in x["runs"]] == runs_by_hand(words, 12)))
        assert mine
    long_rows = [x for x in rows if x["doc_id"] in (8, 9)]
    assert [[tuple(y) for y in x["runs"]] for x in long_rows] == [[(0, 120_000, 977 * 13)]] * 2
    assert all(len(x["collapsed"].split()) == 977 * 13 for x in long_rows)


# --- spelling ---


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(counts):
    out = {}
    for w, n in counts.items():
        others = sorted(((-m, v.encode(), v) for v, m in counts.items() if near(w, v)))
        best = others[0][2] if others and counts[others[0][2]] >= 2 * n else None
        out[w] = (best, n, len(others), counts[best] if best else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


@pytest.mark.parametrize("shard_words", [2048, 12, 2])
def test_variants_against_all_pairs(spark, shard_words):
    rng = random.Random(shard_words)
    counts = {}
    for _ in range(500):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
        counts[w] = rng.choice([1, 2, 3, 4, 8, 9, 20, 400])
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling_variants.group_variants(frame, shard_words=shard_words).select("word", "form", "root", "n", "n_near", "form_n")
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(counts) and set(rows) == variants_by_hand(counts)


def test_many_words_that_begin_alike(spark):
    """A shard for the common beginning would hold all of them; split by thirds and halves none does."""
    words = [f"gemeinsamer{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    frame = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long")
    found = spelling_variants.near_words(frame, shard_words=64)
    assert {r["n_near"] for r in found.collect()} == {21} and found.count() == 512


def test_words_of_odd_docs(spark, odd_docs, no_docs):
    expected = defaultdict(int)
    import re
    lower = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    for r in odd_docs.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            expected[run] += 1
    counted = spelling_variants.counted_words(queries.spelled_words(odd_docs), least_length=5, least_count=3)
    assert {r["word"]: r["n"] for r in counted.collect()} == {w: n for w, n in expected.items() if len(w) >= 5 and n >= 3}
    grouped = spelling_variants.group_variants(counted).collect()
    assert len(grouped) == counted.count()
    assert spelling_variants.group_variants(spelling_variants.counted_words(queries.spelled_words(no_docs), least_length=5, least_count=3)).count() == 0
    with pytest.raises(ValueError, match="least_ratio"):
        spelling_variants.group_variants(counted, least_ratio=1)


def test_roots_follow_chains(spark):
    chain = [("aaaaa", 1), ("aaaab", 2), ("aaabb", 4), ("aabbb", 8), ("abbbb", 16), ("bbbbb", 32), ("zzzzz", 5)]
    frame = spark.createDataFrame(chain, "word string, n long")
    roots = {r["word"]: r["root"] for r in spelling_variants.group_variants(frame).collect()}
    assert set(roots.values()) == {"bbbbb", "zzzzz"} and roots["zzzzz"] == "zzzzz"


def test_source_reads_bytes_io_like_files():
    reader = warc._Stream(io.BufferedReader(io.BytesIO(record("response", "u", b"abc") + b"\r\n" + record("response", "v", b""))))
    assert [reader.next()["warc-target-uri"] for _ in range(2)] == ["u", "v"] and reader.next() is None
