"""Mixing, sharding and archives against plain Python."""

import gzip
import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import odd_rows

from lanewise.llm.mixing import mix, mixed_documents, source_targets
from lanewise.llm.sharding import permute, restore, shard, shard_rows, sharded_documents
from lanewise.llm.warc import archived_pages, member, record, records, write_archives

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Pour, cap, reshare the excess by weight, until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not above:
            return {s: float(epochs * sizes[s]) if s in full else share[s] for s in names}
        full |= above


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"x": 5}, {"a": 0, "b": 7}, {f"s{i:02d}": (i * 37) % 91 + 1 for i in range(40)}, {"z": 1, "É": 900, "a": 2, "b": 1, "c": 50}],
)
def test_targets(sizes, spark):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def check_mix(df):
    rows = mix(df).collect()
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    targets = slow_targets(sizes) if docs else {}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    return sorted((str(r.doc_id), r["size"], r.source or "", r.copies) for r in rows)


def test_mix_of_the_corpus_and_reruns(corpus):
    assert check_mix(corpus) == check_mix(corpus.repartition(7))


def test_mix_of_odd_rows(frame):
    rows = [(d, t, [None, "b", "c"][i % 3]) for i, (d, t) in enumerate(odd_rows())]
    check_mix(frame(rows))
    check_mix(frame([]))
    check_mix(frame([(i, "", "a") for i in range(3)]))
    check_mix(frame([(1, "w " * 10, "hot")] * 50 + [(i, "v " * (i % 7), f"s{i % 5}") for i in range(60)]))


def test_mixed_documents_repeat_rows(corpus, spark):
    copies = defaultdict(int)
    for r in mix(corpus).collect():
        copies[r.doc_id] += r.copies
    got = defaultdict(int)
    out = mixed_documents(corpus)
    assert out.columns == corpus.columns
    assert mixed_documents(spark.createDataFrame(corpus.toPandas())).count() == out.count()
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 17, 256, 1000, 4097])
def test_permutation(rows):
    numbers = np.arange(rows)
    places = permute(numbers, rows)
    assert sorted(places.tolist()) == numbers.tolist()
    assert restore(places, rows).tolist() == numbers.tolist()
    if rows > 200:
        assert (np.diff(places) == 1).mean() < 0.05


@pytest.mark.parametrize("kind", ["odd", "corpus", "empty"])
def test_shards(kind, frame, corpus):
    df = corpus if kind == "corpus" else frame(odd_rows() if kind == "odd" else [])
    docs = [(r.doc_id, r.text or "") for r in df.collect()]
    got = shard(df).collect()
    facts = [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(facts, key=str)
    assert sorted(r.number for r in got) == list(range(len(docs)))
    ranked = sorted(facts, key=lambda x: (x[0] is None, x[0] or 0, x[2], x[1]))
    assert [(r.doc_id, r["size"], r.text_crc32) for r in sorted(got, key=lambda r: r.number)] == ranked
    slots = defaultdict(list)
    for r in got:
        place = int(permute(np.array([r.number]), len(docs))[0])
        assert (r.shard, r.slot) == (place % 16, place // 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if docs:
        counts = [len(slots[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1
    assert shard_rows(df).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_sharded_documents_keep_columns(frame):
    df = frame(odd_rows()[3:]).withColumnRenamed("lang", "slot")
    out = sharded_documents(df)
    assert out.columns == [c for c in df.columns if c != "slot"] + ["shard", "slot"]
    assert out.count() == df.count()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS name", "'y' AS digest", "'z' AS line")


def odd_pages():
    big = "<p>" + "é" * 200 + "</p>"
    return [
        (5, "http://a/1", big),
        (2, "http://a/2", big),
        (2, "http://a/2", big),
        (None, None, big),
        (7, "http://a/\r\nX: y é", "<p>short</p>"),
        (8, None, "<p>short</p>"),
        (9, "http://a/9", None),
        (10, "http://a/10", ""),
        (11, "http://a/11", "\r\n\r\nWARC/1.1\r\n" + "x" * 99),
        (12, "http://a/12", "y" * 100),
        (13, "http://a/13", "y" * 100),
        (14, "http://a/14", "z" * 99),
        (15, "http://a/15", "z" * 99),
        (16, "http://a/16", "long " * 200_000),
    ]


def expected_pages(rows):
    first, out = {}, []
    for k, (page, _, html) in enumerate(rows):
        key = (page is None, page or 0, k)
        if html is not None and len(html.encode()) >= 100:
            first[html] = min(first.get(html, key), key)
    for k, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        own = first.get(html, None)
        revisit = own is not None and own[2] != k
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", own[1] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_archives(kind, spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet") if kind == "table" else pages_of(spark, odd_pages() if kind == "odd" else [])
    got = archived_pages(df).collect()
    want = expected_pages([(r.page_id, r.url, r.html) for r in df.collect()])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want


def test_archives_are_plain_gzip_members(spark, tmp_path):
    folder = str(tmp_path / "archives")
    write_archives(pages_of(spark, odd_pages()), folder)
    parts = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).glob("*.txt") if p.stat().st_size)
    assert parts.count(b"WARC/1.1\r\nWARC-Type: ") == len(odd_pages())


def test_reader_sees_faults_and_survives_piece_borders():
    whole = [record(f"http://a/{i}", f"urn:page:{i}", bytes([97 + i % 3]) * (i * 5_000), None) for i in range(30)]
    archive = b"".join(map(member, whole)) + member(b"")
    assert [len(r.payload) for r in records(archive)] == [i * 5_000 for i in range(30)]
    assert not any(r.faults for r in records(archive))
    broken = member(whole[1].replace(b"bbbb", b"bbxb", 1))
    assert next(records(broken)).faults == ["block digest", "payload digest"]
    assert next(records(member(whole[1][:-2]))).faults == ["frame"]
    with pytest.raises(EOFError):
        list(records(archive[:-30]))
    with pytest.raises(zlib.error):
        list(records(archive + b"no gzip"))
