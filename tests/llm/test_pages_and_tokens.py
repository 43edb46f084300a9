"""WARC, URL filters, BPE and packing."""

import gzip
import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framelark.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip
from framelark.llm.packing import Capacity, pack_documents, vector_best_fit
from framelark.llm.queries import URL_RULES, vocabulary_path
from framelark.llm.url_filter import url_filter
from framelark.llm.warc import Gap, Record, read_warc, record_bytes, salvage, write_warc
from tests.llm.helpers import collected, document_frame, odd_documents

PAGES = "page_id bigint, url string, html string, path string, rule string, digest string, _row string"


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "r", "d", "w") for r in rows], PAGES)


def archive(n=20, plain=False):
    parts = []
    for i in range(n):
        payload = (f"page {i} " * 50).encode()
        import hashlib

        raw = record_bytes(i, f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), None, False, "1970-01-01T00:00:00Z")
        parts.append(raw if plain else gzip.compress(raw))
    return parts


def scan(data: bytes):
    found = list(salvage(pa.PythonFile(io.BytesIO(data), mode="r")))
    ids = [r.headers["warc-record-id"] for r in found if isinstance(r, Record)]
    return [int(x.strip("<>").rpartition(":")[2]) for x in ids], [g for g in found if isinstance(g, Gap)]


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    parts = archive(plain=plain)
    assert scan(b"".join(parts)) == (list(range(20)), [])
    damaged = list(parts)
    middle = len(damaged[4]) // 2
    damaged[4] = damaged[4][:middle] + bytes([damaged[4][middle] ^ 0x55]) + damaged[4][middle + 1 :]
    damaged[9] = damaged[9][: len(damaged[9]) - 7]
    damaged.insert(15, b"\x00junk WARC/ \x1f\x8b\x08 junk")
    damaged[-1] = damaged[-1][:-10]
    ids, gaps = scan(b"".join(damaged))
    assert set(ids) >= set(range(19)) - {4, 9, 10} and 4 not in ids and 9 not in ids and 19 not in ids
    # Gaps and records tile the file.
    data = b"".join(damaged)
    spans = sorted((r.offset, r.end) for r in salvage(pa.PythonFile(io.BytesIO(data), mode="r")))
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(gaps) >= 4 and all(g.reason for g in gaps)
    assert scan(b"") == ([], []) and scan(b"no archive at all")[0] == []


def foreign(i: int, digest: str, payload: bytes = b"hello world") -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: {digest}\r\n"
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def test_salvage_inside_members(spark, tmp_path):
    parts = archive(9, plain=True)
    whole = gzip.compress(b"".join(parts[:5])) + gzip.compress(parts[5])
    assert scan(whole) == (list(range(6)), [])
    hurt = bytearray(b"".join(parts[:5]))
    hurt[len(parts[0]) + 400] ^= 1  # the block of record 1
    broken = parts[2].replace(b"Content-Length: ", b"Content-Length: x", 1)
    mixed = gzip.compress(bytes(hurt)) + gzip.compress(parts[6] + broken + b"junk" + parts[7]) + parts[8]
    ids, gaps = scan(mixed)
    assert ids == [0, 2, 3, 4, 6, 7, 8] and len(gaps) == 2 and all(g.inner for g in gaps)
    assert scan(gzip.compress(b"no record at all")) == ([], [Gap(0, 36, "no version line")])
    (tmp_path / "a.warc.gz").write_bytes(mixed)
    got = read_warc(spark.createDataFrame([(str(tmp_path / "a.warc.gz"), 1), (None, 2)], "path string, offset int"))
    rows = {r.page_id: r for r in got.filter("gap_reason IS NULL").collect()}
    assert sorted(rows) == ids and rows[8].inner_offset is None and rows[0].inner_end == len(parts[0])
    assert rows[7].inner_offset == len(parts[6]) + len(broken) + 4 and rows[7].offset == rows[6].offset


def test_foreign_digests():
    import base64
    import hashlib

    body = b"hello world"
    sha1, md5 = hashlib.sha1(body).digest(), hashlib.md5(body).digest()
    good = ["sha1:" + base64.b32encode(sha1).decode(), "sha1:" + sha1.hex().upper(), "md5:" + md5.hex(), "sha-256:" + hashlib.sha256(body).hexdigest(), "md5:" + base64.b32encode(md5).decode().rstrip("=")]
    data = b"".join(foreign(i, d) for i, d in enumerate(good))
    assert scan(data) == (list(range(5)), [])
    for i in range(5):
        at = data.index(b"hello", i * (len(data) // 5))
        ids, gaps = scan(data[:at] + b"j" + data[at + 1 :])
        assert len(ids) == 4 and [g.reason for g in gaps] == ["warc-block-digest differs"]
    assert scan(foreign(1, "sha1:?")) [0] == [] and scan(foreign(1, "sha1:"))[0] == []
    (odd,) = salvage(pa.PythonFile(io.BytesIO(foreign(1, "blake3:00")), mode="r"))
    assert odd.unchecked == "warc-block-digest: blake3"


def test_salvage_every_flipped_byte():
    parts = archive(5)
    data = b"".join(parts)
    rnd = random.Random(1)
    for _ in range(150):
        at = rnd.randrange(len(data))
        ids, gaps = scan(data[:at] + bytes([data[at] ^ (1 << rnd.randrange(8))]) + data[at + 1 :])
        assert len(ids) >= 4 and set(ids) <= set(range(5))


def test_warc_round_trip(spark):
    big = "long page " * 30000
    rows = [
        (5, "http://x/", "a" * 200), (3, None, "a" * 200), (9, "http://é/\r\nX: y", "a" * 200), (1, "u", "short"), (2, "u", "short"),
        (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", "a" * 200), (None, None, "z" * 300),
        (10, "u", big), (11, "u", "WARC/1.1\r\n\r\n" * 20), (1, "u", "short"),
    ]
    files = write_warc(page_frame(spark, rows).repartition(3), file_bytes=2000)
    got = read_warc(files)
    assert got.filter("gap_reason IS NOT NULL").count() == 0
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    assert by[3][0].record_type == "response" and by[3][0].refers_to is None
    for i in (5, 9):
        assert by[i][0].record_type == "revisit" and by[i][0].refers_to == 3 and by[i][0].payload_bytes == 200
        assert by[i][0].payload_digest == by[3][0].payload_digest
    assert {r.record_type for r in by[1] + by[2] + by[4] + by[6] + by[7]} == {"response"} and by[8][0].refers_to == 7
    assert sorted(r.record_type for r in by[None]) == ["response", "revisit"]
    assert by[10][0].payload == big.encode() and by[4][0].payload == b""
    assert read_warc(write_warc(page_frame(spark, []))).count() == 0


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://Example.COM/en/1?x#y", "http://a.b.example.com/en/", "http://www.example.com/en/x",
        "http://www.example.com/EN/x", "http://example.com", "http://example.com?a/b", "http://x.net/es/1", "http://net/fr/", "http://net/fr",
        "http://notexample.com/en/", "http://com/", "a://b://c.net/es/", "http://exam\nple.com/en/", "http://x..com/en/", "://com/x",
        "http://" + "a." * 200 + "example.com/en/" + "p/" * 500, "http://ÉX.com/en/",
    ]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(4, urls[4], None), (None, urls[10], None)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = collected(url_filter(page_frame(spark, rows), rules))
    assert got == sorted(((i, *brute_rule(u)) for i, u, _ in rows), key=repr)
    assert url_filter(page_frame(spark, []), rules).count() == 0
    odd = [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "", "allow"), ("net", "/e", None)]
    more = spark.createDataFrame(odd, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(page_frame(spark, rows[:12]), more).collect()}
    assert got[4] == ("com", "block") and got[10] == (None, "allow") and got[0] == (None, "allow")
    assert {r.verdict for r in url_filter(page_frame(spark, rows), rules.limit(0)).collect()} == {"allow"}


def test_bpe_equals_the_library(spark):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    rnd = random.Random(6)
    rows = odd_documents()
    rows += [(600 + i, "".join(rnd.choice("ab '\n\tsrevlmdt1é.!  日") for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    df = document_frame(spark, rows)
    encoded = bpe_encode(df, vocabulary_path())
    got = {}
    for r in encoded.collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    for i, t in rows:
        assert tokenizer.encode(t or "", add_special_tokens=False).ids in got[i]
    back = {(r.doc_id, r.text) for r in bpe_decode(encoded, vocabulary_path()).collect()}
    assert back == {(i, t or "") for i, t in rows}
    digests = bpe_round_trip(df, vocabulary_path()).collect()
    assert len(digests) == len(rows)
    assert bpe_round_trip(document_frame(spark, []), vocabulary_path()).count() == 0
    broken = spark.createDataFrame([(1, [0, 1]), (2, None), (3, []), (4, [164])], "doc_id bigint, ids array<int>")
    want = {1: '!"', 2: None, 3: "", 4: tokenizer.decode([164], skip_special_tokens=False)}
    assert {r.doc_id: r.text for r in bpe_decode(broken, vocabulary_path()).collect()} == want


def test_packing(spark):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    rows = [(k, t) for k, (_, t) in enumerate(odd_documents())] + [(None, "null id")]
    got = pack_documents(document_frame(spark, rows), vocabulary_path(), with_ids=True).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            part = ids[at : at + r.length]
            assert part == r.ids and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
            at += r.length
        assert at == len(ids) and len(by[i]) == -(-len(ids) // 1024)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert pack_documents(document_frame(spark, []), vocabulary_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(1, 400, 3000)
    cap = Capacity(tokens=1000, documents=6, attention=250_000, rule=rule)
    which, offset = vector_best_fit(lengths, cap)
    for b in np.unique(which):
        mine = np.flatnonzero(which == b)
        assert lengths[mine].sum() <= 1000 and len(mine) <= 6 and (lengths[mine] ** 2).sum() <= 250_000
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.r_[0, np.cumsum(lengths[order])[:-1]]).all()
    if rule == "norm":
        plain = vector_best_fit(lengths, Capacity(tokens=1000))[0]
        assert len(np.unique(plain)) <= np.ceil(lengths.sum() / 1000) * 1.01 + 1
