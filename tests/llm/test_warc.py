import gzip
import hashlib
import io
import random

import pytest

from deltaframe.llm import warc


def member(i, payload):
    return warc.encode_record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest())


def archive(seed, n):
    rng = random.Random(seed)
    payloads = [rng.choice([b"", b"a" * 300, rng.randbytes(rng.randrange(3000)), warc.MAGIC * 40, b"\r\n\r\n", b"WARC/1.1\r\n\r\n"]) for _ in range(n)]
    # a payload that doesn't compress and holds archives itself: members inside members
    payloads += [member(1, b"inner") + rng.randbytes(500), member(1, b"in") * 3 + b"tail", b"z" * 200_000 + rng.randbytes(90_000)]
    return payloads, b"".join(member(i, p) for i, p in enumerate(payloads))


@pytest.mark.parametrize("step", [1, 37, 500, 4096, 10**7])
def test_every_record_has_one_owner(step):
    payloads, data = archive(step, 12 if step == 1 else 60)
    if step == 1:
        data, payloads = data[:3000], None
    f = io.BytesIO(data)
    found = [x for a in range(0, len(data), step) for x in warc.read_range(f, a, min(len(data), a + step))]
    got = [(place, fields["row-key"], block) for place, fields, block in found if fields]  # the last member of the first archive is cut
    if payloads is None:
        whole = [(p, x["row-key"], b) for p, x, b in warc.read_range(f, 0, len(data)) if x]
        assert got == whole
        return
    assert [int(k) for _, k, _ in got] == list(range(len(payloads)))
    assert [b.partition(b"\r\n\r\n")[2] for _, _, b in got] == payloads


def test_members_are_plain_gzip():
    head, _, rest = gzip.decompress(member(5, b"<p>")).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert rest.endswith(b"\r\n\r\n<p>\r\n\r\n")


def test_round_trip_with_small_ranges(spark):
    big = "é<p>\x00" * 50_000
    rows = [(1, "u\r\nX: y", "x" * 100, 1), (2, None, "x" * 100, 1), (2, None, "x" * 100, 1), (3, "", "x" * 99, 1), (4, "a b%20", "x" * 99, 1), (5, "é", None, 1), (6, "v", "", 1), (9, "w", big, 1), (8, "w", big, 1), (None, "n", big, 1), (None, "n", "only here " * 20, 1), (0, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    for size in (64, 1000, 1 << 20):
        got = sorted(map(tuple, warc.round_trip(spark, pages, size).collect()), key=str)
        first = {}
        for k, _, h, _ in rows:
            if h and len(h.encode()) >= 100 and k is not None:
                first[h] = min(k, first.get(h, k))
        want = []
        for k, _, h, _ in rows:
            body = (h or "").encode()
            again = h in first and first[h] != k
            want.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None))
        assert got == sorted(want, key=str)
    archives = warc.write(warc.plan_records(pages, "page_id", "url", "html"), warc.scratch_path(spark, "warc"), archive_bytes=500)
    records = warc.read(archives, 300).collect()
    assert sorted((str(r.target), bytes(r.payload)) for r in records if r.record_type == "response") == sorted((str(u), (h or "").encode()) for k, u, h, _ in rows if not (h in first and first[h] != k))


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_page_with_a_very_long_url(spark):
    from deltaframe.llm import warc

    pages = spark.createDataFrame([(1, "http://a/", "one"), (2, "http://b/" + "漢" * 40_000, "two"), (3, "http://c/", "three")], "page_id long, url string, html string")
    assert {r.page_id for r in warc.round_trip(spark, pages).collect()} == {1, 2, 3}


def keys(data):
    return [None if fields is None else int(fields["row-key"]) for _, fields, _ in warc.read_range(io.BytesIO(data), 0, len(data))]


def test_damage_costs_no_other_record():
    one, two, three = (member(i, bytes([65 + i]) * 5000 + random.Random(i).randbytes(400)) for i in (1, 2, 3))
    for at in (3, 12, len(two) // 2, len(two) - 3):
        bad = bytearray(two)
        bad[at] ^= 0x55
        assert [k for k in keys(one + bytes(bad) + three) if k] == [1, 3], at
    assert keys(one + two[:-9] + three) == [1, None, 3]
    assert keys(one + two + bytes(16)) == [1, 2]
    assert keys(one + two + three[:-1]) == [1, 2, None]


def test_several_records_in_a_member():
    both = gzip.compress(gzip.decompress(member(4, b"four")) + gzip.decompress(member(5, b"five")))
    assert keys(member(3, b"x") + both + member(6, b"y")) == [3, 4, 5, 6]


def test_revisits_name_their_response():
    digest = hashlib.sha256(b"same").hexdigest()
    head = gzip.decompress(warc.encode_record(9, "http://x/9", b"same", digest, 2, True))
    assert gzip.decompress(warc.encode_record(2, "http://x/2", b"same", digest)).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] == head.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0]


def test_damaged_archives_have_a_row(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(member(1, b"one") + member(2, b"two" * 400)[:-20])
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    assert sorted((r.damaged, r.key, r.record_type) for r in warc.read(archives).collect()) == [(False, 1, "response"), (True, None, None)]
