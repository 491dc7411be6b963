import hashlib
import tracemalloc
from collections import Counter
from pathlib import Path

import pytest

from chatterloom.llm import warc
from chatterloom.session import shared_folder

FAKE = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
)
LONG = "x" * 150
PAGES = [
    (5, "http://a/é", LONG), (2, "u", LONG), (9, "u", LONG), (1, None, None), (3, "u\r\nWARC-Type: evil", ""), (4, "u", "short"),
    (6, "u", "short"), (7, "u", FAKE * 40), (8, "u", "<p>" + FAKE + "ü" * 9000), (10, "u", FAKE), (11, "u", "WARC/1.1\r\n" * 30),
    (12, "u", FAKE[:-4]), (9, "u", "another text for the same id " * 9), (2, "u", LONG), (13, "u", "z" * 70_000),
]


def wanted():
    first = {}
    for key, _, html in PAGES:
        if len((html or "").encode()) >= 100:
            first[html] = min(key, first.get(html, key))
    out = Counter()
    for key, _, html in PAGES:
        html = html or ""
        again = first.get(html, key) < key
        digest = hashlib.sha256(html.encode()).hexdigest()
        out[(key, len(html.encode()), digest, "revisit" if again else "response", first[html] if again else None)] += 1
    return out


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 22])
@pytest.mark.parametrize("few", [0, 100])
def test_round_trip(spark, range_bytes, few):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    folder = shared_folder(spark, "warc")
    warc.write_archive(pages, folder, file_records=4, broadcast_rows=few)
    records = warc.read_archive(spark, folder, range_bytes=range_bytes)
    assert records.count() == len(PAGES)
    assert Counter(tuple(r) for r in warc.resolved(records).collect()) == wanted()


def test_empty_archive(spark):
    folder = shared_folder(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.resolved(warc.read_archive(spark, folder)).count() == 0


def test_candidates_follow_chains_inside_a_range():
    one = FAKE.encode()
    data = one * 3 + FAKE.replace("Content-Length: 3", f"Content-Length: {len(one)}").replace("abc", FAKE).encode()
    found = {x["offset"]: x for x in warc.candidates_in(data, 0, len(data))}
    n = len(one)
    assert {0, n, 2 * n, 3 * n} <= set(found)
    assert all(found[k]["exit"] == len(data) for k in (0, n, 2 * n, 3 * n))
    on_chain = [k for k, x in found.items() if x["pre"] <= found[0]["pre"] < x["post"]]
    assert sorted(on_chain) == [0, n, 2 * n, 3 * n]


def test_damaged_tail_keeps_what_is_before():
    one = FAKE.encode()
    found = warc.candidates_in(one * 2 + one[:-6], 0, 3 * len(one))
    assert [x["offset"] for x in found] == [0, len(one)] and found[1]["exit"] == -1


@pytest.mark.parametrize("range_bytes", [1000, 1 << 22])
def test_long_urls_do_not_end_the_chain(spark, range_bytes):
    rows = [(k, "u" * (100_000 if k == 5 else 9) + ("WARC/1.1" if k == 6 else ""), LONG if k > 5 else f"page {k}") for k in range(12)]
    folder = shared_folder(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    records = warc.read_archive(spark, folder, range_bytes=range_bytes)
    assert {r.page_id: r.uri for r in records.collect()} == {k: url for k, url, _ in rows}
    back = {r.page_id: r.payload_bytes for r in warc.resolved(records).collect()}
    assert back == {k: len(html) for k, _, html in rows}


def test_lost_records_fail(spark):
    one = FAKE.replace("page:99", "page:1").encode()
    again = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:2>\r\nWARC-Refers-To: <urn:page:7>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    folder = Path(shared_folder(spark, "warc"))
    folder.mkdir(parents=True)
    (folder / "part-0").write_bytes(one + again + one[:-6])
    (folder / "part-1").write_bytes(b"")
    with pytest.raises(ValueError, match="part-0 do not reach its end"):
        warc.read_archive(spark, str(folder))
    records = warc.read_archive(spark, str(folder), strict=False)
    assert sorted(r.page_id for r in records.collect()) == [1, 2]
    with pytest.raises(Exception, match="no response for the revisit of page 2"):
        warc.resolved(records).collect()
    assert {(r.page_id, r.payload_bytes) for r in warc.resolved(records, strict=False).collect()} == {(1, 3), (2, None)}


def test_files_are_bounded_by_bytes(spark):
    rows = [(k, "u", f"{k} " + "x" * (40_000 if k % 3 == 0 else 9_000 if k % 3 == 1 else 50)) for k in range(60)]
    folder = shared_folder(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, folder, file_records=64, file_bytes=1 << 17)
    assert max(p.stat().st_size for p in Path(folder).glob("part-*")) <= 1 << 17
    back = warc.resolved(warc.read_archive(spark, folder)).collect()
    assert {r.page_id: r.payload_bytes for r in back} == {k: len(html) for k, _, html in rows} and len(back) == 60


def test_a_file_is_scanned_where_it_lies():
    data = FAKE.encode() * 3 + FAKE.replace("Content-Length: 3", "Content-Length: 20000").replace("abc", "z" * 20_000).encode()
    want = warc.candidates_in(data, 0, len(data))
    assert len(want) == 4 and warc.candidates_in(memoryview(data), 0, len(data)) == want
    whole = memoryview(data * 500)
    tracemalloc.start()
    found = warc.candidates_in(whole, 0, 1 << 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 150 and most < 1_000_000 < len(whole) // 9
