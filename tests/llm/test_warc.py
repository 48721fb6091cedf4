import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from seaweft.llm import warc


def test_records_survive_any_cut():
    payloads = [b"", b"x", b"a\r\n\r\nb" * 50, "é\r\nWARC/1.1".encode() * 30]
    whole = b"".join(warc.page_record(i, f"http://x/{i}\r\n é", p, hashlib.sha256(p).hexdigest(), 7 if i == 1 else None) for i, p in enumerate(payloads))
    for step in (1, 3, 1000):
        got = list(warc.read_records(iter([whole[i : i + step] for i in range(0, len(whole), step)])))
        assert [warc.payload_of(b) for _, b, _ in got] == [b"" if i == 1 else p for i, p in enumerate(payloads)]
        assert b"".join(w for *_, w in got) == whole
    with pytest.raises(ValueError):
        list(warc.read_records(iter([whole[:-9]])))


@pytest.mark.parametrize("cuts", [(), (100,), (3, 2000)])
def test_normaliser_gives_members_at_their_offsets(tmp_path, cuts):
    records = [warc.page_record(i, None, b"p" * i * 37, "d", None) for i in range(60)]
    whole = b"".join(records)
    edge = [0, *cuts, len(whole)]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(whole[a:b]) for a, b in zip(edge, edge[1:])))  # several members are one stream, too
    system = fs.LocalFileSystem()
    assert warc.normalise_file(system, str(tmp_path / "m.warc.gz"), str(tmp_path / "n")) == 60
    data = (tmp_path / "n.warc.gz").read_bytes()
    entries = list(warc.indexed(system, str(tmp_path / "n")))
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries] == records
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == whole


def expect(rows):
    first = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest if r.payload is None else hashlib.sha256(r.payload).hexdigest(), r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rotate", [warc.ROTATE, 300])
def test_round_trip(spark, rotate):
    long, short = "é" * 50, "x" * 99
    rows = [(5, long), (3, long), (9, long), (4, short), (6, short), (1, None), (2, ""), (7, "y" * 100), (8, "z" * 300_000), (3, long)]
    df = spark.createDataFrame([(i, f"http://a/{i}", h, "x") for i, h in rows], "page_id bigint, url string, html string, payload string")
    assert got(warc.archive(df, rotate=rotate)) == expect(rows)
    assert got(warc.archive(df.limit(0))) == []
    odd = spark.createDataFrame([(None, None, "n" * 200), (1, "u\nv", "n" * 200)], "page_id bigint, url string, html string")
    assert sorted((r.page_id is None, r.url, r.record_type) for r in warc.archive(odd).collect()) == [(False, "u%0Av", "response"), (True, None, "response")]


def test_query_on_all_pages(spark, sf_dir):
    from seaweft.llm.queries import op4_warc
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op4_warc(spark, sf_dir).collect()), key=repr) == expect(rows)
