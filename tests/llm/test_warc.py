import gzip

import pytest
from pyspark.sql import functions as F

from panelstat.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    long = "é" * 60
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 20) for i in range(20)]
    rows += [(30, None, None), (31, "u v\nw", ""), (32, "http://ü", "short"), (33, "x", "short"), (40, "x", long), (39, "y", long), (41, "y", long), (39, "z", long), (None, "n", long)]
    rows += [(50, "big", "x\r\n\r\nWARC/1.1\r\n" * 60_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def want(rows):
    import hashlib

    out, first = [], {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            first[b] = min(first.get(b, 1 << 60), r.page_id)
    for r in rows:
        b = (r.html or "").encode()
        again = b in first and r.page_id is not None and r.page_id > first[b]
        out.append((r.page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == want(pages.collect())


def test_clashing_and_empty(pages):
    more = pages.withColumns({"payload": F.lit(1), "digest": F.lit("x"), "first_id": F.lit(0)})
    assert sorted(map(tuple, warc.round_trip(more).collect()), key=str) == want(pages.collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compress", ["true", "false"])
def test_predicates_files_and_payloads(spark, pages, tmp_path, compress):
    path = str(tmp_path / "a")
    warc.write_warc(warc.page_records(pages), path, max_file_bytes="2000", compress=compress)
    assert all(x.name.endswith(".warc.gz" if compress == "true" else ".warc") for x in (tmp_path / "a").iterdir() if x.name[0] != ".")
    df = warc.read_warc(spark, path)
    assert df.count() == pages.count()
    found = df.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a/1")).select("target_uri", F.decode("payload", "UTF-8").alias("html"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan warc" in plan
    assert {r[0]: r[1] for r in found.collect()} == {f"http://a/{i}": f"<p>{i}</p>" * 20 for i in [1, *range(10, 20)]}
    assert warc.read_warc(spark, path, headers={"WARC-Target-URI": "u%20v%0Aw"}).select("record_id").collect()[0][0] == "<urn:page:31>"
    bare = warc.read_warc(spark, path, ["response"], payload=False)
    assert bare.filter("payload is not null").count() == 0 and bare.filter("record_id = '<urn:page:50>'").first()["payload_length"] == 15 * 60_000


def test_gzip_and_broken(spark, tmp_path):
    rec = [warc.record({"record_id": f"<urn:page:{i}>", "record_type": "response" if i % 2 else "resource", "payload": b"x" * i}) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rec))
    (tmp_path / "_half.warc").write_bytes(b"not to be read")
    assert sorted((r[0], r[1]) for r in warc.read_warc(spark, str(tmp_path)).select("payload_length", "record_type").collect()) == [(i, "response" if i % 2 else "resource") for i in range(5)]
    (tmp_path / "b.warc").write_bytes(rec[3][:-6])
    with pytest.raises(Exception, match="truncated"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_members_are_gzip_and_skipped(tmp_path):
    import io
    import os

    noise = [os.urandom(100_000).hex().encode() for _ in range(4)]
    rec = [warc.record({"record_id": f"<urn:page:{i}>", "record_type": "response", "payload": n, "headers": {"X-Long": "y" * 20_000 if i == 2 else "n"}}) for i, n in enumerate(noise)]
    raw = b"".join(map(warc.member, rec))
    assert gzip.decompress(raw) == b"".join(rec)

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            out = super().read(n)
            self.seen += len(out)
            return out

    f = Counted(raw)
    got = list(warc._gzip_records(f, lambda h: h["warc-record-id"] == "<urn:page:3>", True))
    assert [g[2] for g in got] == [noise[3]] and f.seen < len(raw) * 0.8
    assert [g[1] for g in warc._gzip_records(io.BytesIO(raw), lambda h: True, False)] == [len(n) for n in noise]
