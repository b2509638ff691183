import numpy as np
from pyspark.sql import functions as F

from presswork.llm import url_filter as uf

URLS = ["http://A.b.example.com/x/?q=1#f", "https://b.example.com", "https://user@c.example.org:8080/p/q/", "//d.example/", "nohost", "", None, "http://single/x", "https://b.example.com", "http://Z.example.com/" + "a" * 50000]
LIST = ["b.example.com", "HTTP://c.example.org/p/q", "a.b.example.com/x", "", None, "single", "single", "z.example.com/" + "a" * 50000]


def frames(spark, urls=URLS, entries=LIST):
    return spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, keys string"), spark.createDataFrame([(e,) for e in entries], "entry string")


WANT = {0: "a.b.example.com/x", 1: "b.example.com", 2: "c.example.org/p/q", 3: None, 4: None, 5: None, 6: None, 7: "single", 8: "b.example.com", 9: "z.example.com/" + "a" * 50000}


def test_blocks(spark):
    got = uf.blocked(*frames(spark)).collect()
    assert {r["page_id"]: r["blocked_by"] for r in got} == WANT and all(r["keep"] == (r["blocked_by"] is None) for r in got)


def test_long_lists_are_joined_to_the_same_end(spark):
    assert {r["page_id"]: r["blocked_by"] for r in uf.blocked(*frames(spark), map_bytes=0).collect()} == WANT


def test_several_arrays(spark, monkeypatch):
    monkeypatch.setattr(uf, "SHARD_ENTRIES", 2)
    assert {r["page_id"]: r["blocked_by"] for r in uf.blocked(*frames(spark)).collect()} == WANT


def test_empty_tables(spark):
    pages, entries = frames(spark)
    assert uf.blocked(pages.limit(0), entries).count() == 0
    assert uf.blocked(pages, entries.limit(0)).where("not keep").count() == 0


def test_collisions_block_nothing(tmp_path):
    digests = np.array([7, 7, 9], np.uint64)
    body = uf.DigestArray.pack(digests, [b"one", b"two", b"three"])
    uf._write(f"file://{tmp_path}/d", body)
    array = uf.DigestArray(f"file://{tmp_path}/d")
    assert array.find(np.array([7, 7, 7, 9, 8], np.uint64), [b"two", b"one", b"other", b"x", b"three"]).tolist() == [True, True, False, False, False]


def test_keys(spark):
    got = spark.createDataFrame([("http://a.b.c/x/?q#f",)], "u string").select(uf.probe_keys(F.col("u")).alias("k")).first()["k"]
    assert got == ["a.b.c/x/?q", "a.b.c/x", "a.b.c", "b.c"]
