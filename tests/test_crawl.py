"""The paged source over a transport of files: retries, content types, drift, many tasks, and a stream that is stopped and started."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from proofgrid.session import ship_package
from proofgrid.sources import crawl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Files:
    """Serves <folder>/<path>.json; a file <path>.fail with statuses, one a line, is used up first; <path>.moved holds the list from the second page on."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, path, params):
        fail = f"{self.folder}/{path}.fail"
        if os.path.exists(fail):
            with open(fail) as f:
                left = f.read().split()
            if left:
                with open(fail, "w") as f:
                    f.write("\n".join(left[1:]))
                if left[0] == "down":
                    raise ConnectionError("down")
                return crawl.Response(int(left[0]), {"Retry-After": "0"}, b"")
        name = f"{self.folder}/{path}.moved"
        if not params["offset"] or not os.path.exists(name):
            name = f"{self.folder}/{path}.json"
        with open(name) as f:
            every = json.load(f)
        part = every[params["offset"] : params["offset"] + params["limit"]]
        return crawl.Response(200, {"content-type": "application/json; charset=utf-8"}, json.dumps({"total": len(every), "items": part}).encode())


def put(folder, path, ids, suffix="json"):
    (folder / f"{path}.{suffix}").write_text(json.dumps([{"id": i, "name": f"n{i}"} for i in ids]))


def reading(spark, folder, paths, **options):
    ship_package(spark)
    spark.dataSource.register(crawl.source(Files(folder)))
    return spark.read.format("crawl").option("paths", "\n".join(paths)).options(backoff=0.001, **options).load()


def state(rows):
    return {r["path"]: (r["total"], r["places"], r["keys"], r["reason"]) for r in crawl.verdicts(rows, "$.id").collect()}


def test_pages_of_many_sizes_give_every_item_once(spark, tmp_path):
    sizes = {"none": 0, "one": 1, "page": 10, "more": 11, "many": 137}
    for name, n in sizes.items():
        put(tmp_path, name, range(n))
    for limit, pages in ((10, 3), (2, 50)):
        rows = reading(spark, tmp_path, sizes, limit=limit, pages=pages)
        got = sorted((r["path"], r["place"], json.loads(r["item"])["id"]) for r in crawl.items(rows).collect())
        assert got == sorted((name, i, i) for name, n in sizes.items() for i in range(n))
        assert state(rows) == {name: (n, n, n, None) for name, n in sizes.items()}
    assert reading(spark, tmp_path, ["many"], limit=10, pages=3).rdd.getNumPartitions() == 6  # a path is spread over tasks
    put(tmp_path, "single", range(3))
    assert state(reading(spark, tmp_path, ["single"], limit=1)) == {"single": (3, 3, 3, None)}


def test_a_list_that_moves_is_unstable(spark, tmp_path):
    for name, later in {"grown": range(31), "shifted": [99, *range(29)], "back": [*range(1, 30), 99], "lost": [*range(15), *range(16, 30), 15], "twice": range(30)}.items():
        put(tmp_path, name, range(30))
        put(tmp_path, name, later, "moved")
    put(tmp_path, "twice", [*range(20), *range(10)])
    put(tmp_path, "twice", [*range(20), *range(10)], "moved")
    got = {k: v[3] for k, v in state(reading(spark, tmp_path, ["grown", "shifted", "back", "lost", "twice"], limit=10)).items()}
    assert got == {"grown": "total-changed", "shifted": "overlap-differs", "back": "overlap-differs", "lost": None, "twice": "keys-repeat"}  # all pages after the first agree in `lost`


def test_retries_and_what_is_not_retried(tmp_path):
    slept, answers = [], []

    def transport(path, params):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    good = crawl.Response(200, {"Content-Type": "application/vnd.api+json"}, b'{"total": 2, "items": [1]}')
    asking = crawl.Asking(transport, ("x",), retries=3, backoff=0.25, sleep=slept.append)
    ask = lambda *given: (answers.__setitem__(slice(None), given), slept.clear(), crawl.fetched(asking, "x", 0, 1))[2]
    assert ask(OSError("gone"), crawl.Response(503, {}, b""), crawl.Response(429, {"retry-after": "7"}, b""), good) == (2, [1]) and slept == [0.25, 0.5, 7.0]
    for given, said, pauses in (
        ([OSError("gone")] * 4, "after 4 attempts with status unavailable gone", 3),
        ([crawl.Response(503, {}, b"")] * 4, "after 4 attempts with status 503", 3),
        ([crawl.Response(404, {}, b"")], "after 1 attempts with status 404", 0),
        ([crawl.Response(200, {"content-type": "text/html"}, b"{}")], "expected JSON", 0),
        ([crawl.Response(200, {"content-type": "application/json"}, b'{"items": []}')], "without total", 0),
    ):
        with pytest.raises(crawl.CrawlError, match=said):
            ask(*given)
        assert len(slept) == pauses
    assert crawl.pause_of({"Retry-After": "Thu, 01 Jan 1970 00:01:40 GMT"}, 0, 1, now=lambda: 90) == 10
    assert crawl.pause_of({"Retry-After": "soon"}, 2, 1) == 4
    for wrong in ({"limit": 0}, {"retries": 6}, {"paths": ()}):
        with pytest.raises(ValueError):
            crawl.Asking(**({"transport": transport, "paths": ("x",)} | wrong))


def test_tasks_retry_too(spark, tmp_path):
    put(tmp_path, "x", range(25))
    (tmp_path / "x.fail").write_text("503\ndown\n429")
    assert state(reading(spark, tmp_path, ["x"], limit=10)) == {"x": (25, 25, 25, None)}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    ship_package(spark)
    spark.dataSource.register(crawl.source(Files(tmp_path), "crawl_files"))
    out, ids = str(tmp_path / "out"), lambda: sorted(json.loads(r["item"])["id"] for r in crawl.items(spark.read.schema(crawl.SCHEMA).parquet(out)).collect())

    def run(want):
        rows = spark.readStream.format("crawl_files").option("paths", "x").option("limit", "10").option("pages", "1").load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            for _ in range(200):
                q.processAllAvailable()
                if q.lastProgress and len(ids()) >= want:
                    return
                time.sleep(0.1)
        finally:
            q.stop()

    put(tmp_path, "x", range(23))
    run(23)
    assert ids() == list(range(23))
    put(tmp_path, "x", range(45))
    run(45)
    assert ids() == list(range(45))
    assert state(spark.read.parquet(out))["x"][1:3] == (45, 45)
