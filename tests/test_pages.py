"""Landed payload pages as a data source: the same rows however files are cut, in batch and streamed, and when a batch is replayed."""
import gzip
import json
import os

from corpusloom.sources import pages


def land(folder, name, lines, when):
    path = os.path.join(folder, name)
    data = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines).encode()
    with (gzip.open if name.endswith(".gz") else open)(path, "wb") as f:
        f.write(data)
    os.utime(path, (when, when))


def page(*ids):
    return {"hits": {"list": [{"pmid": i, "title": f"Title {i}", "abstract": "é" * (i % 50)} for i in ids]}}


OPTIONS = {"items": "hits.list", "id": "pmid", "text": "title,abstract"}


def key(rows):
    return sorted((os.path.basename(r["file"]), r["at"], r["item"], r["status"], r["id"] or "", r["text"] or "", r["body"]) for r in rows)


def test_ranges_do_not_change_the_rows(spark, tmp_path):
    fmt = pages.register(spark)
    land(tmp_path, "a.jsonl", [page(1, 2), "", page(), {"other": 1}, page(3), "{broken", '{"hits": {"list": [{"pmid": "x", "title": "tab\there \x01"}, 7, {"title": null}]}}', [1, 2]], 100)
    land(tmp_path, "b.jsonl", [page(*range(i, i + 3)) for i in range(10, 400, 3)], 200)
    land(tmp_path, "c.jsonl.gz", [page(500), page(501)], 300)
    land(tmp_path, "empty.jsonl", [], 300)
    land(tmp_path, "_hidden.jsonl", [page(9)], 300)
    read = lambda n: spark.read.format(fmt).options(**OPTIONS, splitBytes=n).load(str(tmp_path))
    whole = read(1 << 26)
    rows = key(whole.collect())
    ids = [r[4] for r in rows]
    assert [i for i in ids if i.isdigit()] == [str(i) for i in (1, 2, 3, *range(10, 400), 500, 501)]
    assert [r[6] for r in rows if r[3] == "failed"] == ["{broken"]
    assert {"x", ""} <= set(ids) and ("7" in [r[6] for r in rows]) and [r[5] for r in rows if r[4] == "2"] == ["Title 2\n\néé"]
    assert len(set(r[:3] for r in rows)) == len(rows)
    assert key(read(1000).collect()) == rows
    names = pages.SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    for n in (300, 77, 7, 1):                # cut by hand: thousands of tasks otherwise
        cut = pages.LandedPages({**OPTIONS, "path": str(tmp_path), "splitBytes": str(n)}).reader(None)
        assert key(dict(zip(names, r)) for p in cut.partitions() for r in cut.read(p)) == rows
    assert read(1000).rdd.getNumPartitions() > 10 > whole.rdd.getNumPartitions()
    assert spark.read.format(fmt).load(str(tmp_path / "none")).collect() == []


class Notes(pages.LandedPages):
    @classmethod
    def name(cls):
        return "notes"

    def records(self, page):
        for k, note in enumerate(page["notes"]):
            yield f"{page['owner']}-{k}", note.upper(), {"owner": page["owner"]}


def test_a_source_of_its_own(spark, tmp_path):
    land(tmp_path, "n.jsonl", [{"owner": "o", "notes": ["a", "b"]}, {"owner": "p"}, {"owner": "q", "notes": [1]}], 5)
    got = key(spark.read.format(pages.register(spark, Notes)).load(str(tmp_path)).collect())
    assert [(r[3], r[4], r[5]) for r in got] == [("ok", "o-0", "A"), ("ok", "o-1", "B"), ("failed", "", ""), ("failed", "", "")]


def test_stream_takes_each_file_once_and_replays_the_same(spark, tmp_path):
    fmt = pages.register(spark)
    landing, seen = tmp_path / "landing", {}
    landing.mkdir()

    def run(name):
        def write(batch, n):
            seen.setdefault((name, n), []).append(key(batch.collect()))

        s = spark.readStream.format(fmt).options(**OPTIONS, settleSeconds=0, splitBytes=300).load(str(landing))
        q = s.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()

    land(landing, "b.jsonl", [page(*range(i, i + 4)) for i in range(0, 40, 4)], 100)
    run("one")
    land(landing, "a.jsonl", [page(100), page(101)], 100.5)        # sorts before, lands after
    land(landing, "c.jsonl", [page(200)], 100.5)
    run("one")
    run("one")                                                     # nothing new
    ids = [r[4] for batch in seen.values() for taken in batch for r in taken]
    assert sorted(map(int, ids)) == [*range(40), 100, 101, 200]
    # A batch whose commit is lost runs again over the same offsets, though more has landed since.
    last = max(n for _, n in seen)
    for f in (f"{last}", f".{last}.crc"):
        path = tmp_path / "one" / "commits" / f
        if path.exists():
            path.unlink()
    land(landing, "d.jsonl", [page(300)], 101)
    run("one")                                                     # available-now runs one batch for Python sources: the replayed one
    run("one")
    first, again = seen[("one", last)]
    assert first == again and [r[4] for r in seen[("one", last + 1)][0]] == ["300"]


def test_offsets_name_the_same_files(tmp_path):
    source = pages.LandedPages({"path": str(tmp_path), "settleSeconds": "0"})
    reader = source.streamReader(None)
    assert reader.latestOffset() == reader.initialOffset() and [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for r in reader.read(p)] == []
    land(tmp_path, "x.jsonl", [{"id": 1, "text": "t"}], 50)
    one = reader.latestOffset()
    land(tmp_path, "y.jsonl", [{"id": 2}], 50)
    two = pages.LandedPages({"path": str(tmp_path), "settleSeconds": "0"}).streamReader(None).latestOffset()
    rows = lambda a, b: [(r[4], r[5]) for p in reader.partitions(a, b) for r in reader.read(p)]
    assert rows(reader.initialOffset(), one) == [("1", "t")] and rows(one, two) == [("2", None)] and rows(two, two) == []
    young = pages.LandedPages({"path": str(tmp_path), "settleSeconds": "1e10"}).streamReader(None)
    assert young.latestOffset() == young.initialOffset()


def test_a_task_holds_a_few_megabytes_of_rows(tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": i, "text": chr(97 + i % 26) * 500_000}) + "\n" for i in range(40)) + "no page\n")
    source = pages.LandedPages({"path": str(tmp_path)})
    for reader in (source.reader(source.schema()), source.streamReader(source.schema())):
        found = [batch for part in source.tasks(source.files()) for batch in reader.read(part)]
        assert sum(batch.num_rows for batch in found) == 41
        assert max(batch.nbytes for batch in found) < 8 << 20
        assert [r["id"] for batch in found for r in batch.to_pylist()] == [*map(str, range(40)), None]
