import json

import pytest
from pyspark.sql import functions as F

from matchlake.sources import export, files
from matchlake.sources.store import DuplicateKeyError, KeyedTable


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    path = tmp_path / "a.txt"
    texts = [f"line {i} " + "x" * (i % 37) for i in range(500)] + ["", "last without end"]
    path.write_text("\n".join(texts), encoding="utf-8")
    for size in (7, 100, 1 << 20):
        rows = files.numbered_lines(spark, str(path), size).collect()
        assert sorted((r.line, r.text) for r in rows) == list(enumerate(texts, start=1))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "x", "name": "A"}\n\n{"name": "é"}\n  {"id": 7}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(path), "p", "player").orderBy("row").collect()
    assert [(r.provider_record_id, r.row) for r in rows] == [("x", 0), ("1", 1), ("7", 2)]
    for bad in ("not json", "[1, 2]", '"text"', '{"a": '):
        path.write_text('{"id": 1}\n\n' + bad + "\n")
        with pytest.raises(files.SourceReadError, match=r"a\.jsonl:3"):
            files.read_jsonl(spark, str(path), "p", "player")
        assert files.read_jsonl(spark, str(path), "p", "player", strict=False).count() == 1
    path.write_text("")
    assert files.read_jsonl(spark, str(path), "p", "player").count() == 0


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id;name;country\n1;"A; B";AUT\n2;C\n')
    rows = files.read_csv(spark, str(path), "p", "player", delimiter=";").orderBy("row").collect()
    assert [json.loads(r.payload) for r in rows] == [{"id": "1", "name": "A; B", "country": "AUT"}, {"id": "2", "name": "C", "country": None}]
    path.write_text("id,name\n1,A,extra\n")
    with pytest.raises(files.SourceReadError, match="a.csv:2"):
        files.read_csv(spark, str(path), "p", "player")
    assert files.read_csv(spark, str(path), "p", "player", strict=False).count() == 1
    for empty in ("", "id,,name\n1,2,3\n"):
        path.write_text(empty)
        with pytest.raises(files.SourceReadError):
            files.read_csv(spark, str(path), "p", "player")


def test_pages_and_checksum(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps({"id": i, "b": 1, "a": 2}) + "\n" for i in range(5)))
    raw = files.read_jsonl(spark, str(path), "p", "match").cache()
    seen, cursor, cursors = [], None, []
    while True:
        batch, cursor = files.page(raw, cursor, 2)
        seen += [r.provider_record_id for r in batch.orderBy("row").collect()]
        cursors.append(cursor)
        if cursor is None:
            break
    assert seen == list("01234") and cursors == ["2", "4", None]
    first, again = (files.batch_checksum(files.page(raw, None, 2)[0]).head()[0] for _ in range(2))
    assert first == again != files.batch_checksum(files.page(raw, "2", 2)[0]).head()[0] and len(first) == 16
    assert files.healthy(spark, str(path)) and not files.healthy(spark, str(path) + "x")


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id", "id bigint, v string")
    rows = lambda *r: spark.createDataFrame(r, "id bigint, v string")
    assert t.count() == 0
    t.add(rows((1, "a"), (2, "b")))
    for bad in (rows((2, "x")), rows((3, "x"), (3, "y"))):
        with pytest.raises(DuplicateKeyError):
            t.add(bad)
    t.replace(rows((1, "z")))
    with pytest.raises(KeyError):
        t.replace(rows((9, "z")))
    t.upsert(rows((2, "c"), (4, "d")))
    assert {tuple(r) for r in t.read().collect()} == {(1, "z"), (2, "c"), (4, "d")}
    assert [r.v for r in t.get(4).collect()] == ["d"]
    t.clear()
    assert t.count() == 0


def test_export(spark, tmp_path):
    df = spark.sql("select 2 as id, named_struct('z', 1.23456789D, 'a', array(1, 2)) as s, cast(null as string) as n union all select 1, named_struct('z', null, 'a', array()), 'x'")
    assert export.flatten(df).columns == ["id", "n", "s.a", "s.z"]
    export.write_jsonl(df, str(tmp_path / "j"), ["id"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "n": "x", "s.a": [], "s.z": None}, {"id": 2, "n": None, "s.a": [1, 2], "s.z": 1.234568}]
    export.write_csv(df, str(tmp_path / "c"), ["id"])
    assert {r["s.a"] for r in spark.read.option("header", True).option("quote", '"').option("escape", "\\").csv(str(tmp_path / "c")).select(F.col("`s.a`")).collect()} == {"[]", "[1,2]"}
    export.write_report({"b": 1, "a": None}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": 1}
    assert export.report_text({"b": 0.5, "a": None, "c": 3}) == "b: 0.500\nc: 3"


def test_only_touched_buckets_are_written_and_old_files_go(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id", "id bigint, v string", buckets=4)
    assert t.upsert(spark.range(100).selectExpr("id", "'a' v")) == 100
    before = t._newest()["files"]
    assert t.upsert(spark.createDataFrame([(7, "b")], "id bigint, v string")) == 0
    after = t._newest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and t.count() == t.read().count() == 100
    for n in range(5):
        assert t.upsert(spark.createDataFrame([(1000 + n, "c")], "id bigint, v string")) == 1
    named = {p.split("/")[0] for v in t._versions() for p in t._manifest(v)["files"].values()}
    assert {p.name for p in (tmp_path / "t").iterdir()} == named | {"manifests"} and len(t._versions()) == 2
    assert {r.v for r in t.get(7, 1003, 5).collect()} == {"a", "b", "c"} and t.has("v", "b") and not t.has("v", "z")
    with pytest.raises(DuplicateKeyError):
        t.add(spark.createDataFrame([(5000, "b")], "id bigint, v string"), unique=["v"])
    assert t.count() == 105


def test_quoted_fields_over_lines_and_health(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"two\nlines, one ""field"""\n\n2\n3,c\n', encoding="utf-8")
    rows = files.read_csv(spark, str(path), "p", "match", multiline=True).orderBy("row").collect()
    assert [r.provider_record_id for r in rows] == ["1", "2", "3"] and [r.row for r in rows] == [0, 1, 2]
    import json

    assert [json.loads(r.payload)["text"] for r in rows] == ['two\nlines, one "field"', None, "c"]
    path.write_text("id,text\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception, match="wider"):
        files.read_csv(spark, str(path), "p", "match", multiline=True).collect()
    assert files.read_csv(spark, str(path), "p", "match", multiline=True, strict=False).count() == 1
    assert files.health(spark, str(path)).head().healthy and not files.health(spark, str(tmp_path / "none")).head().healthy
