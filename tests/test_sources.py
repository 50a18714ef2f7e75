"""Rows in their files' order, workbooks, and encoders as plug-ins."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import encoders, semantic
from tarn.sources import files
from tarn.sources.sheets import SheetSource, column_index


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_last_row_counts_across_blocks(spark, tmp_path, small_blocks):
    rnd, lines, want = random.Random(2), ["folderName,value,note"], {}
    for i in range(4000):
        k = f"f{rnd.randrange(300)}"
        lines.append(f"{k},{i},{'x' * rnd.randrange(20)}")
        want[k] = str(i)
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    assert spark.read.csv(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    got = files.read_attributes(spark, str(tmp_path / "a.csv")).collect()
    assert {r.folderName: r.attributes["value"] for r in got} == want and set(got[0].attributes) == {"folderName", "value", "note"}


def test_numbers_of_rows(spark, tmp_path, small_blocks):
    sizes = {"a.csv": 3000, "b.csv": 1, "c.csv": 700}
    for name, n in sizes.items():
        (tmp_path / name).write_text("i,pad\n" + "".join(f"{i},{'y' * (i % 31)}\n" for i in range(n)))
    got = files.numbered(spark.read.option("header", True).csv(str(tmp_path))).collect()
    assert len(got) == 3701 and all(int(r.i) == r.row_number for r in got)
    assert {r.file.rsplit("/", 1)[1] for r in got} == set(sizes)


def workbook(path, rows, shared, name="Data"):
    """A workbook whose second sheet has the rows of cells, each a piece of XML."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Cover" sheetId="1" r:id="r1"/><sheet name="{name}" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s2.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    s = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    shared = ["<t>id</t>", "<t>message</t>", "<r><t>two </t></r><r><t>runs &amp; more</t></r><rPh><t>hint</t></rPh>"]
    head = [s("A1", 0), s("B1", 1), '<c r="D1" t="inlineStr"><is><t>ok</t></is></c>']
    workbook(tmp_path / "a.xlsx", [head, ['<c r="A2"><v>7</v></c>', s("B2", 2), '<c r="D2" t="b"><v>1</v></c>'], [], ['<c r="D4" t="str"><f>X</f><v>sum</v></c>']], shared)
    # other order of columns
    workbook(tmp_path / "b.xlsx", [[s("A1", 1), s("B1", 0)], ["<c><v>m</v></c>", "<c><v>8</v></c>"]], shared)
    spark.dataSource.register(SheetSource)
    got = spark.read.format("xlsx").option("sheet", "Data").load(str(tmp_path))
    assert got.columns == ["id", "message", "ok"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("7", "two runs & more", "true"), (None, None, "sum"), ("8", "m", None)], key=str)
    assert spark.read.format("xlsx").schema("id string").option("sheet", "Data").load(str(tmp_path / "b.xlsx")).collect()[0].id == "8"
    with pytest.raises(Exception, match="No sheet"):
        spark.read.format("xlsx").option("sheet", "none").load(str(tmp_path)).collect()
    assert [column_index(r) for r in ("A1", "Z9", "AA1", "BA3")] == [0, 25, 26, 52]


def test_encoders(spark, tmp_path):
    texts = ["red apple", "apple red", "green car", "", "?!", "Red_1 red", None, "red apple"]
    df = spark.createDataFrame([(f"s{i}", 1, t) for i, t in enumerate(texts)], "sample_id string, pos int, text string")
    path = str(tmp_path / "vectors")
    first = encoders.encode_into(df.limit(3).select("text"), encoders.hashing_encoder, path)
    assert first.count() == 3
    vectors = encoders.encode_into(df.select("text"), encoders.hashing_encoder, path)
    # each text once, the known ones not again
    assert vectors.count() == len({t for t in texts if t is not None}) == vectors.select("h").distinct().count()
    assert encoders.encode_into(df.select("text"), encoders.hashing_encoder, path).count() == vectors.count()
    raw = encoders.hashing_encoder()([t or "" for t in texts])
    asked = df.select("sample_id", F.lit("red apple").alias("text"))
    got = {r.sample_id: r.score for r in encoders.scores(asked, df, vectors).collect()}
    for i in range(len(texts)):
        norm = np.linalg.norm(raw[0]) * np.linalg.norm(raw[i])
        assert got[f"s{i}"] == pytest.approx(raw[0] @ raw[i] / norm if norm > 0 else 0.0)
    assert got["s1"] == pytest.approx(1.0) and encoders.encoded(df.limit(0).select("text"), encoders.hashing_encoder).count() == 0


def test_only_changed_queries_are_scored_again(spark):
    asked = spark.createDataFrame([("a", "red apple"), ("b", "green car"), ("c", None)], "sample_id string, text string")
    new = spark.createDataFrame([("a", "red apple pie"), ("b", "green car"), ("c", "car")], "sample_id string, text string")
    pool = spark.createDataFrame([(s, p, t) for s in "abc" for p, t in enumerate(("apple pie", "old car", None))], "sample_id string, pos int, text string")
    calls = []

    def again(queries, own):
        calls.append(({r.sample_id for r in queries.collect()}, own.count()))
        return encoders.scores(queries, own, encoders.encoded(queries.select("text").unionByName(own.select("text")), encoders.hashing_encoder))

    first = encoders.scores(asked, pool, encoders.encoded(asked.select("text").unionByName(pool.select("text")), encoders.hashing_encoder))
    got = {(r.sample_id, r.pos): (r.score, r.changed) for r in semantic.rescored(first, asked, new, pool, again).collect()}
    assert calls == [({"a", "c"}, 6)]
    # the same as scoring all of them
    full = {(r.sample_id, r.pos): r.score for r in again(new, pool).collect()}
    assert got == {k: (pytest.approx(v), k[0] != "b") for k, v in full.items()} and len(got) == 9
