"""Tar archives by ranges of members, and workbooks by rows."""

import bz2
import io
import json
import tarfile
import zipfile

import pytest

from fairline.sources import archives, exchange


def stream(k, event_type, market_type):
    d = {"eventTypeId": event_type, "marketType": market_type, "eventName": f"A{k} v B{k}", "status": "CLOSED", "runners": [{"id": 1, "name": f"A{k}", "sortPriority": 1, "status": "WINNER", "bsp": 2.5}]}
    lines = [{"op": "mcm", "pt": 1, "mc": [{"id": f"1.{k}", "rc": []}]}, {"op": "mcm", "pt": 2, "mc": [{"id": f"1.{k}", "marketDefinition": d}]}, *({"op": "mcm", "pt": 3 + i, "mc": [{"id": f"1.{k}", "rc": [{"id": 1, "ltp": 2.0 + i / 100}]}]} for i in range(30))]
    return "\n".join(map(json.dumps, lines)).encode()


@pytest.fixture
def archive(tmp_path):
    """Sixty markets, one broken, one with a name over 100 letters; half of them match odds."""
    path = tmp_path / "x.tar"
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        for k in range(60):
            data = bz2.compress(stream(k, "1" if k % 3 else "7", "MATCH_ODDS" if k % 2 else "OVER_UNDER_25"))
            info = tarfile.TarInfo(("long/" * 30 if k == 7 else "2024/") + f"{k}.bz2")
            data = b"broken" if k == 5 else data
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def test_tar_is_read_in_ranges(spark, archive):
    spark.dataSource.register(archives.TarLines)
    read = lambda **o: spark.read.format("tar_lines").options(partition_bytes=4096, **o).load(archive)
    every = read()
    assert every.rdd.getNumPartitions() > 5
    rows = every.collect()
    assert len({r.file for r in rows}) == 59 and len(rows) == 59 * 32 and max(len(r.value) for r in rows) < 1000
    plain = {m: bz2.decompress(data) for m, data in ((m.name, tarfile.open(archive).extractfile(m).read()) for m in tarfile.open(archive)) if m != "2024/5.bz2"}
    assert {r.file.split("#")[1]: r.value for r in rows if r.seq == 31} == {n: x.decode().split("\n")[31] for n, x in plain.items()}
    kept = read(event_type="1", market_types="MATCH_ODDS")
    assert {int(r.file.split("/")[-1].split(".")[0]) for r in kept.select("file").distinct().collect()} == {k for k in range(60) if k % 3 and k % 2 and k != 5}
    assert exchange.market_closes(kept).where("close = 2.5 AND won").count() == len({k for k in range(60) if k % 3 and k % 2 and k != 5})


def test_tar_of_pax_names_and_nothing(spark, tmp_path):
    spark.dataSource.register(archives.TarLines)
    with tarfile.open(tmp_path / "p.tar", "w", format=tarfile.PAX_FORMAT) as tar:
        info = tarfile.TarInfo("x" * 180 + "/é.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"a\nb"))
    (tmp_path / "e.tar").write_bytes(b"\0" * 10240)
    (tmp_path / "t.tar").write_bytes((tmp_path / "p.tar").read_bytes()[:700])
    load = lambda p: [(r.file.split("#")[1], r.seq, r.value) for r in spark.read.format("tar_lines").load(str(p)).collect()]
    assert load(tmp_path / "p.tar") == [("x" * 180 + "/é.txt", 0, "a"), ("x" * 180 + "/é.txt", 1, "b")]
    assert load(tmp_path / "e.tar") == load(tmp_path / "nothing.tar") == load(tmp_path / "t.tar") == []


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def workbook(tmp_path):
    path = tmp_path / "season.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="2024" sheetId="1" r:id="rId1"/><sheet name="notes" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Winner</t></si><si><r><t>Díaz </t></r><r><t>A.</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;m&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Date</t></is></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>PSW</t></is></c></row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" s="2"><v>1.85</v></c></row><row r="3"/><row r="4"><c r="A4" s="1"><v>45293.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    return str(path)


def test_workbook(spark, workbook):
    spark.dataSource.register(archives.WorkbookRows)
    rows = spark.read.format("workbook").schema("PSW string, Date string, Winner string, Missing string").option("sheet", "2024").load(workbook).collect()
    assert [tuple(r) for r in rows] == [("1.85", "2024-01-01", "Díaz A.", None), (None, "2024-01-02 12:00:00", None, None)]
    plain = spark.read.format("workbook").load(workbook).collect()
    assert [(r.sheet, r.row, r.cells) for r in plain if r.sheet == "notes" or r.row == 2] == [("2024", 2, ["2024-01-01", "Díaz A.", None, "1.85"]), ("notes", 1, ["1"])]
