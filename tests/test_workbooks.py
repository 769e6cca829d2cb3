"""Workbook sheets give the rows of their CSV export."""

import zipfile

import pytest

from epochlake.sources import tables, workbooks


def letters(n):
    return (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def workbook(path, rows, skip=()):
    """Texts as shared strings (one of them in runs) or inline, numbers as they are; None has no cell."""
    strings, body = [], []
    for r, cells in enumerate(rows, 1):
        out = []
        for c, v in enumerate(cells, 1):
            ref = f"{letters(c)}{r}"
            if isinstance(v, str) and (r + c) % 3:
                strings.append(v)
                out.append(f'<c r="{ref}" s="1" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(v, str):
                out.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>')
            elif v is not None:
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
        if r not in skip:
            body.append(f'<row r="{r}" spans="1:9">{"".join(out)}</row>')
    items = [f'<si><t xml:space="preserve">{s}</t></si>' if k % 2 else f"<si><r><rPr><b/></rPr><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for k, s in enumerate(strings)]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet {ns}><dimension ref="A1"/><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst {ns} count="1">{"".join(items)}</sst>')


def table():
    head = ["participants_ID", " AGE ", *[f"x{i}" for i in range(27)], "Formal_Status", "age"]
    rows = [[f"sub-{i}", 18 + i / 4 if i % 4 else ("n/a" if i % 8 else None), *[i * k if k % 5 else None for k in range(27)], ["ADHD", "HEALTHY", "a &amp; b", None][i % 4], 99] for i in range(40)]
    return head, rows


COLUMNS = {"id": "participants_id", "age": "Age", "status": "FORMAL_STATUS"}


def test_same_rows_as_the_export(spark, tmp_path):
    head, rows = table()
    workbook(tmp_path / "p.xlsx", [head, *rows])
    text = lambda v: "" if v is None else str(v).replace("&amp;", "&")
    (tmp_path / "p.csv").write_text("\n".join(",".join(map(text, r)) for r in [head, *rows]) + "\n")
    got = workbooks.read_sheet(spark, str(tmp_path), COLUMNS, ("age",))
    want = tables.read_participants(spark, str(tmp_path / "p.csv"), COLUMNS, ("age",))
    assert sorted(map(repr, (tuple(r) for r in got.drop("path", "row").collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))
    assert got.filter("row = 2").first()["id"] == "sub-0"


def test_missing_columns_bad_files_and_empty_sheets(spark, tmp_path):
    head, rows = table()
    workbook(tmp_path / "p.xlsx", [head, *rows])
    with pytest.raises(ValueError, match="height"):
        workbooks.read_sheet(spark, str(tmp_path), {"h": "height", "id": "participants_id"})
    assert workbooks.read_cells(spark, str(tmp_path), 2)[0].count() == 0
    assert workbooks.read_cells(spark, str(tmp_path), 3)[1].first()["error"] == "no sheet 3"
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="bad.xlsx"):
        workbooks.read_sheet(spark, str(tmp_path), COLUMNS)
