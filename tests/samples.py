"""Writers of small office files, and sample texts of our own."""

from __future__ import annotations

import zipfile
import zlib
from pathlib import Path
from xml.sax.saxutils import escape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

NOTE = "# 潮汐说明\n\n## 摘要\n潮汐是月球和太阳引力引起的海水周期性涨落。大潮出现在朔望日前后，小潮出现在上下弦日。\n- 什么是潮汐？\n"
PARAGRAPHS = ["火山基础", "岩浆沿裂隙上升形成火山喷发。", "火山灰可以影响航空安全 & 气候。"]
SHEET = [["id", "metal", "melting_C"], ["A1", "tin", "232"], ["A2", "lead", "327"]]
LINES = ["Rivers and deltas", "A delta forms where a river meets slow water.", "They are rich in sediment.", "P waves travel through solids. S waves travel only through solids."]


def docx(path: Path, paragraphs=PARAGRAPHS, extra: str = "") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs) + extra
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def xlsx(path: Path, rows=SHEET, name: str = "sheet1") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    strings = list(dict.fromkeys(v for r in rows for v in r))
    cells = "".join("<row>" + "".join(f'<c t="s"><v>{strings.index(v)}</v></c>' for v in r) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {M}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        z.writestr(f"xl/worksheets/{name}.xml", f"<worksheet {M}><sheetData>{cells}<row><c t='inlineStr'><is><t>inline</t></is></c><c><v>7</v></c><c/></row><row><c/></row></sheetData></worksheet>")


def pdf(path: Path, lines=LINES) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    stream = zlib.compress("\n".join(["BT", *(f"({x}) Tj" for x in lines), "[(last) -20 (word)] TJ", "ET"]).encode("latin-1"))
    path.write_bytes(b"%PDF-1.4\n1 0 obj\n<< >>\nstream\n" + stream + b"\nendstream\nendobj\n%%EOF\n")


def write_all(root: Path) -> None:
    xlsx(root / "excel/metals.xlsx")
    (root / "markdown").mkdir(parents=True, exist_ok=True)
    (root / "markdown/tides.md").write_text(NOTE, encoding="utf-8")
    pdf(root / "pdf/rivers.pdf")
    docx(root / "word/volcano.docx")
