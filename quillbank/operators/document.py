"""Papers as documents: a relational plan of blocks, and Word files out of it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.functions import latex
from quillbank.functions import scalars as S

# What a paper says, and the types that get room to write.
QUESTIONS_HEADING, ANSWERS_HEADING = "一、 精選特訓試題區", "🎯 參考答案區（解答邊界）"
WITH_ROOM = ("計算", "證明")
RULE = "=" * 60
#: Block numbers: so many for each question, so that blocks need no running count.
STRIDE = 8


def header(student: Column, ts: Column) -> Column:
    return F.concat(F.lit("學生姓名："), student, F.lit("     |     得分：__________     |     列印日期："), S.print_date(ts))


def doc_plan(papers: DataFrame, bank: DataFrame, formulas: bool = True) -> DataFrame:
    """(paper_id, block_no, kind, text, xml) of papers (id, title, student_name, question_ids, created_at).

    Formulas are read in the one Python step, once for each question that stands on any
    paper, and the blocks of all papers take them over. Without ``formulas`` none is read,
    and there is no xml; the blocks are the same.
    """
    listed = papers.select(F.col("id").alias("paper_id"), F.posexplode(S.ids_from_json(F.col("question_ids"))).alias("pos", "id"))
    said = ["id", "question_type", "difficulty", "question_img"]
    if formulas:
        wanted = bank.join(listed.select("id").distinct(), "id", "left_semi")
        read = wanted.select(*said, F.to_json(latex.render(F.col("question_text"))).alias("question_xml"), F.to_json(latex.render(F.col("answer_text"))).alias("answer_xml"))
    else:
        read = bank.select(*said, F.lit("[]").alias("question_xml"), F.lit("[]").alias("answer_xml"))
    # merge: a read question is many times the size of its row in the bank, by which a broadcast would be judged.
    asked = listed.join(read.hint("merge"), "id")
    number = F.col("pos") + 1

    def block(no, kind: str, text: Column, xml: Column | None = None) -> Column:
        return F.struct(no.cast("long").alias("block_no"), F.lit(kind).alias("kind"), text.alias("text"), (F.lit("[]") if xml is None else xml).alias("xml"))

    front = papers.select(
        F.col("id").alias("paper_id"),
        F.explode(F.array(
            block(F.lit(0), "title", F.col("title")), block(F.lit(1), "line", header(F.col("student_name"), F.col("created_at"))),
            block(F.lit(2), "line", F.lit(RULE)), block(F.lit(3), "heading", F.lit(QUESTIONS_HEADING)),
            block(F.lit(1 << 40), "page_break", F.lit("")), block(F.lit((1 << 40) + 1), "heading", F.lit(ANSWERS_HEADING)),
        )).alias("b"),
    )
    at = number * STRIDE
    # coalesce: a question without an image has a null address.
    image = F.when(F.coalesce(S.is_safe_url(F.col("question_img")), F.lit(False)), block(at + 1, "image", F.col("question_img")))
    room = F.when(F.col("question_type").isin(*WITH_ROOM), F.array(block(at + 2, "line", F.lit("")), block(at + 3, "line", F.lit(""))))
    label = S.question_label(number, F.col("question_type"), F.col("difficulty"))
    answer = F.concat(F.lit("第 "), number.cast("string"), F.lit(" 題答案："))
    each = F.concat(
        F.array(block(at, "question", label, F.col("question_xml")), block(at + (1 << 41), "answer", answer, F.col("answer_xml"))),
        F.array_compact(F.array(image)),
        F.coalesce(room, F.array().cast("array<struct<block_no:bigint,kind:string,text:string,xml:string>>")),
    )
    plan = front.union(asked.select("paper_id", F.explode(each).alias("b"))).select("paper_id", "b.*")
    return plan if formulas else plan.drop("xml")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
_A, _PIC = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/>'
    '<Default Extension="gif" ContentType="image/gif"/><Default Extension="bmp" ContentType="image/bmp"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def _text(text: str, bold: bool = False, color: str | None = None) -> str:
    look = ("<w:b/>" if bold else "") + (f'<w:color w:val="{color}"/>' if color else "")
    return f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph(kind: str, text: str, parts) -> str:
    """One block as WordprocessingML."""
    styles = {"title": "Title", "heading": "Heading1"}
    look = f'<w:pPr><w:pStyle w:val="{styles[kind]}"/></w:pPr>' if kind in styles else ""
    if kind == "page_break":
        return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = _text(text or "", bold=kind in ("question", "answer"), color="2B6CB0" if kind == "question" else None)
    if kind == "question":
        body += "<w:r><w:br/></w:r>"
    for part in parts or ():
        if part.get("xml"):
            body += f"<m:oMath>{part['xml']}</m:oMath>"
        elif part["kind"] == "break":
            body += "<w:r><w:br/></w:r>"
        else:
            body += _text(part.get("text") or "", bold=kind == "answer", color="E53E3E" if kind == "answer" else None)
    return f"<w:p>{look}{body}</w:p>"


# How an image stands on the page (pixels of 9525 units), and how files of an image kind start.
IMAGE_WIDTH, IMAGE_HEIGHT, PIXEL = 300, 200, 9525
IMAGE_STARTS = {b"\x89PNG": "png", b"\xff\xd8": "jpeg", b"GIF8": "gif", b"BM": "bmp"}


def image_kind(data: bytes) -> str:
    return next((kind for start, kind in IMAGE_STARTS.items() if data.startswith(start)), "png")


def picture(number: int) -> str:
    """A centred paragraph with the ``number``-th image, and an empty one below it."""
    size = f'cx="{IMAGE_WIDTH * PIXEL}" cy="{IMAGE_HEIGHT * PIXEL}"'
    drawing = (
        f'<w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent {size}/><wp:docPr id="{number}" name="image{number}"/>'
        f'<a:graphic xmlns:a="{_A}"><a:graphicData uri="{_PIC}"><pic:pic xmlns:pic="{_PIC}"><pic:nvPicPr><pic:cNvPr id="{number}" name="image{number}"/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="rIdImage{number}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>'
    )
    return f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r>{drawing}</w:r></w:p><w:p/>'


def package(paragraphs: list[str], images: list[bytes] = ()) -> bytes:
    """A Word file of paragraphs; ``picture(n)`` among them shows the n-th image, from 1."""
    held = io.BytesIO()
    document = (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}" xmlns:m="{_M}" xmlns:r="{_R}" xmlns:wp="{_WP}"><w:body>{"".join(paragraphs)}</w:body></w:document>'
    )
    files = [("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)]
    if images:
        names = [f"image{n}.{image_kind(data)}" for n, data in enumerate(images, 1)]
        links = "".join(f'<Relationship Id="rIdImage{n}" Type="{_R}/image" Target="media/{name}"/>' for n, name in enumerate(names, 1))
        files.append(("word/_rels/document.xml.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'))
        files += [(f"word/media/{name}", data) for name, data in zip(names, images, strict=True)]
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            # A fixed time, so that equal papers are equal files.
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return held.getvalue()


def write_docx(plan: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(paper_id, docx): a file per paper; a paper has ``MAX_DRAW`` questions at most.

    images: (url, bytes), as ``readers.fetch_images`` gives them. An image that isn't there is left out.
    """
    if images is None:
        held = plan.withColumn("bytes", F.lit(None).cast("binary"))
    else:
        known = images.filter(F.col("bytes").isNotNull()).select(F.lit("image").alias("kind"), F.col("url").alias("text"), "bytes").dropDuplicates(["text"])
        held = plan.join(known, ["kind", "text"], "left")

    def build(frame):
        import json

        import pandas as pd

        rows = frame.sort_values("block_no")
        paragraphs, found = [], []
        for kind, text, xml, data in zip(rows["kind"], rows["text"], rows["xml"], rows["bytes"], strict=True):
            if kind != "image":
                paragraphs.append(paragraph(kind, text, json.loads(xml) if xml else None))
            elif data is not None:
                found.append(bytes(data))
                paragraphs.append(picture(len(found)))
        return pd.DataFrame({"paper_id": [rows["paper_id"].iloc[0]], "docx": [package(paragraphs, found)]})

    return held.select("paper_id", "block_no", "kind", "text", "xml", "bytes").groupBy("paper_id").applyInPandas(build, "paper_id long, docx binary")


# The words of the two reports.
SEVERITIES = {"error": "嚴重", "warn": "警告", "info": "提示"}
FIELDS = {"question": "題目", "answer": "答案"}
REPORT_TITLE, PREVIEW_TITLE, NOTHING_FOUND = "題庫公式健檢報告", "公式修正預覽", "沒有偵測到任何公式問題"


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def html_report(found: DataFrame, bank: DataFrame) -> DataFrame:
    """(id, html): the table rows of each question with issues, by field and code."""
    said = found.join(bank.select("id", "subject", "chapter", "question_text", "answer_text"), "id")
    text = F.coalesce(F.when(F.col("field") == "question", F.col("question_text")).otherwise(F.col("answer_text")), F.lit(""))
    where = F.concat(S.html_escape(F.col("subject")), F.lit("<br>"), S.html_escape(F.col("chapter")))
    row = _cells(F.col("id").cast("string"), where, _named(F.col("field"), FIELDS), _named(F.col("sev"), SEVERITIES), S.html_escape(F.col("code")), F.concat(F.lit("<code>"), S.html_escape(S.snippet(text, 160)), F.lit("</code>")))
    rows = said.select("id", F.struct("field", "sev", "code", row.alias("row")).alias("r")).groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return rows.select("id", F.array_join(F.transform("rows", lambda r: r["row"]), "").alias("html"))


def report_totals(found: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: questions, flagged and the issues of each severity."""
    counted = found.agg(F.countDistinct("id").alias("flagged"), *[F.count_if(F.col("sev") == s).alias(s) for s in SEVERITIES])
    return bank.agg(F.count(F.lit(1)).alias("questions")).join(counted).select("questions", "flagged", *SEVERITIES)


def _page(title: str, totals: list[tuple[str, int]], body) -> Iterator[str]:
    yield f'<!DOCTYPE html><html lang="zh-TW"><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>'
    yield "　".join(f"{name}：<b>{n}</b>" for name, n in totals) + "</p>"
    yield from body
    yield "</body></html>"


def report_document(found: DataFrame, bank: DataFrame) -> Iterator[str]:
    """The whole report, part by part; rows come from the cluster one partition at a time, in order of id."""
    totals = report_totals(found, bank).first()
    head = [("總題數", totals.questions), ("有問題題目", totals.flagged), *[(label, totals[s]) for s, label in SEVERITIES.items()]]

    def body():
        if not totals.flagged:
            yield f"<p>{NOTHING_FOUND}</p>"
            return
        yield "<table><tr><th>ID</th><th>科目/章節</th><th>欄位</th><th>等級</th><th>問題</th><th>內容片段</th></tr>"
        for r in html_report(found, bank).orderBy("id").toLocalIterator():
            yield r.html
        yield "</table>"

    return _page(REPORT_TITLE, head, body())


def html_preview(classified: DataFrame) -> DataFrame:
    """(id, bucket, html): what a repair would change, or what it leaves to people."""
    cell = lambda c: S.html_escape(F.col(c))
    row = _cells(F.col("id").cast("string"), cell("question_text"), cell("new_question"), cell("answer_text"), cell("new_answer"))
    return classified.filter("bucket IS NOT NULL").select("id", "bucket", row.alias("html"))


def preview_totals(classified: DataFrame) -> DataFrame:
    """One row: questions, and how many would be repaired or need a person."""
    return classified.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("bucket") == "auto").alias("auto"), F.count_if(F.col("bucket") == "manual").alias("manual"))


def preview_document(classified: DataFrame) -> Iterator[str]:
    """The whole preview, part by part: first what is repaired, then what isn't, each in order of id."""
    totals = preview_totals(classified).first()

    def body():
        rows = html_preview(classified)
        for bucket, label in (("auto", "將自動修復"), ("manual", "需人工處理")):
            yield f"<h2>{label}（{totals[bucket]}）</h2><table>"
            for r in rows.filter(F.col("bucket") == bucket).orderBy("id").toLocalIterator():
                yield r.html
            yield "</table>"

    return _page(PREVIEW_TITLE, [("總題數", totals.questions), ("將自動修復", totals.auto), ("需人工處理", totals.manual)], body())
