"""The whole plan over small files, with recognisers that read words from the image's bytes."""

import io
import json
import zipfile

import pytest

from pageforge.plans.analyze import Recognised, analyze, envelope
from pageforge.sources.documents import Readers
from tests_support import docx

WORD = {"text": "", "conf": 0.9, "x1": 0, "y1": 0, "x2": 10, "y2": 20}


def image(words, **more):
    return json.dumps({"words": [[w.get(k, WORD[k]) for k in WORD] for w in words], **more}).encode()


def first(data, preset):
    x = json.loads(data)
    return Recognised(x.get("w", 1600), x.get("h", 1000), [tuple(w) for w in x["words"]], x.get("edge", 0.0), preset)


def second(data):
    x = json.loads(data)
    if x.get("fail"):
        raise RuntimeError("no engine")
    return [(f"{t}!", c, *box) for t, c, *box in x["words"]] if not x.get("blind") else []


LINE = [
    {"text": "Head", "x1": 800, "x2": 900, "y1": 20, "y2": 40}, {"text": "world", "x1": 700, "x2": 760, "y1": 502, "y2": 522}, {"text": "hello2", "x1": 400, "x2": 660, "y1": 500, "y2": 520},
    {"text": "far", "x1": 1000, "x2": 1100, "y1": 500, "y2": 520}, {"text": "side", "x1": 10, "x2": 150, "y1": 500, "y2": 520}, {"text": "foot", "x1": 800, "x2": 900, "y1": 960, "y2": 980},
]


def pptx(slides):
    """Slides (text, picture) stored in reverse, so that only the presentation gives their order."""
    out, r = io.BytesIO(), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        n = len(slides)
        ids = "".join(f'<p:sldId r:id="r{k}"/>' for k in range(n))
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="urn:p" xmlns:r="{r}">{ids}</p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", "<R>" + "".join(f'<Relationship Id="r{k}" Type="{r}/slide" Target="slides/slide{n - k}.xml"/>' for k in range(n)) + "</R>")
        for k, (t, picture) in enumerate(slides):
            blip = f'<a:blip xmlns:a="urn:a" xmlns:r="{r}" r:embed="i1"/>' if picture else ""
            z.writestr(f"ppt/slides/slide{n - k}.xml", f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:t>{t}</a:t></a:p>{blip}</p:sld>')
            if picture:
                z.writestr(f"ppt/slides/_rels/slide{n - k}.xml.rels", f'<R><Relationship Id="i1" Type="{r}/image" Target="../media/i{k}.png"/></R>')
                z.writestr(f"ppt/media/i{k}.png", picture)
    return out.getvalue()


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "sub").mkdir()
    (d / "page.PNG").write_bytes(image(LINE))
    (d / "sub" / "page.PNG").write_bytes(image([]))
    (d / "fail.jpg").write_bytes(image(LINE, fail=True))
    (d / "hand.jpg").write_bytes(image([{"text": "scribbled" * 2, "conf": 0.5, "x1": 10 * k, "x2": 10 * k + 9} for k in range(3)], edge=30.0, fail=True))
    (d / "a.docx").write_bytes(docx(["one", "two"], [], {"i1.png": image(LINE[:1], blind=True)}))
    (d / "b.pptx").write_bytes(pptx([("first", None), ("second", image(LINE[:1]))]))
    (d / "bad.docx").write_bytes(b"no zip")
    (d / "native.pdf").write_bytes(b"native")
    (d / "scan.pdf").write_bytes(b"scan")
    (d / "old.doc").write_bytes(b"x")
    (d / "no.txt").write_bytes(b"x")
    readers = Readers(
        pdf_text=lambda c, n: ["x" * 200, "", "later"][:n] if c == b"native" else ["short"], pdf_images=lambda c, n, dpi: [image(LINE[:1]), image(LINE[1:2]), image([])],
        convert=lambda c, s: b"native",
    )
    rows = analyze(spark, str(d), first, second, readers, max_pages=2)
    assert envelope(rows).first()["count"] == 10
    return {r["path"].split("/in0/")[-1]: r for r in rows.collect()}


def test_tagged_page(found):
    r = found["page.PNG"]
    assert r["raw_json"]["meta"]["engine_used"] == "tesseract(printed)"
    assert r["formatted_text"] == "\n<PAGE 1>\n<HEADER>\n  Head!\n<SIDEBAR>\n  side!\n<BODY>\n  hello 2! world!   |   far!\n<FOOTER>\n  foot!"
    page = r["raw_json"]["pages"][0]
    assert page["text"] == "Head!\nside! hello2! world! far!\nfoot!" == r["raw_json"]["text"]
    assert [(x["text"], x["bbox"]) for x in page["lines"]][1] == ("side! hello2! world! far!", [10, 500, 1100, 522]) and len(page["lines"][1]["words"]) == 4
    assert (page["width"], page["height"]) == (1600, 1000) and r["raw_json"]["debug"][0]["words_count"] == 6
    assert found["sub/page.PNG"]["formatted_text"] == "\n<PAGE 1>"


def test_routing(found):
    assert found["hand.jpg"]["raw_json"]["meta"]["engine_used"] == "paddleocr(handwritten)" and found["hand.jpg"]["error"] is None
    assert found["fail.jpg"]["raw_json"]["meta"]["engine_used"] == "paddleocr(conf_low_fallback)" and "no engine" in found["fail.jpg"]["error"]


def test_office(found):
    a, b = found["a.docx"]["raw_json"], found["b.pptx"]["raw_json"]
    assert [p["text"] for p in a["pages"]] == ["one\ntwo", "Head"] and a["text"] == "one\ntwo\n\nHead"
    assert found["a.docx"]["formatted_text"] == "\n<PAGE 1>\n\n<PAGE 2>\n<HEADER>\n  Head"
    assert [p["text"] for p in b["pages"]] == ["first", "second\nHead!"] and b["meta"]["preset_used"] == "clean_doc"
    assert "BadZipFile" in found["bad.docx"]["error"] and found["bad.docx"]["formatted_text"] == "<BODY>"


def test_pdf(found):
    n, s = found["native.pdf"]["raw_json"], found["scan.pdf"]["raw_json"]
    assert n["meta"]["digital_pdf"] and [len(p["text"]) for p in n["pages"]] == [200, 0] and n["meta"]["engine_used"] is None
    assert not s["meta"]["digital_pdf"] and [p["text"] for p in s["pages"]] == ["Head!", "world!"]
    assert found["old.doc"]["raw_json"]["meta"]["input_type"] == "pdf"


def test_forced_and_spelling(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(image([{"text": "wrold7", "x1": 800, "x2": 830, "y1": 500, "y2": 520}, {"text": "Firewall", "x1": 840, "x2": 860, "y1": 500, "y2": 520}], fail=True))
    words = spark.createDataFrame([("world", 9), ("wild", 90)], "term string, freq long")
    r = analyze(spark, str(tmp_path), first, second, dictionary=words, engine=" PADDLE ", return_debug=False, native_text_body=True).first()
    assert r["raw_json"]["meta"]["engine_used"] == "paddleocr(forced)" and r["error"] is None and "debug" not in r["raw_json"].asDict()
    assert r["formatted_text"] == "\n<PAGE 1>\n<BODY>\n  world 7 View all"
