import io
import zipfile


def docx(texts, pictures, contents=()):
    """A minimal word file with paragraphs and pictures (names, or names with their bytes)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        for name, data in {**dict.fromkeys(pictures, b"picture"), **dict(contents)}.items():
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()
