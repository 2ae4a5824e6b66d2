"""Page files, where a page library (``pymupdf``) is installed. It is optional and not in the test box.

Reading gives words with boxes; the text is the words of a page joined by spaces and pages by blank
lines, so that ``operators.boxes`` can place spans. Rewriting removes glyphs and image pixels under
the inset rectangles and all metadata.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

WORDS = "path string, text string, has_metadata boolean, error string, words array<struct<start:int,end:int,page:int,x0:double,y0:double,x1:double,y1:double>>"


def available() -> bool:
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        return False
    return True


def read_pages(content: bytes) -> dict:
    """Text, word boxes and whether any metadata is set. Encrypted files are an error, not a skip."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        if doc.needs_pass:
            return {"text": None, "has_metadata": False, "error": "encrypted", "words": []}
        pages, words, at = [], [], 0
        for number, page in enumerate(doc):
            found = [w for w in page.get_text("words") if w[4]]
            for k, (x0, y0, x1, y1, word, *_) in enumerate(found):
                at += k > 0
                words.append({"start": at, "end": at + len(word), "page": number, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
                at += len(word)
            pages.append(" ".join(w[4] for w in found))
            at += 2
        kept = {k: v for k, v in (doc.metadata or {}).items() if k not in ("format", "encryption") and v and str(v).strip()}
        return {"text": "\n\n".join(pages), "has_metadata": bool(kept or (doc.get_xml_metadata() or "").strip()), "error": None, "words": words}


def extract_pdf(files: DataFrame) -> DataFrame:
    """path, content of page files -> path, text, has_metadata, error, words."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append({"path": path} | read_pages(bytes(content)))
                except Exception as e:  # one broken file must not end the job; it is answered as an error
                    rows.append({"path": path, "text": None, "has_metadata": False, "error": f"{type(e).__name__}: {e}", "words": []})
            yield pd.DataFrame(rows, columns=["path", "text", "has_metadata", "error", "words"])

    return files.select("path", "content").mapInPandas(run, WORDS)


def _strip(doc) -> None:
    """What a file tells besides its pages: information, XMP, attached files, and per page links, notes and thumbnails."""
    doc.set_metadata({})
    doc.del_xml_metadata()
    for name in list(doc.embfile_names()):
        doc.embfile_del(name)
    doc.set_toc([])
    catalog = doc.pdf_catalog()
    for key in ("OpenAction", "AA", "Names", "AcroForm", "PieceInfo"):  # scripts, forms, private data
        if doc.xref_get_key(catalog, key)[0] != "null":
            doc.xref_set_key(catalog, key, "null")
    for page in doc:
        for link in page.get_links():
            page.delete_link(link)
        for note in list(page.annots()):
            page.delete_annot(note)
        for key in ("Thumb", "AA", "Metadata"):
            doc.xref_set_key(page.xref, key, "null")


def redact_pages(content: bytes, rectangles: list[dict]) -> bytes:
    """The file without what lies under the rectangles (page, x0, y0, x1, y1), and without what it tells besides its pages."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        if doc.needs_pass:
            raise ValueError("encrypted")
        _strip(doc)
        for number, page in enumerate(doc):
            own = [r for r in rectangles if r["page"] == number]
            for r in own:
                page.add_redact_annot(pymupdf.Rect(r["x0"], r["y0"], r["x1"], r["y1"]), fill=(0, 0, 0))
            if own:
                page.apply_redactions(images=pymupdf.PDF_REDACT_IMAGE_PIXELS)
        return doc.tobytes(garbage=4, deflate=True)


def redact_pdf(files: DataFrame, rectangles: DataFrame) -> DataFrame:
    """path, content with rectangles by path -> path, redacted (bytes), error. A file without any keeps its pages and loses what
    it tells besides; an encrypted or broken one is answered with its error, and nothing of it is given out."""
    ship(files.sparkSession)
    boxes = F.to_json(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1")))  # one document's own boxes
    joined = files.select("path", "content").join(rectangles.groupBy("path").agg(boxes.alias("boxes")), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, told in zip(b["path"], b["content"], b["boxes"], strict=True):
                try:
                    rows.append((path, redact_pages(bytes(content), json.loads(told) if isinstance(told, str) else []), None))
                except Exception as e:  # one broken file must not end the job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "redacted", "error"])

    return joined.mapInPandas(run, "path string, redacted binary, error string")
