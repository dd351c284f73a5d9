"""Text and sections of files of many formats.

``extracted`` routes files by type to an extractor in one Arrow pass. A file
that cannot be read gives a row with ``error`` and no text; the scan goes on.
Extractors use the standard library; PDF and legacy DOC need optional programs
and give an error without them.
"""

from __future__ import annotations

import hashlib
import html as html_
import io
import json
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

MB = 1 << 20
#: Largest file of each type, and of what a packed file may unfold to.
CAPS = {"md": 2 * MB, "txt": 5 * MB, "html": 10 * MB, "htm": 10 * MB, "docx": 25 * MB, "odt": 25 * MB, "rtf": 25 * MB, "doc": 25 * MB, "epub": 50 * MB, "pdf": 100 * MB}
INFLATED = 100 * MB

SECTION = pa.struct([("text", pa.string()), ("page", pa.int32()), ("heading", pa.string()), ("order", pa.int32())])
ARROW = pa.schema([
    ("path", pa.string()), ("format", pa.string()), ("title", pa.string()), ("text", pa.string()), ("content_hash", pa.string()), ("file_hash", pa.string()),
    ("size_bytes", pa.int64()), ("metadata", pa.map_(pa.string(), pa.string())), ("sections", pa.list_(SECTION)), ("error", pa.string()),
])
SCHEMA = "path string, format string, title string, text string, content_hash string, file_hash string, size_bytes long, metadata map<string,string>, sections array<struct<text:string,page:int,heading:string,order:int>>, error string"

Section = tuple[str, int | None, str | None]
Found = tuple[str | None, str, list[Section], dict]


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def content_hash(text: str) -> str:
    """As ``folioscope.functions.hashing.content_hash``."""
    t = re.sub(r"\n{2,}", "\n\n", re.sub(r"[ \t]+", " ", text))
    return hashlib.sha256("\n".join(x.rstrip() for x in t.split("\n")).strip().encode()).hexdigest()


def markdown(raw: bytes, path: str) -> Found:
    text, meta = raw.decode("utf-8"), {}
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|\Z)", text, re.S)
    if m:
        loaded = yaml.safe_load(m[1])
        if isinstance(loaded, dict):
            meta, text = loaded, text[m.end() :]
    head = re.search(r"^#\s+(.+)$", text, re.M)
    return str(meta.get("title") or (head[1].strip() if head else "")) or None, text, [], meta


def plain(raw: bytes, path: str) -> Found:
    return None, raw.decode("utf-8", "replace"), [], {}


class _Page(HTMLParser):
    """Text by headings, without what is no content."""

    OUT = frozenset("script style noscript nav header footer".split())
    LEAF = frozenset("p li blockquote pre td th".split())

    def __init__(self, root: str | None):
        super().__init__(convert_charrefs=True)
        self.root, self.depth, self.out = root, 0 if root else 1, 0
        self.title, self.h1, self.heading = "", "", None
        self.sections: list[list] = [[None, []]]
        self.text: list[str] = []
        self.where: list[str] = []

    def _block(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.sections[-1][1].append(t)

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.where.append(tag)
        elif tag in self.OUT:
            self.out += 1
        elif tag == self.root:
            self.depth += 1
        elif self.depth and not self.out:
            if re.fullmatch("h[1-6]", tag):
                self._block()
                self.where.append(tag)
            elif tag in self.LEAF or tag in ("div", "section", "br", "tr", "ul", "ol"):
                self._block()

    def handle_endtag(self, tag):
        if tag in self.OUT:
            self.out = max(0, self.out - 1)
        elif tag == self.root:
            self._block()
            self.depth = max(0, self.depth - 1)
        elif self.where and tag == self.where[-1]:
            self.where.pop()
            if tag != "title":
                t = " ".join("".join(self.text).split())
                self.text = []
                self.h1 = self.h1 or (t if tag == "h1" else "")
                self.sections.append([t, []])
        elif self.depth and not self.out and (tag in self.LEAF or tag in ("div", "section")):
            self._block()

    def handle_data(self, data):
        if self.where and self.where[-1] == "title":
            self.title += data
        elif self.depth and not self.out:
            self.text.append(data)


def web_page(raw: bytes, path: str) -> Found:
    text = raw.decode("utf-8", "replace")
    root = next((r for r in ("main", "article", "body") if re.search(rf"<{r}[\s>]", text, re.I)), None)
    p = _Page(root)
    p.feed(text)
    p.close()
    p._block()
    sections = [("\n".join(b), None, h) for h, b in p.sections if b]
    body = "\n\n".join(t if h is None else f"{h}\n{t}" for t, _, h in sections)
    return html_.unescape(p.title).strip() or p.h1 or None, body, sections, {}


def safe_xml(raw: bytes) -> ElementTree.Element:
    """Parsed XML without document types or entities."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("document types and entities are not read")
    return ElementTree.fromstring(raw)


def member(z: zipfile.ZipFile, name: str, most: int = INFLATED) -> bytes:
    """A packed file, read up to a bound whatever its header says."""
    with z.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{name} unfolds to more than {most} bytes")
    return data


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _by_heading(parts: list[tuple[bool, str]]) -> list[Section]:
    out: list[list] = [[None, []]]
    for heading, t in parts:
        if heading:
            out.append([t, []])
        elif t.strip():
            out[-1][1].append(t)
    return [("\n".join(b), None, h) for h, b in out if b]


def _joined(sections: list[Section]) -> str:
    return "\n\n".join(t if h is None else f"{h}\n{t}" for t, _, h in sections)


def word(raw: bytes, path: str) -> Found:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        doc = safe_xml(member(z, "word/document.xml"))
        meta = {_tag(e): e.text for e in safe_xml(member(z, "docProps/core.xml")) if e.text} if "docProps/core.xml" in z.namelist() else {}
    parts = []
    for p in doc.iter():
        if _tag(p) == "p":
            style = next((_attr(e, "val") or "" for e in p.iter() if _tag(e) == "pStyle"), "")
            parts.append((bool(re.match(r"(?i)heading\s*\d", style)), "".join(e.text or "" for e in p.iter() if _tag(e) == "t")))
    s = _by_heading(parts)
    return meta.get("title"), _joined(s), s, meta


def open_text(raw: bytes, path: str) -> Found:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        doc = safe_xml(member(z, "content.xml"))
        meta = {_tag(e): e.text for e in safe_xml(member(z, "meta.xml")).iter() if e.text and e.text.strip()} if "meta.xml" in z.namelist() else {}
    body = next((e for e in doc.iter() if _tag(e) == "text" and "office" in e.tag), doc)
    parts = []
    for e in body:
        if _tag(e) in ("h", "p"):
            parts.append((_tag(e) == "h", "".join(e.itertext())))
        elif _tag(e) == "list":
            parts += [(False, "".join(p.itertext())) for p in e.iter() if _tag(p) == "p"]
    s = _by_heading(parts)
    return meta.get("title"), _joined(s), s, meta


def e_book(raw: bytes, path: str) -> Found:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        opf = next(_attr(e, "full-path") for e in safe_xml(member(z, "META-INF/container.xml")).iter() if _tag(e) == "rootfile")
        package = safe_xml(member(z, opf))
        folder = opf.rpartition("/")[0]
        items = {_attr(e, "id"): _attr(e, "href") for e in package.iter() if _tag(e) == "item"}
        title = next((e.text for e in package.iter() if _tag(e) == "title" and e.text), None)
        s: list[Section] = []
        for ref in (e for e in package.iter() if _tag(e) == "itemref"):
            href = items.get(_attr(ref, "idref"))
            if href:
                t, body, _, _ = web_page(member(z, f"{folder}/{href}" if folder else href), href)
                head = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", member(z, f"{folder}/{href}" if folder else href).decode("utf-8", "replace"))
                if body.strip():
                    s.append((body, None, " ".join(re.sub(r"<[^>]+>", " ", head[1]).split()) if head else t))
    return title, "\n\n".join(t for t, _, _ in s), s, {}


def rich_text(raw: bytes, path: str) -> Found:
    if not raw.startswith(b"{\\rtf"):
        raise ValueError("no rich text")
    out, stack, skip = [], [], False
    text = raw.decode("latin-1")
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator"}
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", text, re.S):
        code, uni, control, _, symbol, brace, run = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or control in hidden:
            skip = True
        elif skip:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif control in ("par", "line"):
            out.append("\n")
        elif control == "tab":
            out.append("\t")
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif run:
            out.append(run)
    return None, "".join(out).strip(), [], {}


def portable(raw: bytes, path: str) -> Found:
    try:
        import pypdf
    except ImportError:
        raise ValueError("no PDF engine is installed") from None
    reader = pypdf.PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        raise ValueError("encrypted")
    s = [(t, k + 1, None) for k, p in enumerate(reader.pages) if (t := (p.extract_text() or "").strip())]
    meta = {str(k).lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}
    first = s[0][0].split("\n")[0].strip() if s else ""
    return meta.get("Title") or (first if 3 <= len(first) <= 120 else None), "\n\n".join(t for t, _, _ in s), s, meta


def legacy_word(raw: bytes, path: str) -> Found:
    program = shutil.which("antiword")
    if not program:
        raise ValueError("antiword is not installed")
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(raw)
        f.flush()
        done = subprocess.run([program, f.name], capture_output=True, timeout=30, check=True)
    return None, done.stdout.decode("utf-8", "replace"), [], {}


#: Extractors by type; ``register`` adds to it.
EXTRACTORS: dict[str, Callable[[bytes, str], Found]] = {
    "md": markdown, "txt": plain, "html": web_page, "htm": web_page, "docx": word, "odt": open_text, "epub": e_book, "rtf": rich_text, "pdf": portable, "doc": legacy_word,
}


def register(extension: str, extractor: Callable[[bytes, str], Found]) -> None:
    EXTRACTORS[extension.lower().lstrip(".")] = extractor


def extract(path: str, kind: str | None, raw: bytes) -> dict:
    """One file as a row; unknown types are read as Markdown."""
    kind = (kind or "").lower()
    known = kind if kind in EXTRACTORS else "md"
    row = dict.fromkeys(ARROW.names) | {"path": path, "format": known, "file_hash": hashlib.sha256(raw).hexdigest(), "size_bytes": len(raw), "metadata": [], "sections": []}
    try:
        if len(raw) > CAPS.get(known, 2 * MB):
            raise ValueError(f"larger than {CAPS.get(known, 2 * MB)} bytes")
        title, text, sections, meta = EXTRACTORS[known](raw, path)
        meta = [(str(k), v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in meta.items()]
        return row | {
            "title": title or stem(path), "text": text, "content_hash": content_hash(text), "metadata": meta,
            "sections": [{"text": t, "page": p, "heading": h, "order": k} for k, (t, p, h) in enumerate(sections)],
        }
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file, the others are read
        return row | {"error": f"{type(e).__name__}: {e}"[:500]}


def extracted(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` from (path, ext, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ext, raw in zip(b.column("path").to_pylist(), b.column("ext").to_pylist(), b.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([extract(path, ext, raw.as_py() or b"")], schema=ARROW)

    return files.select("path", "ext", "content").mapInArrow(run, SCHEMA)
