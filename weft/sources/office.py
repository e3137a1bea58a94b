"""Office packages: text units of documents, sheets and slides, and write-back of translated units.

Only the zip container and the element tree are used.  Formatting of a paragraph survives as inline
tags: the widest run is plain, every other run of its own format is wrapped in ``<gN>``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# Name spaces of the package format.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}
RELATED = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Bytes that the parts of a package may hold unpacked; one that holds more is not read.
MOST_BYTES = 1 << 30
SCHEMA = "path string, unit_key string, kind string, location string, order_index int, text string"
for _prefix, _uri in NS.items():
    ET.register_namespace(_prefix, _uri)


def _q(name: str) -> str:
    prefix, _, local = name.partition(":")
    return f"{{{NS[prefix]}}}{local}"


def _run_text(run: ET.Element) -> str:
    out = []
    for x in run:
        kind = x.tag.rpartition("}")[2]
        out.append(x.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "-" if kind == "noBreakHyphen" else "")
    return "".join(out)


def _groups(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring runs of one format put together; runs without text are left out."""
    out: list[list[str]] = []
    for sign, text in runs:
        if not text:
            continue
        if out and out[-1][0] == sign:
            out[-1][1] += text
        else:
            out.append([sign, text])
    return [(a, b) for a, b in out]


def tagged(groups: list[tuple[str, str]]) -> str:
    """Text of a paragraph: the longest group plain, the others in numbered tags, the first of equally long ones plain."""
    if not groups:
        return ""
    plain = max(range(len(groups)), key=lambda i: (len(groups[i][1]), -i))
    out, n = [], 0
    for i, (_, text) in enumerate(groups):
        if i == plain:
            out.append(text)
        else:
            n += 1
            out.append(f"<g{n}>{text}</g{n}>")
    return "".join(out)


def _word_paragraph(p: ET.Element) -> list[tuple[ET.Element, str, str]]:
    out = []
    for r in p.iter(_q("w:r")):
        props = r.find(_q("w:rPr"))
        out.append((r, ET.tostring(props).decode() if props is not None else "", _run_text(r)))
    return out


def _slide_paragraph(p: ET.Element) -> list[tuple[ET.Element, str, str]]:
    out = []
    for r in p:
        if r.tag == _q("a:r"):
            props, t = r.find(_q("a:rPr")), r.find(_q("a:t"))
            out.append((r, ET.tostring(props).decode() if props is not None else "", (t.text or "") if t is not None else ""))
        elif r.tag == _q("a:br"):
            out.append((r, "", "\n"))
    return out


def _word_parts(names: list[str]) -> list[tuple[str, str]]:
    body = [(n, "body") for n in names if n == "word/document.xml"]
    rest = [(n, re.sub(r"\d*\.xml$", "", n.rpartition("/")[2])) for n in sorted(names) if re.fullmatch(r"word/(?:header|footer|footnotes|endnotes|comments)\d*\.xml", n)]
    return body + rest


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return [tagged(_groups([("" if r is si else ET.tostring(x).decode() if (x := r.find(_q("s:rPr"))) is not None else "", "".join(t.text or "" for t in r.iter(_q("s:t")))) for r in (si.findall(_q("s:r")) or [si])])) for si in root.findall(_q("s:si"))]


def related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, part) of what a part refers to inside the package; the kind is the last word of its type."""
    folder, _, name = part.rpartition("/")
    listing = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if listing not in z.namelist():
        return {}
    out = {}
    for x in ET.fromstring(z.read(listing)).iter(f"{{{RELATED}}}Relationship"):
        if x.get("TargetMode") != "External":
            target = x.get("Target", "")
            steps: list[str] = [] if target.startswith("/") else folder.split("/") if folder else []
            for step in target.strip("/").split("/"):
                steps = steps[:-1] if step == ".." else steps if step == "." else [*steps, step]
            out[x.get("Id", "")] = (x.get("Type", "").rpartition("/")[2], "/".join(steps))
    return out


def _listed(z: zipfile.ZipFile, main: str, item: str) -> list[tuple[str, str]]:
    """(part, name) of the sheets or slides that a main part lists, in its order; none without it."""
    if main not in z.namelist():
        return []
    links = related(z, main)
    rows = [(links.get(x.get(_q("r:id"), ""), ("", ""))[1], x.get("name", "")) for x in ET.fromstring(z.read(main)).iter(_q(item))]
    return [(part, name or part) for part, name in rows if part in z.namelist()]


def _numbered(names: list[str], pattern: str) -> list[tuple[str, str]]:
    """Parts of a pattern by their numbers, for packages whose main part lists none."""
    return [(n, n) for n in sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))]


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    return _listed(z, "xl/workbook.xml", "s:sheet") or _numbered(z.namelist(), r"xl/worksheets/sheet\d+\.xml")


def slides(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(part, kind) of the slides in the order of the presentation, each followed by its notes."""
    out = []
    for part, _ in _listed(z, "ppt/presentation.xml", "p:sldId") or _numbered(z.namelist(), r"ppt/slides/slide\d+\.xml"):
        notes = [to for kind, to in related(z, part).values() if kind == "notesSlide"]
        if not notes and (same := part.replace("slides/slide", "notesSlides/notesSlide")) in z.namelist():
            notes = [same]
        out += [(part, "paragraph"), *((n, "notes") for n in notes if n in z.namelist())]
    return out


def read(path: str, fmt: str, content: bytes) -> list[tuple[str, str, str, str, int, str]]:
    """Units (path, unit_key, kind, location, order_index, text) of one package; blank paragraphs, formulas and numbers are none.

    Sheets and slides come in the order that the workbook or the presentation lists them; a cell's
    location names its sheet; comments follow the cells of their sheet, notes their slide.
    """
    out: list[tuple[str, str, str, str, int, str]] = []

    def add(key: str, kind: str, place: str, text: str) -> None:
        if text.strip():
            out.append((path, key, kind, place, len(out), text))

    def whole(x: ET.Element) -> str:
        return "".join(t.text or "" for t in x.iter(_q("s:t")))

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("the package is too large unpacked")
        names = z.namelist()
        if fmt == "docx":
            for part, kind in _word_parts(names):
                root = ET.fromstring(z.read(part))
                cells = {id(p) for c in root.iter(_q("w:tc")) for p in c.iter(_q("w:p"))}
                for k, p in enumerate(root.iter(_q("w:p"))):
                    add(f"docx:{part}:p:{k:05d}", "cell" if id(p) in cells else "paragraph" if kind == "body" else kind, kind, tagged(_groups([(a, b) for _, a, b in _word_paragraph(p)])))
        elif fmt == "xlsx":
            strings, used = _shared(z), set()
            for part, name in sheets(z):
                for c in ET.fromstring(z.read(part)).iter(_q("s:c")):
                    if c.find(_q("s:f")) is not None:
                        continue
                    v = c.find(_q("s:v"))
                    if c.get("t") == "s" and v is not None:
                        i = int(v.text)
                        if i not in used and i < len(strings):
                            used.add(i)
                            add(f"xlsx:sst:{i:06d}", "cell", f"{name}!{c.get('r')}", strings[i])
                    elif c.get("t") == "inlineStr":
                        add(f"xlsx:{part}:{c.get('r')}", "cell", f"{name}!{c.get('r')}", whole(c))
                for kind, to in related(z, part).values():
                    if kind == "comments" and to in names:
                        for c in ET.fromstring(z.read(to)).iter(_q("s:comment")):
                            add(f"xlsx:{to}:{c.get('ref')}", "comment", f"{name}!{c.get('ref')}", whole(c))
            for i, text in enumerate(strings):
                if i not in used:
                    add(f"xlsx:sst:{i:06d}", "unreferenced", "", text)
        elif fmt == "pptx":
            for part, kind in slides(z):
                for k, p in enumerate(ET.fromstring(z.read(part)).iter(_q("a:p"))):
                    if p.find(_q("a:fld")) is None:
                        add(f"pptx:{part}:p:{k:05d}", kind, part, tagged(_groups([(a, b) for _, a, b in _slide_paragraph(p)])))
    return out


#: What keeps a package from being read, by the error it raises.
REASONS = {zipfile.BadZipFile: "no package", ET.ParseError: "broken part", KeyError: "missing part", ValueError: "too large or broken"}


def units(files: DataFrame) -> DataFrame:
    """Text units of all office files of ``files(path, fmt, content)``.  Packages that cannot be read give none; ``failures`` names them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, fmt, content in zip(pdf["path"], pdf["fmt"], pdf["content"]):
                try:
                    rows += read(path, fmt, content)
                except tuple(REASONS):
                    continue
            yield pd.DataFrame(rows, columns=["path", "unit_key", "kind", "location", "order_index", "text"]).astype({"order_index": "int32"})

    return files.where("fmt IN ('docx', 'xlsx', 'pptx')").select("path", "fmt", "content").mapInPandas(run, SCHEMA)


def failures(files: DataFrame) -> DataFrame:
    """(path, reason) of the files that give no units: of a format not supported, or a package that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, fmt, content in zip(pdf["path"], pdf["fmt"], pdf["content"]):
                try:
                    read(path, fmt, content)
                except tuple(REASONS) as e:
                    rows.append((path, next(v for k, v in REASONS.items() if isinstance(e, k))))
            yield pd.DataFrame(rows, columns=["path", "reason"]).astype(object)

    unknown = files.where("fmt IS NULL").selectExpr("path", "'unsupported format' AS reason")
    return unknown.unionByName(files.where("fmt IN ('docx', 'xlsx', 'pptx')").select("path", "fmt", "content").mapInPandas(run, "path string, reason string"))


TAGGED = re.compile(r"<g(\d+)>(.*?)</g\1>", re.S)


def _pieces(target: str, count: int) -> list[tuple[int, str]] | None:
    """(group, text) of a tagged answer, group 0 the plain one; None where tags are missing or foreign."""
    out, at, seen = [], 0, set()
    for m in TAGGED.finditer(target):
        if m.start() > at:
            out.append((0, target[at : m.start()]))
        out.append((int(m[1]), m[2]))
        seen.add(int(m[1]))
        at = m.end()
    if at < len(target):
        out.append((0, target[at:]))
    return out if seen == set(range(1, count)) else None


def _rewrite(runs: list[tuple[ET.Element, str, str]], target: str, put) -> None:
    """Put the answer into the runs: each group's text into its first run, the rest of its runs emptied.

    Where the tags do not fit the groups, all text goes into the longest group: format may be lost, text never.
    """
    groups: list[list[int]] = []
    for k, (_, sign, text) in enumerate(runs):
        if not text:
            continue
        if groups and runs[groups[-1][-1]][1] == sign:
            groups[-1].append(k)
        else:
            groups.append([k])
    if not groups:
        return
    sizes = [sum(len(runs[k][2]) for k in g) for g in groups]
    plain = max(range(len(groups)), key=lambda i: (sizes[i], -i))
    number = {}
    for i in range(len(groups)):
        number[0 if i == plain else len([j for j in range(i + 1) if j != plain])] = i
    pieces = _pieces(target, len(groups))
    texts = [""] * len(groups)
    if pieces is None:
        texts[plain] = re.sub(r"</?g\d+>", "", target)
    else:
        for n, text in pieces:
            texts[number[n]] += text
    for g, text in zip(groups, texts):
        for k in g:
            put(runs[k][0], text if k == g[0] else "")


def _put_word(run: ET.Element, text: str) -> None:
    for x in [x for x in run if x.tag.rpartition("}")[2] in ("t", "tab", "br", "cr", "noBreakHyphen")]:
        run.remove(x)
    t = ET.SubElement(run, _q("w:t"))
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _put_slide(run: ET.Element, text: str) -> None:
    t = run.find(_q("a:t"))
    if t is not None:
        t.text = text


def write(fmt: str, content: bytes, targets: dict[str, str]) -> bytes:
    """The package with units replaced by ``targets`` (unit_key -> answer); parts without one are copied byte for byte."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        new: dict[str, bytes] = {}
        by: dict[str, dict[int, str]] = {}
        for key, text in targets.items():
            m = re.fullmatch(r"(?:docx|pptx):(.+):p:(\d+)", key)
            if m:
                by.setdefault(m[1], {})[int(m[2])] = text
        for part, own in by.items():
            root = ET.fromstring(z.read(part))
            for k, p in enumerate(root.iter(_q("w:p") if fmt == "docx" else _q("a:p"))):
                if k in own:
                    _rewrite(*((_word_paragraph(p), own[k], _put_word) if fmt == "docx" else (_slide_paragraph(p), own[k], _put_slide)))
            new[part] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
        strings = {int(k.rpartition(":")[2]): t for k, t in targets.items() if k.startswith("xlsx:sst:")}
        if strings:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for i, si in enumerate(root.findall(_q("s:si"))):
                if i in strings:
                    for x in list(si):
                        si.remove(x)
                    ET.SubElement(si, _q("s:t")).text = re.sub(r"</?g\d+>", "", strings[i])
            new["xl/sharedStrings.xml"] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for item in z.infolist():
                w.writestr(item, new.get(item.filename, z.read(item.filename)))
    return out.getvalue()


def rebuilt(files: DataFrame, translations: DataFrame) -> DataFrame:
    """(path, content): office files with their translations put back; ``translations(path, unit_key, target)``.

    The files are joined with one map of answers each; a file without answers comes back as it is.
    """
    from pyspark.sql import functions as F

    maps = translations.where(F.col("target").isNotNull()).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("unit_key", "target"))).alias("targets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [write(f, c, dict(t)) if t is not None and len(t) else c for f, c, t in zip(pdf["fmt"], pdf["content"], pdf["targets"])]
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    office = files.where("fmt IN ('docx', 'xlsx', 'pptx')").join(maps, "path", "left")
    return office.select("path", "fmt", "content", "targets").mapInPandas(run, "path string, content binary")
