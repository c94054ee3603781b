"""HTML pages to documents. Tree building needs a parser, so this is the library's one Python function (mapInArrow)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values.
BOILERPLATE = {"script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "header", "aside", "form"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "figcaption", "dt", "dd", "td", "th", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end an open paragraph.
CLOSE_P = BLOCKS | {"div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "footer", "header", "aside", "form", "hr", "fieldset", "figure"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
MAX_LINKS, MAX_DEPTH = 100, 8


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.kids)
        return "".join(out)


class Builder(HTMLParser):
    """A small tree builder with implied end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        n = self.at
        while n.up is not None and n.tag not in stop:
            if n.tag in tags:
                self.at = n.up
                return
            n = n.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSE_P:
            self._close({"p"}, {"td", "th", "button", "object"})
        if tag in SAME_LEVEL:
            self._close(SAME_LEVEL[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.up is not None:
            if n.tag == tag:
                self.at = n.up
                return
            n = n.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def squeeze(x: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[\x00-\x08\x0b-\x1f\x7f]", " ", x)).strip()


def _dropped(n: Node) -> bool:
    return n.tag in BOILERPLATE or n.attrs.get("role") == "navigation" or n.attrs.get("aria-hidden") == "true" or "hidden" in n.attrs


def _prune(n: Node) -> None:
    for x in n.walk():
        x.kids = [k for k in x.kids if isinstance(k, str) or not _dropped(k)]


def _container(root: Node) -> Node:
    nodes = list(root.walk())
    for test in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main"):
        if found := next((n for n in nodes if test(n)), None):
            return found
    best, most = None, 0
    for n in nodes:
        if n.tag == "div" and (size := sum(len(squeeze(p.text())) for p in n.walk() if p.tag == "p")) > most:
            best, most = n, size
    return best or next((n for n in nodes if n.tag == "body"), root)


def _block_lines(n: Node) -> list[str]:
    """One line for each block; a block inside an emitted block isn't emitted again."""
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if x.tag in BLOCKS:
            if line := squeeze(x.text()):
                out.append(line)
                continue
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def _absolute(href: str, base: str) -> str | None:
    try:
        url = urldefrag(urljoin(base, href.strip())).url
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def _dates(x, keys: set[str], depth: int = 0) -> list[str]:
    if depth > MAX_DEPTH:
        return []
    if isinstance(x, list):
        return [d for y in x for d in _dates(y, keys, depth + 1)]
    if not isinstance(x, dict):
        return []
    return [d for k, v in x.items() for d in ([v] if k.lower() in keys and isinstance(v, str) else _dates(v, keys, depth + 1))]


_TITLE, _OPEN = re.compile(r"(<title\b[^>]*>)([^<]*)", re.IGNORECASE), re.compile(r"&(?!#?[A-Za-z0-9]+;)")


def closed_references(html: str) -> str:
    """The page with each & of a title that begins no reference closed by a semicolon written out: it stays what it is, where
    HTML also takes some names without one for references (as at the end of a title that was cut within one)."""
    return _TITLE.sub(lambda m: m[1] + _OPEN.sub("&amp;", m[2]), html)


def extract(html: str | None, url: str | None, closed: bool = False) -> dict:
    """Everything of one page; never raises. A null page is an empty one. closed: see closed_references()."""
    b = Builder()
    if closed and html:
        html = closed_references(html)
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # a tokenizer error ends the page where it stands
        pass
    root, base = b.root, url or ""
    nodes = list(root.walk())
    metas = [n.attrs for n in nodes if n.tag == "meta"]
    og: dict[str, str] = {}
    for kind in ("property", "name"):
        for m in metas:
            key = m.get(kind, "").strip().lower()
            if key.startswith("og:") and (v := squeeze(m.get("content", ""))):
                og.setdefault(key[3:], v)
    meta = lambda kind, key: next((v for m in metas if m.get(kind, "").strip().lower() == key and (v := squeeze(m.get("content", "")))), None)
    ld = []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                ld.append(json.loads(re.sub(r"^\s*<!--|-->\s*$", "", n.text())))
            except ValueError:
                continue
    title = next((squeeze(n.text()) for n in nodes if n.tag == "title"), "") or og.get("title")
    lang = next((n.attrs.get("lang", "").strip() for n in nodes if n.tag == "html"), "") or None
    canonical = next((n.attrs.get("href", "") for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()), None)
    time = next((n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")), None)
    published = [*(d for x in ld for d in _dates(x, {"datepublished"})), meta("property", "article:published_time"), meta("name", "date"), time]
    modified = [*(d for x in ld for d in _dates(x, {"datemodified"})), meta("property", "article:modified_time")]
    description = meta("name", "description")
    _prune(root)
    box = _container(root)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    lines = _block_lines(box) or _block_lines(body) or [s for x in body.text().split("\n") if (s := squeeze(x))]
    text = "\n".join(lines)
    links = list(dict.fromkeys(u for n in box.walk() if n.tag == "a" and n.attrs.get("href") and (u := _absolute(n.attrs["href"], base))))[:MAX_LINKS]
    try:
        host = urlsplit(base).hostname
    except ValueError:
        host = None
    return {
        "title": title or None,
        "description": description if description is not None else og.get("description"),
        "canonical_url": _absolute(canonical, base) if canonical else None,
        "language": lang,
        "published_raw": [d for d in published if d],
        "modified_raw": [d for d in modified if d],
        "publisher": og.get("site_name") or meta("name", "application-name") or host,
        "open_graph": og,
        "json_ld": [json.dumps(x, ensure_ascii=False) for x in ld],
        "headings": [{"level": int(n.tag[1]), "text": s} for n in box.walk() if n.tag in ("h1", "h2", "h3") and (s := squeeze(n.text()))],
        "main_text": text,
        "word_count": len(text.split()),
        "content_hash": hashlib.sha256(text.encode()).hexdigest(),
        "links": links,
    }


FIELDS = (
    "title string, description string, canonical_url string, language string, published_raw array<string>, modified_raw array<string>, publisher string, open_graph map<string,string>, "
    "json_ld array<string>, headings array<struct<level:int,text:string>>, main_text string, word_count int, content_hash string, links array<string>"
)


def _first_date(raw):
    """First usable date of a list: at least four digits, years 1800 to 2200, UTC. ISO, RFC 2822 and `Month D, YYYY`."""
    forms = ["yyyy-MM-dd'T'HH:mm[XXX][XX]", "d MMM yyyy HH:mm:ss Z", "MMMM d, yyyy"]
    #: Without a weekday, and with a numeric zone for those that mean UTC.
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^[A-Za-z]{3,9}, +(?=[0-9])", ""), " (GMT|UTC|UT|Z)$", " +0000")
    parsed = F.transform(raw, lambda x: F.when(x.rlike("\\d{4}"), F.coalesce(F.when(x.rlike("^\\s*\\d{4}-"), F.try_to_timestamp(F.trim(x))), *[F.try_to_timestamp(plain(x), F.lit(f)) for f in forms])))
    return F.get(F.filter(parsed, lambda t: t.isNotNull() & F.year(t).between(1800, 2200)), F.lit(0))


def extract_documents(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", closed: bool = False) -> DataFrame:
    """`keep` columns and the fields of extract() for each page, dates as timestamps. closed: see closed_references()."""
    use = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html"), F.col(url).alias("__url"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in use.schema.fields[:-2]], FIELDS])

    target = to_arrow_schema(StructType.fromDDL(FIELDS))

    def run(batches):
        for batch in batches:
            n = len(batch.columns) - 2
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [extract(h, u, closed) for h, u in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)]
                for m in made:
                    m["open_graph"] = list(m["open_graph"].items())
                cols = [pa.array([m[f.name] for m in made], f.type) for f in target]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names=[*part.schema.names[:n], *target.names])

    got = use.mapInArrow(run, schema)
    return got.withColumns({"published_at": _first_date(F.col("published_raw")), "modified_at": _first_date(F.col("modified_raw"))}).drop("published_raw", "modified_raw")
