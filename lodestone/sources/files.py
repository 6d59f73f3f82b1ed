"""Files of mixed formats to one row per document with its sections. A file that can't be read is a row with its error."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import pii
from lodestone.functions.store import cut
from lodestone.functions.text import FIELD_NAMES

SECTION = "struct<headings array<string>, text string, locator string, kind string>"
DOCUMENT = f"path string, source_type string, status string, error string, title string, sections array<{SECTION}>, raw_chars long, head string, updated string, version string, fingerprint string"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open element of the second kind ends where one of the first begins, at the latest within an element of the third.
_ENDS = [({"p", "ul", "ol", "table", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}, {"p"}, {"td", "th", "li", "div", "section", "article", "main", "body"}), ({"li"}, {"li"}, {"ul", "ol"}), ({"tr"}, {"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"td", "th"}, {"tr", "table"})]
# The furniture of a page, by tag, class and role.
PRUNED_TAGS = {"nav", "header", "footer", "script", "style", "noscript", "aside"}
PRUNED_CLASSES = {"cookie-banner", "promo", "site-header", "site-footer", "breadcrumbs", "share", "social"}
PRUNED_ROLES = {"navigation"}
# A line of a PDF that is a heading.
PDF_HEADING = re.compile(r"(SECTION [A-Z]\b.*|[A-Z]\.\d+\s.*|[A-Z][A-Z &-]{6,}$)")


def heading_name(h: str) -> str:
    """functions.text.standardize_heading() of one string, for loaders."""
    for old, new in (("\u00a0", " "), ("\u2019", "'"), ("\u2013", "-"), ("\u2014", "-")):
        h = h.replace(old, new)
    h = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", h)).strip()
    h = re.sub(r"(?i)^section\s+[a-z]\s*-\s*", "", h)
    if re.match(r"(?:[A-Z]|\d+)(?:\.\d+)*[.)\s-]", h):
        h = re.sub(r"(?i)^(?:section\s+)?(?:[a-z]|\d+)(?:\.\d+)*[.)\s-]+\s*", "", h)
    h = h.strip(" :-")
    return h.title() if h.isupper() else " ".join(w if w.isupper() and len(w) <= 5 else w[:1].upper() + w[1:] for w in h.split(" "))


def field_name(name: str) -> str:
    """functions.text.standardize_field_name() of one string, with blanks for underscores."""
    snake = re.sub(r"[-_ ]+", "_", re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower())
    return FIELD_NAMES.get(snake.replace("_", ""), FIELD_NAMES.get(snake, snake)).replace("_", " ")


class Element:
    """A page's element: its tag, attributes and content, strings and elements in order."""

    def __init__(self, tag: str, attrs: dict[str, str], inside: Element | None = None):
        self.tag, self.attrs, self.inside, self.content = tag, attrs, inside, []

    def all(self) -> Iterator[Element]:
        """The elements within, each before its own."""
        todo = self.content[::-1]
        while todo:
            if isinstance(x := todo.pop(), Element):
                yield x
                todo += x.content[::-1]

    def strings(self) -> Iterator[str]:
        todo = self.content[::-1]
        while todo:
            if isinstance(x := todo.pop(), Element):
                todo += x.content[::-1]
            else:
                yield x

    def text(self) -> str:
        """The strings within, stripped, with a blank between."""
        return " ".join(t for x in self.strings() if (t := x.strip()))

    def first(self, *tags: str) -> Element | None:
        return next((x for x in self.all() if x.tag in tags), None)

    def above(self, *tags: str) -> bool:
        x = self.inside
        while x is not None and x.tag not in tags:
            x = x.inside
        return x is not None


class _Tree(HTMLParser):
    """Builds the tree; furniture is left out, with all that is within. Elements left open end where the next of their kind begins."""

    def __init__(self, pruned: bool = True):
        super().__init__(convert_charrefs=True)
        self.top = self.now = Element("", {})
        self.out: Element | None = None  # the outermost element that is left out
        self.pruned, self.title = pruned, None

    def handle_starttag(self, tag, attrs):
        for begins, ends, most in _ENDS:
            if tag in begins:
                x = self.now
                while x.inside is not None and x.tag not in most | ends:
                    x = x.inside
                while x.inside is not None and x.tag in ends:
                    self._close(x)
                    x = self.now
        own = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        furniture = tag in PRUNED_TAGS or own.attrs.get("role") in PRUNED_ROLES or not PRUNED_CLASSES.isdisjoint(own.attrs.get("class", "").split())
        if self.out is None and not (self.pruned and furniture):
            self.now.content.append(own)
        if tag not in _VOID:
            self.now = own
            if self.out is None and self.pruned and furniture:
                self.out = own
        if tag == "title" and self.title is None:
            self.title = own

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, x: Element) -> None:
        y = self.now
        while y is not x.inside:
            if y is self.out:
                self.out = None
            y = y.inside
        self.now = x.inside

    def handle_endtag(self, tag):
        x = self.now
        while x.inside is not None and x.tag != tag:
            x = x.inside
        if x.inside is not None:
            self._close(x)

    def handle_data(self, data):
        if self.out is None or self.now.tag == "title":
            self.now.content.append(data)


def table_text(rows: list[list[str]]) -> str:
    """`first - header: value; ...` a row; one of another length than the header, or under a header of one cell, is joined by bars.
    Rows without cells are left out."""
    if not rows:
        return ""
    head = rows[0]
    return "\n".join(f"{r[0]} - {'; '.join(f'{h}: {v}' for h, v in zip(head[1:], r[1:]))}." if len(r) == len(head) > 1 else " | ".join(r) for r in rows[1:] if r)


def html_sections(html: str, path: str = "") -> tuple[str, list[tuple]]:
    """A section for what stands under a heading (h1 to h4): paragraphs and outer lists, an item a line; and one for each table.
    Furniture is pruned; of the rest `main`, else `body`, else all is read. Text in neither is left out."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    title = tree.title.text().split("|")[0].strip() if tree.title is not None else path.rpartition("/")[2].rpartition(".")[0]
    root = tree.top.first("main") or tree.top.first("body") or tree.top
    faq = "faq" in path.lower()
    out, stack, lines, kind, locator = [], [], [], "prose", ""

    def done() -> None:
        nonlocal lines, kind
        if lines:
            out.append((list(stack), "\n".join(lines).strip(), locator or " > ".join(stack), kind))
        lines, kind = [], "prose"

    for x in root.all():
        if x.tag in ("h1", "h2", "h3", "h4"):
            done()
            name = heading_name(x.text())
            # Levels that are missing leave no gap: a page's first h2 stays above the others.
            stack[:] = [h for h in [*stack[: int(x.tag[1]) - 1], name] if h]
            locator = x.attrs.get("id") or name
            kind = "faq" if faq and x.tag == "h3" and stack else kind
        elif x.tag == "p" and not x.above("li"):
            lines += [t] if (t := x.text()) else []
        elif x.tag in ("ul", "ol") and not x.above("ul", "ol"):
            items = [f"- {i.text()}" for i in x.content if isinstance(i, Element) and i.tag == "li"]
            lines += items
            kind = "list" if items and kind == "prose" else kind
        elif x.tag == "table":
            done()
            rows = [[c.text() for c in r.all() if c.tag in ("td", "th")] for r in x.all() if r.tag == "tr"]
            if text := table_text(rows):
                out.append((list(stack), text, "table", "table"))
    done()
    return title, out


def markdown_sections(text: str) -> tuple[str, list[tuple]]:
    """A section for what stands under a heading, and one for each table, which comes before the lines that it interrupts."""
    title, path, out, lines, table = "", [], [], [], []

    def done() -> None:
        where = " > ".join(path)
        if table:
            cells = [[c.strip() for c in r.strip("|").split("|")] for r in table if not re.match(r"\|?\s*-+", r)]
            out.append((list(path), table_text(cells).strip(), where, "table"))
        if lines:
            out.append((list(path), re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip(), where, "prose"))
        table.clear(), lines.clear()

    for line in text.splitlines():
        bare = line.strip()
        if line.startswith("#"):
            done()
            name = heading_name(line.lstrip("#").strip())
            level = len(line) - len(line.lstrip("#"))
            if level == 1:
                title, path = name, []
            else:
                path = [*path[: level - 2], name]
        elif bare.startswith("|"):
            table.append(bare)
        elif bare:
            lines.append(line.rstrip())
        elif table:
            done()
        elif lines:
            lines.append("")
    done()
    return title, out


def text_sections(text: str) -> tuple[str, list[tuple]]:
    """Paragraphs, under the last line in capitals that stood alone or above one."""
    heading, out = [], []
    parts = [p.strip() for p in re.split(r"\n\s*\n|\n-----\n", text) if p.strip()]
    for part in parts:
        first, _, rest = part.partition("\n")
        if first.isupper() and len(first) < 80:
            heading, part = [heading_name(first)], rest.strip()
            if not rest:
                continue
        out.append((list(heading), part, " > ".join(heading), "prose"))
    return (parts[0].splitlines()[0].title() if parts else ""), out


def csv_text(text: str) -> tuple[str, list[tuple]]:
    """A section for each value of the first column, a line a row; names in one form."""
    rows = csv.DictReader(io.StringIO(text))
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(rows, 2):
        cells = "; ".join(f"{field_name(k)}: {v}" for k, v in r.items() if v not in (None, ""))
        groups.setdefault(r[rows.fieldnames[0]] or "", []).append(f"(row {i}) {cells}.")
    if not groups:
        raise ValueError("the table has no rows")
    return "", [([k], "\n".join(v), f"rows for {k}", "table") for k, v in groups.items()]


def form_text(text: str) -> tuple[str, list[tuple], str]:
    """A section for each of the form's, a line a field; and the form's version."""
    form = json.loads(text)
    out = []
    for s in form.get("sections", []):
        lines = []
        for f in s.get("fields", []):
            more = f" Options: {', '.join(map(str, f['options']))}." if f.get("options") else ""
            more += f" {f['help']}." if f.get("help") else ""
            lines.append(f"Field {field_name(f.get('name', '')).replace(' ', '_')} ({f.get('type', 'text')}, {'required' if f.get('required') else 'optional'}): {f.get('label', '')}.{more}")
        out.append(([s.get("title", "")], "\n".join(lines), s.get("title", ""), "form"))
    return form.get("form_name", ""), out, str(form.get("version", "1.0"))


def pdf_lines(pages: list[str]) -> tuple[str, list[tuple]]:
    """Pages of lines to sections: a heading's lines on a page are one text. A numbered heading stands in its own text, too."""
    path, out = [], []
    for n, page in enumerate(pages, 1):
        held: list[str] = []

        def done() -> None:
            if held:
                out.append((list(path), " ".join(held), f"page {n}", "prose"))  # noqa: B023
            held.clear()  # noqa: B023

        for line in filter(None, map(str.strip, page.splitlines())):
            if PDF_HEADING.match(line) and len(line) < 90:
                done()
                if line.startswith("SECTION"):
                    path = [heading_name(line)]
                    continue
                path = [*path[:1], heading_name(line.partition(" ")[2] or line)]
            held.append(line)
        done()
    if not out:
        raise ValueError("no text can be taken from it")
    return "\n".join(pages).strip().splitlines()[0].title()[:80], out


def pdf_sections(raw: bytes) -> tuple[str, list[tuple]]:
    try:
        import pypdf  # an optional package
    except ImportError as e:
        raise ValueError("no PDF parser is installed") from e
    return pdf_lines([page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages])


_utf8 = lambda raw: raw.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
#: By extension: the type of source and what reads it: (title, sections) and, where the file says it, its version.
LOADERS = {
    "html": ("html", lambda raw, path: html_sections(_utf8(raw), path)),
    "htm": ("html", lambda raw, path: html_sections(_utf8(raw), path)),
    "md": ("markdown", lambda raw, path: markdown_sections(_utf8(raw))),
    "txt": ("text", lambda raw, path: text_sections(_utf8(raw))),
    "csv": ("csv", lambda raw, path: csv_text(_utf8(raw))),
    "json": ("json_form", lambda raw, path: form_text(_utf8(raw))),
    "pdf": ("pdf", lambda raw, path: pdf_sections(raw)),
}


def load(path: str, raw: bytes) -> dict:
    """One document's row; never raises. `head` is what its version and date are looked for in, `updated` the day of a page's last update, `version`
    the form's own."""
    stem, _, ext = path.rpartition("/")[2].rpartition(".")
    kind, loader = LOADERS.get(ext.lower(), ("text", None))
    named = stem if kind in ("html", "text") else stem.replace("_", " ").title()
    row = {"path": path, "source_type": kind, "status": "ok", "error": None, "title": named, "sections": [], "raw_chars": 0, "head": None, "updated": None, "version": None}
    try:
        if loader is None:
            raise ValueError(f"unsupported file type .{ext}")
        title, sections, *version = loader(raw, path)
        row["title"] = title or row["title"]
        row["sections"] = [dict(zip(("headings", "text", "locator", "kind"), s)) for s in sections]
        row["raw_chars"] = len(raw) if kind in ("json_form", "pdf") else len(_utf8(raw))
        row["version"] = version[0] if version else None
        if kind not in ("csv", "json_form"):
            whole = "\n".join(s[1] for s in sections) if kind in ("html", "pdf") else _utf8(raw)
            # A page's foot often has its date.
            row["head"] = (f"{whole} {_utf8(raw)[-1500:]}" if kind == "html" else whole)[:800]
        if kind == "html" and (m := re.search(r"last updated on (\d{2})/(\d{2})/(\d{4})", _utf8(raw))):
            row["updated"] = f"{m[3]}-{m[2]}-{m[1]}"
        if not any(s[1].strip() for s in sections):
            row |= {"status": "empty", "error": "no content after extraction"}
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file becomes its row
        row |= {"status": "failed", "error": f"{type(e).__name__}: {e}", "sections": []}
    return row


def discover(spark: SparkSession, roots: list[tuple[str, str, str]], skip: list[str] = ()) -> DataFrame:
    """(path, content, market, language, root) of every file in any folder below the roots; names that start with . or _ and
    those in skip are left out. root is the place in the list."""
    found = None
    for i, (root, market, language) in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.select("path", "content", F.lit(market).alias("market"), F.lit(language).alias("language"), F.lit(i).alias("root"))
        found = files if found is None else found.unionByName(files)
    found = found.where(~F.col("path").rlike(r"/[._][^/]*(?:/|$)"))
    return found.where(~F.element_at(F.split("path", "/"), -1).isin(list(skip))) if skip else found


def in_file_order(found: DataFrame) -> DataFrame:
    """Files by root, then by the parts of their paths: the order in which records are numbered. Select what is needed first;
    without `content` no file is read."""
    return found.orderBy("root", F.split("path", "/"))


def read_documents(spark: SparkSession, roots: list[tuple[str, str, str]], skip: list[str] = ()) -> DataFrame:
    """roots: (path, market, language). One row per file that discover() finds. Each task reads and parses its own files."""
    return parse_documents(discover(spark, roots, skip))


def parse_documents(found: DataFrame) -> DataFrame:
    """found: path, content, market, language, root. One row per file, read by what its path ends in."""
    made = ["path", "source_type", "status", "error", "title", "sections", "raw_chars", "head", "updated", "version"]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([load(p, bytes(c)) for p, c in zip(b["path"], b["content"])], columns=made)
            yield rows.assign(fingerprint=b["fp"].to_numpy(), **{c: b[c].to_numpy() for c in ("market", "language", "root")})

    rows = found.select("path", "content", "market", "language", "root", F.substring(F.sha1("content"), 1, 12).alias("fp"))
    return rows.mapInPandas(parsed, f"{DOCUMENT}, market string, language string, root int")


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("n_sections", "n_lists", "n_tables"))]))
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A page's title and its text, one section a line."""
    for s in pages:
        rows = []
        for html in s:
            title, sections = html_sections(html or "")
            kinds = [x[3] for x in sections]
            rows.append((title, "\n".join(x[1] for x in sections), len(sections), kinds.count("list"), kinds.count("table")))
        yield pd.DataFrame(rows, columns=["title", "text", "n_sections", "n_lists", "n_tables"])


def read_records(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines; malformed ones are skipped, or fatal where strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    """JSON lines; append for logs, partitioned by call for sessions."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def masked_transcripts(turns: DataFrame, call: str, turn: str, role: str, text: str, more: list[str] = ()) -> DataFrame:
    """(call, turn, json, line, kinds): each turn as JSON and as a line `role: text`, personal data masked in the serialised
    values of both; kinds are those of the JSON. A row a turn, so a call of any length is never held whole."""
    rows = turns.select(F.col(call).alias("call"), F.col(turn).alias("turn"), F.to_json(F.struct(call, turn, role, text, *more)).alias("j"), F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit(""))).alias("l"))
    masked = rows.select("call", "turn", pii.mask("j").alias("j"), pii.mask("l").alias("l"))
    return masked.select("call", "turn", F.col("j.masked").alias("json"), F.col("l.masked").alias("line"), F.col("j.kinds").alias("kinds"))


def write_transcripts(masked: DataFrame, path: str) -> None:
    """Two folders of text files, json and txt, a folder a call in each, turns in order."""
    rows = cut(masked.select("call", "turn", "json", "line")).repartition("call").sortWithinPartitions("call", "turn")
    for column, name in (("json", "json"), ("line", "txt")):
        rows.select("call", F.col(column).alias("value")).write.mode("overwrite").partitionBy("call").text(f"{path}/{name}")


def wav_chunks(spark: SparkSession, path: str, seconds: float = 3.0) -> DataFrame:
    """(path, chunk, t_start, t_end, rate, pcm) of 16-bit WAV files: tumbling windows of the first channel, the last one short."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                with wave.open(io.BytesIO(bytes(c))) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = w.readframes(w.getnframes())
                mono = b"".join(raw[i : i + width] for i in range(0, len(raw), width * channels)) if channels > 1 else raw
                step = int(seconds * rate) * width
                rows += [(p, n, i / width / rate, min(i + step, len(mono)) / width / rate, rate, mono[i : i + step]) for n, i in enumerate(range(0, len(mono), step))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "t_start", "t_end", "rate", "pcm"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(windows, "path string, chunk int, t_start double, t_end double, rate int, pcm binary")


def markdown_report(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A Markdown table of an aggregate; refuses more rows than a reader would look at."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    cell = lambda v: str(v).replace("|", "\\|")
    return "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)])
