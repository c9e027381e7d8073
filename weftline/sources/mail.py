"""Messages as a DataFrame: .eml folders, tables, a live mailbox; and the one Python boundary that reads MIME and HTML."""

from __future__ import annotations

import datetime as dt
import email
import email.utils
import html as _html
import re
from collections.abc import Iterator
from email import policy
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schemas
from weftline.operators.numbering import number_rows

# Elements and styles that hide their content in messages.
NOISE = {"img", "style", "script", "head"}
HIDDEN_STYLES = ("display:none", "visibility:hidden", "font-size:0", "color:#fff", "color:#ffffff", "color:white")
HIDDEN_CLASSES = ("preheader", "preview-text", "preview")


class FolderNotFoundError(ValueError):
    def __init__(self, folder: str, available: list[str]) -> None:
        super().__init__(f"Folder '{folder}' not found. Available folders: {', '.join(available)}")
        self.folder, self.available = folder, available


def header_date(raw: Column) -> Column:
    """The day of a message's Date header, in the sender's own offset; null without a readable one."""
    head = F.get(F.split(F.decode(raw, "ISO-8859-1"), r"\r?\n\r?\n", 2), F.lit(0))
    day = F.regexp_extract(head, r"(?im)^Date:\s*(?:[a-z]{3},\s*)?(\d{1,2}\s+[a-z]{3}\s+\d{4})", 1)
    return F.try_to_date(F.initcap(F.regexp_replace(day, r"\s+", " ")), "d MMM yyyy")


def read_eml(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """Messages of an .eml folder, numbered by path. Their day is that of the Date header, else of the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    order = number_rows(files.select("path"), ["path"], "msg_pos")
    return files.join(order, "path").select("msg_pos", F.lit(folder).alias("folder"), F.coalesce(header_date(F.col("content")), F.to_date("modificationTime")).alias("internal_date"), F.col("content").alias("raw"))


def select(messages: DataFrame, folder: str, start: dt.date, end: dt.date, cap: int | None = 50) -> DataFrame:
    """Messages of a folder between two dates, both inclusive, the first ``cap`` in mailbox order."""
    if not folder.strip():
        raise ValueError("folder must not be blank")
    if start > end:
        raise ValueError("date_start must not be after date_end")
    kept = messages.where((F.col("folder") == folder.strip()) & (F.col("internal_date") >= F.lit(start)) & (F.col("internal_date") < F.date_add(F.lit(end), 1)))
    return kept.orderBy("msg_pos").limit(cap) if cap else kept


def check_folder(messages: DataFrame, folder: str) -> None:
    """Raise with the folders there are (a mailbox has a bounded number of them) when ``folder`` isn't one."""
    if messages.where(F.col("folder") == folder).limit(1).isEmpty():
        raise FolderNotFoundError(folder, sorted(r.folder for r in messages.select("folder").distinct().collect()))


def imap_source(connect=None):
    """A Python data source for a live mailbox: one partition a chunk of message numbers, read only, dates pushed to the server.

    A task logs in once and fetches its chunk with one command. Options: host, user, password, folder, start, end, cap,
    chunk. ``connect``: host -> connection, ``imaplib.IMAP4_SSL`` by default.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Chunk(InputPartition):
        def __init__(self, first: int, uids: list[bytes]) -> None:
            self.first, self.uids = first, uids

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.o = options

        def _box(self):
            import imaplib

            box = (connect or imaplib.IMAP4_SSL)(self.o["host"])
            box.login(self.o["user"], self.o["password"])
            status, _ = box.select(f'"{self.o["folder"]}"', readonly=True)
            if status != "OK":
                names = [x.decode().rsplit('"', 2)[-2] for x in box.list()[1] or []]
                raise FolderNotFoundError(self.o["folder"], names)
            return box

        def partitions(self) -> list[InputPartition]:
            day = lambda s, plus=0: (dt.date.fromisoformat(s) + dt.timedelta(plus)).strftime("%d-%b-%Y")
            box = self._box()
            _, found = box.uid("SEARCH", None, "SINCE", day(self.o["start"]), "BEFORE", day(self.o["end"], 1))
            box.logout()
            uids, size = found[0].split()[: int(self.o.get("cap", 50))], int(self.o.get("chunk", 50))
            return [Chunk(i, uids[i : i + size]) for i in range(0, len(uids), size)]

        def read(self, part: Chunk) -> Iterator[tuple]:
            box = self._box()
            _, data = box.uid("FETCH", b",".join(part.uids), "(UID BODY.PEEK[] INTERNALDATE)")
            box.logout()
            # Servers answer in an order of their own; rows come in the order of the search.
            found = {imap_uid(head): (imap_date(head), raw) for head, raw in (x for x in data if isinstance(x, tuple))}
            for i, uid in enumerate(part.uids):
                if uid in found:
                    yield part.first + i, self.o["folder"], *found[uid]

    class Imap(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weftline_imap"

        def schema(self) -> str:
            return schemas.MESSAGE

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Imap


def imap_uid(answer: bytes) -> bytes | None:
    m = re.search(rb"UID (\d+)", answer)
    return m and m.group(1)


def imap_date(answer: bytes) -> dt.date | None:
    m = re.search(rb'INTERNALDATE " ?(\d+-\w{3}-\d{4})', answer)
    return dt.datetime.strptime(m.group(1).decode(), "%d-%b-%Y").date() if m else None


class _Markdown(HTMLParser):
    """HTML to the markdown subset that segmentation reads: headings, blocks, lists, emphasis, links, rules and cells."""

    _MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.links: list[tuple[str, int]] = []

    def _block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("style", "script", "head", "title"):
            self.skip += 1
        elif self.skip or tag == "img":
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "blockquote", "section", "article"):
            self._block()
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._block()
        elif tag == "li":
            depth = max(1, len(self.lists))
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "*"
            self.out.append("\n" + "  " * depth + mark + " ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "tr":
            self.out.append("\n")
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.out)))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("style", "script", "head", "title"):
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("p", "div", "table", "blockquote", "section", "article", "ul", "ol") or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self._block()
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = "".join(self.out[at:])
            self.out[at:] = [f"[{' '.join(text.split())}]({href})" if href else text]

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"[ \t\r\n]+", " ", data))


def html_to_markdown(source: str) -> str:
    p = _Markdown()
    p.feed(source)
    p.close()
    lines = [x if x.endswith("  ") and x.strip() else x.rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.lstrip() if not re.match(r" +(?:\*|\d+\.) ", x) else x for x in lines)).strip() + "\n"


class _Visible(HTMLParser):
    """Text outside noise elements and hidden ones."""

    _VOID = {"img", "br", "hr", "input", "meta", "link", "col", "area", "base", "wbr", "source", "embed", "track", "param"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[bool] = []
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self._VOID:
            return
        a = dict(attrs)
        style = (a.get("style") or "").lower().replace(" ", "")
        hidden = tag in NOISE or any(s in style for s in HIDDEN_STYLES) or any(k in (a.get("class") or "").lower() for k in HIDDEN_CLASSES)
        self.stack.append(hidden or bool(self.stack) and self.stack[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag not in self._VOID and self.stack:
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1]):
            self.text.append(data)


def visible_text(source: str) -> str:
    p = _Visible()
    p.feed(source)
    p.close()
    return _html.unescape("".join(p.text)).strip()


def read_mime(raw: bytes) -> dict:
    """Sender name (else address), date in the sender's own offset ('' when missing or unreadable), best text parts."""
    msg = email.message_from_bytes(bytes(raw), policy=policy.default)
    name, address = email.utils.parseaddr(str(msg.get("From", "")))
    date = ""
    try:
        date = email.utils.parsedate_to_datetime(str(msg["Date"])).strftime("%Y-%m-%d") if msg["Date"] else ""
    except (TypeError, ValueError):
        pass
    parts = {}
    for kind in ("plain", "html"):
        try:
            part = msg.get_body(preferencelist=(kind,))
            parts[kind] = part.get_content() if part is not None else None
        except (LookupError, KeyError, AttributeError):
            parts[kind] = None
    return {"newsletter": name.strip() or address, "date": date, **parts}


def parse_mime(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages parsed once, narrowed to ``schemas.MIME``; unreadable HTML gives empty markdown, so no stories.

    ``partitions``: spread a small input over so many tasks first, as parsing costs far more than reading.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pos, raw in zip(b["msg_pos"], b["raw"]):
                r = {"msg_pos": pos} | read_mime(raw if raw is not None else b"")
                source = r["html"]
                try:
                    r["has_text"], r["markdown"] = source is not None and bool(visible_text(source)), html_to_markdown(source) if source is not None else None
                except (AssertionError, ValueError):
                    r["has_text"], r["markdown"] = False, ""
                rows.append(r)
            yield pd.DataFrame(rows, columns=["msg_pos", "newsletter", "date", "plain", "html", "has_text", "markdown"])

    rows = messages.select("msg_pos", "raw")
    return (rows.repartition(partitions, "msg_pos") if partitions else rows).mapInPandas(run, schemas.MIME)
