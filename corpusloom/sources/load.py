"""Sources: files of mixed formats, HTML pages, URLs and case files."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusloom.sources.docx import docx_text

# Encodings in the order in which they are tried, tags whose content is dropped, suffixes of text files, hosts that are never fetched.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5", "utf-16", "latin-1")
DROPPED_TAGS = {"script", "style", "noscript", "iframe", "svg", "canvas", "form", "nav", "footer", "aside"}
TEXT_SUFFIXES = ("txt", "md", "markdown", "text", "log", "csv")
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".home.arpa")


def decode_bytes(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return ""


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.title, self.in_title, self.row = [], 0, "", False, None
        self.first, self.in_first = "", False  # of the first h1

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.skip += 1
        self.in_title = tag == "title" or (self.in_title and tag != "body")
        self.in_first = self.in_first or (tag == "h1" and not self.first)
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n" + "#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "section", "article", "br"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        if tag == "h1":
            self.in_first = False
        if tag == "tr" and self.row is not None:
            self.out.append("\n| " + " | ".join(x.strip() for x in self.row) + " |\n")
            self.row = None
        elif tag in ("p", "div", "section", "article") or (tag[0] == "h" and tag[1:].isdigit()):
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            if self.in_first:
                self.first += data
            if self.row:
                self.row[-1] += data
            else:
                self.out.append(data)


def html_text(html: str | None) -> tuple[str, str]:
    """Title (else the first h1) and text: headings as #, list items as - on one line, table rows as | a | b |, blank runs as one."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    text = "\n".join(x.strip() for x in "".join(reader.out).split("\n"))
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return reader.title.strip() or " ".join(reader.first.split()), text.strip()


def file_text(name: str, data: bytes) -> str:
    """The text of a file by its suffix; ValueError for formats that aren't read, damaged files and those without text."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix in TEXT_SUFFIXES:
        text = decode_bytes(data)
    elif suffix in ("html", "htm"):
        text = html_text(decode_bytes(data))[1]
    elif suffix == "docx":
        text = docx_text(data)
    else:
        raise ValueError(f"unsupported format: {suffix or 'none'}")
    if not text.strip():
        raise ValueError("no text")
    return text


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text, error of all files under `path`, in the order of their paths.

    Text formats are decoded, HTML and Word files are reduced to text; others get an error, never a failure. An HTML
    file is named by its title. Files of other suffixes aren't read, only listed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for p, data in zip(rows["path"], rows["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                try:
                    text = file_text(name, data)
                    title = html_text(decode_bytes(data))[0] if name.lower().endswith((".html", ".htm")) else ""
                    out.append((p, title or name, text, None))
                except ValueError as e:
                    out.append((p, name, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower("path").rlike(r"\.(" + "|".join((*TEXT_SUFFIXES, "html", "htm", "docx")) + ")$")
    read = files.filter(known).select("path", "content").mapInPandas(run, "path string, name string, text string, error string")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("none")
    none = F.lit(None).cast("string")
    listed = files.filter(~known).select("path", name.alias("name"), none.alias("text"), F.concat(F.lit("unsupported format: "), suffix).alias("error"))
    return read.union(listed).orderBy("path")


def html_columns(html: Column) -> tuple[Column, Column]:
    """Title and text of a page by expressions only: dropped tags go with their content, other tags become spaces."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    text = F.regexp_replace(html, r"(?is)<(title|script|style|noscript|iframe|svg|canvas|form|nav|footer|aside)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return title, F.trim(F.regexp_replace(text, r"\s+", " "))


def url_verdict(url: Column) -> Column:
    """ok, or why a URL may not be fetched, by its syntax: scheme, user data, host, blocked names. No name is resolved."""
    text = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"\.+$", "")
    blocked = bare == "localhost"
    for suffix in BLOCKED_SUFFIXES:
        blocked = blocked | bare.endswith(suffix)
    return (
        F.when(text == "", "empty")
        .when(~text.rlike(r"^(?i)https?://"), "scheme")
        .when(text.rlike(r"^[^/]*//[^/?#]*@"), "userinfo")
        .when(host == "", "no host")
        .when(blocked, "blocked host")
        .otherwise("ok")
    )


@F.pandas_udf(BooleanType())
def address_allowed(hosts: pd.Series) -> pd.Series:
    """False for IP literals that aren't global, IPv4 inside IPv6 included; True for global ones and for names."""

    def one(host: str | None) -> bool:
        try:
            address = ipaddress.ip_address((host or "").strip("[]"))
        except ValueError:
            return True
        mapped = getattr(address, "ipv4_mapped", None)
        return (mapped or address).is_global

    return hosts.map(one).astype(bool)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """question, keywords, document, note of a JSON-lines file; blank lines, # comments and cases without a question are skipped."""
    schema = "question string, keywords array<string>, document string, note string"
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#')")
    rows = rows.select(F.from_json("v", schema).alias("c")).select("c.*").filter("trim(question) <> ''")
    return rows.withColumn("keywords", F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.trim), lambda x: x != ""))
