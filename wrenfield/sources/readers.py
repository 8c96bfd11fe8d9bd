"""Readers of captured payloads: JSON lines, commented JSON, CSV, HTML with embedded JSON, mail and PDF."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfield.functions.text import html_to_text


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of an append-only log; lines that aren't JSON or lack a required field are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna(subset=required)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quoted commas, doubled quotes and line ends within quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_commented_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object, without its comment keys, which begin with ``//``."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return pairs.where(~F.col("key").startswith("//"))


def json_blocks(html: Column, kind: str = "application/ld+json") -> Column:
    """The bodies of a page's scripts of one type, as texts of JSON."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type=["\']{kind.replace("+", chr(92) + "+")}["\'][^>]*>(.*?)</script>'), F.lit(1))


def next_data(html: Column) -> Column:
    """The page state of a rendered application, or null."""
    body = F.regexp_extract(html, r'(?is)<script[^>]*id=["\']__NEXT_DATA__["\'][^>]*>(.*?)</script>', 1)
    return F.when(body != "", body)


def ld_nodes(pages: DataFrame, html: str, node_type: str, schema: str) -> DataFrame:
    """``pages``' other columns with ``node``, a struct of ``schema``, for each JSON-LD node of a type, be it alone, in a list or
    in an ``@graph``. Broken blocks give nothing."""
    block = pages.withColumn("_b", F.explode(json_blocks(F.col(html))))
    listed = F.from_json("_b", "array<string>")
    graph = F.from_json(F.get_json_object("_b", "$['@graph']"), "array<string>")
    parts = F.when(F.col("_b").rlike(r"^\s*\["), listed).when(graph.isNotNull(), graph).otherwise(F.array("_b"))
    nodes = block.withColumn("_n", F.explode(parts)).where(F.get_json_object("_n", "$['@type']") == node_type)
    return nodes.withColumn("node", F.from_json("_n", schema)).drop("_b", "_n", html)


def anchors(html: Column) -> Column:
    """Array of struct(href, text) of a page's links."""
    raw = F.regexp_extract_all(html, F.lit(r'(?is)(<a\b[^>]*href=["\'][^"\']*["\'][^>]*>.*?(?:</a>|(?=<a\b)|$))'), F.lit(1))
    return F.transform(
        raw,
        lambda a: F.struct(
            F.regexp_extract(a, r'(?is)href=["\']([^"\']*)["\']', 1).alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]+>", " "), r"\s+", " ")).alias("text"),
        ),
    )


def labelled_fields(html: Column) -> Column:
    """Map from labels to values of a page's pairs ``<dt>Label</dt><dd>value</dd>`` and ``<th>..</th><td>..</td>``: labels in lower
    case without a colon, values as readable text. The first of a label counts."""
    pairs = F.concat(*[F.regexp_extract_all(html, F.lit(rf"(?is)(<{a}\b[^>]*>.*?</{a}\s*>\s*<{b}\b[^>]*>.*?</{b}\s*>)"), F.lit(1)) for a, b in (("dt", "dd"), ("th", "td"))])
    cut = lambda x, tags: html_to_text(F.regexp_extract(x, rf"(?is)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})\s*>", 1))
    named = F.transform(pairs, lambda x: F.struct(F.lower(F.regexp_replace(cut(x, "dt|th"), r"\s*:\s*$", "")).alias("label"), cut(x, "dd|td").alias("value")))
    return F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["label"]), m).otherwise(F.map_concat(m, F.create_map(x["label"], x["value"]))))


# Services whose mail alerts are known, by a word of their sender or subject.
SENDERS = {"schrole": "Schrole", "tes.com": "TES", "teachaway": "Teach Away", "searchassociates": "Search Associates", "linkedin": "LinkedIn", "indeed": "Indeed"}


def sender_label(sender: Column, subject: Column) -> Column:
    """The service that a mail alert comes from; of unknown ones the domain is told."""
    hay = F.lower(F.concat_ws(" ", sender, subject))
    domain = F.regexp_extract(sender, r"@([\w.-]+)", 1)
    known = F.coalesce(*[F.when(hay.contains(word), label) for word, label in SENDERS.items()])
    return F.coalesce(known, F.when(domain != "", F.concat(F.lit("Email alert ("), domain, F.lit(")"))), F.lit("Email alert"))


def _balanced(text: str, start: int) -> str | None:
    """The JSON object that begins at ``start``; braces in texts don't count."""
    depth, inside, i = 0, False, start
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def embedded_objects(pages: DataFrame, key: str, html: str, marker: str) -> DataFrame:
    """(key, object): whole JSON objects that begin with ``marker`` (such as ``{"id":``) in text pushed piecewise into a page
    as ``push([1,"..."])``; pieces are joined and unescaped first."""
    import json

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch["key"], batch["html"]):
                pieces = []
                for piece in re.findall(r'push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)', page):
                    try:
                        pieces.append(json.loads(piece))
                    except ValueError:
                        pass
                text, seen = "".join(pieces) or page, set()
                for m in re.finditer(re.escape(marker), text):
                    found = _balanced(text, m.start())
                    if found and found not in seen:
                        seen.add(found)
                        out.append((k, found))
            yield pd.DataFrame(out, columns=["key", "object"])

    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))
    return rows.mapInPandas(scan, "key string, object string")


def mail_messages(files: DataFrame) -> DataFrame:
    """(path, sender, subject, sent_at, body) of ``binaryFile`` rows of mail: multipart bodies prefer plain text, encoded
    words, quoted-printable and base64 are decoded, folded headers joined; undated mail has a null time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy
        from email.utils import parsedate_to_datetime

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                m = message_from_bytes(bytes(content), policy=policy.default)
                part = m.get_body(preferencelist=("plain", "html"))
                try:
                    body = part.get_content() if part is not None else ""
                except (LookupError, ValueError):
                    body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
                try:
                    sent = pd.Timestamp(parsedate_to_datetime(str(m["date"]))) if m["date"] else None
                    sent = sent.tz_localize("UTC") if sent is not None and sent.tzinfo is None else sent
                except (ValueError, TypeError):
                    sent = None
                out.append((path, str(m["from"] or ""), str(m["subject"] or ""), None if sent is None else sent.tz_convert("UTC").tz_localize(None), body))
            frame = pd.DataFrame(out, columns=["path", "sender", "subject", "sent_at", "body"])
            frame["sent_at"] = pd.to_datetime(frame["sent_at"])
            yield frame

    return files.select("path", "content").mapInPandas(parse, "path string, sender string, subject string, sent_at timestamp, body string")


def within_days(messages: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Messages of the last ``days`` by their own date; undated ones stay."""
    return messages.where(F.col("sent_at").isNull() | (F.col("sent_at") >= as_of - F.make_dt_interval(F.lit(days))))


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>|T\*|Td|TD|'", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def pdf_text(content: bytes, limit: int | None = None) -> str:
    """The text that a PDF shows, or its first ``limit`` characters: raw and Flate streams, literal and hex strings (UTF-16BE
    too); "" for anything else."""
    if not content.startswith(b"%PDF"):
        return ""
    out: list[str] = []
    for head, data in _STREAM.findall(content):
        if b"/Image" in head:
            continue
        if b"FlateDecode" in head:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data:
            continue
        for token in _SHOWN.findall(data):
            if token[:1] == b"(":
                raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
            elif token[:1] == b"<":
                digits = re.sub(rb"\s", b"", token[1:-1])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                out.append("\n")
                continue
            wide = raw[:2] == b"\xfe\xff" or (token[:1] == b"<" and len(raw) >= 4 and len(raw) % 2 == 0 and not any(raw[::2]))
            out.append(raw.removeprefix(b"\xfe\xff").decode("utf-16-be", "replace") if wide else raw.decode("latin-1"))
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()[:limit]


def pdf_texts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, text) of ``binaryFile`` rows; null contents have the empty text."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda c: "" if c is None else pdf_text(bytes(c), limit))

    return files.select("path", read("content").alias("text"))
