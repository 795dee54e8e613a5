"""Help documents: reading, intake checks, sections, status, replacement and deletion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import documents as d
from ..functions.text import content_fingerprint, doc_title, file_suffix, normalise_document, strip, word_tokens
from ..schema import MAX_FILE_BYTES, MAX_SECTIONS, SECTION_TOKENS
from .scale import running_sum

# Reasons shown for a refused file
WRONG_TYPE = "Upload Markdown, text, HTML or PDF files."
TOO_LARGE = "The file is over 5 MB."
NO_TEXT = "No text found in the file (a scanned PDF needs OCR first)."
NO_SECTIONS = "No text to index."
UNREADABLE = "The file isn't readable text (unknown encoding)."
ALREADY_ADDED = "This document was already added."
TOO_MANY = ("The document has ", " sections; split it into files of at most ")
# own wording
PDF_FILE = "PDF files are not supported here."
TITLE_LENGTH = 200


# --- reading -----------------------------------------------------------------------------


def read_pages(keys: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, text, error) of HTML texts; a page that cannot be read carries an error and stops no other."""

    def read(batches):
        for batch in batches:
            rows = []
            for page_id, source in zip(batch[key], batch[html]):
                try:
                    rows.append((page_id, *d.page_text(source), None))
                except Exception as exc:
                    rows.append((page_id, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=[key, "title", "text", "error"])

    kind = dict(keys.dtypes)[key]
    return keys.select(key, html).mapInPandas(read, f"{key} {kind}, title string, text string, error string")


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title and text of HTML pages; a page that cannot be read carries an error instead."""
    return read_pages(pages, key, html).withColumn("text", normalise_document("text"))


def file_texts(files: DataFrame) -> DataFrame:
    """Text of files read with the binaryFile source (path, length, content).

    Type and size are judged in scans of their own: the plain filters on length reach the source, so an oversized file is
    never loaded, and one unreadable file stops no other. PDF files pass the intake check, but parsing them needs a library
    that this package does not carry, so they are reported here.
    """
    suffix = file_suffix("path")
    supported = suffix.isin(*d.SUPPORTED_SUFFIXES)
    refused = files.filter(F.col("length") > MAX_FILE_BYTES).select("path", F.when(supported, TOO_LARGE).otherwise(WRONG_TYPE).alias("error"))
    small = files.filter(F.col("length") <= MAX_FILE_BYTES)
    wrong = small.filter(~F.coalesce(supported, F.lit(False))).select("path", F.lit(WRONG_TYPE).alias("error"))
    kept = small.filter(supported).select("path", suffix.alias("suffix"), "content")

    def read(batches):
        for batch in batches:
            rows = []
            for path, kind, data in zip(batch["path"], batch["suffix"], batch["content"]):
                title = text = reason = None
                try:
                    if kind == ".pdf":
                        reason = PDF_FILE
                    elif (text := d.decode(data)) is None:
                        reason = UNREADABLE
                    elif kind in (".html", ".htm"):
                        title, text = d.page_text(text)
                except Exception as exc:
                    title, text, reason = None, None, f"{type(exc).__name__}: {exc}"
                rows.append((path, title, text, reason))
            yield pd.DataFrame(rows, columns=["path", "title", "text", "error"])

    read_files = kept.mapInPandas(read, "path string, title string, text string, error string")
    nothing = F.lit(None).cast("string")
    rejected = refused.unionByName(wrong).select("path", nothing.alias("title"), nothing.alias("text"), "error")
    clean = read_files.unionByName(rejected).withColumn("text", normalise_document("text"))
    return clean.select(
        "path",
        doc_title("title", F.coalesce("text", F.lit("")), "path").alias("title"),
        "text",
        F.coalesce("error", F.when(F.col("text") == "", NO_TEXT)).alias("error"),
    )


def intake_report(files: DataFrame) -> DataFrame:
    """Accept or refuse each document (document_id, tenant_id, filename, content, byte_length).

    Refused: wrong type, too large, no text, or the same content as an earlier accepted document
    of the tenant. The earliest id per fingerprint is an aggregate and is matched back by the unique
    document id, so thousands of copies of one text never meet in one task.
    """
    text = normalise_document("content")
    reason = (
        F.when(F.col("byte_length") > MAX_FILE_BYTES, TOO_LARGE)
        .when(~file_suffix("filename").isin(*d.SUPPORTED_SUFFIXES), WRONG_TYPE)
        .when(F.length(text) == 0, NO_TEXT)
    )
    judged = files.select("document_id", "tenant_id", "filename", content_fingerprint(text).alias("fingerprint"), reason.alias("reason"))
    kept = (
        judged.filter("reason IS NULL")
        .groupBy("tenant_id", "fingerprint")
        .agg(F.min("document_id").alias("document_id"))
        .select("document_id", F.lit(True).alias("is_first"))
    )
    duplicate = F.col("reason").isNull() & F.col("is_first").isNull()
    return (
        judged.join(kept, "document_id", "left")
        .withColumn("reason", F.when(duplicate, ALREADY_ADDED).otherwise(F.col("reason")))
        .select("document_id", "tenant_id", "filename", F.col("reason").isNull().alias("accepted"), "reason")
    )


def within_limit(entries: DataFrame, text: Column, limit: int, count: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Entries with their token count and whether the embedding model can read them whole."""
    return entries.withColumn("tokens", count(text)).withColumn("fits", F.col("tokens") <= limit)


# --- sections ----------------------------------------------------------------------------


def chunk_sections(docs: DataFrame, limit: int = SECTION_TOKENS, count: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Sections of documents (document_id, tenant_id, title, content) with zero-based positions.

    Linear in the length, blocks and headings of a document. A null or empty content has no section, a null title none to show.
    """
    kinds = dict(docs.dtypes)
    blocks = d.measured_blocks(F.coalesce("content", F.lit("")), limit, count)
    rows = docs.select("document_id", "tenant_id", "title", blocks.alias("blocks"))
    return d.section_table(kinds["document_id"], kinds["tenant_id"], limit)(rows.asTable())


def part_numbers(sections: DataFrame) -> DataFrame:
    """Number sections that share a title within their document: "Title (part n)".

    One document is one stored row, so the group of its sections is bounded by that row.
    """
    same = W.partitionBy("document_id", "title")
    part = F.concat("title", F.lit(" (part "), F.col("__part").cast("string"), F.lit(")"))
    return (
        sections.withColumns({"__of": F.count("*").over(same), "__part": F.row_number().over(same.orderBy("position"))})
        .withColumn("title", F.left(F.when(F.col("__of") > 1, part).otherwise(F.col("title")), F.lit(TITLE_LENGTH)))
        .drop("__of", "__part")
    )


def pack_tokens(sections: DataFrame, limit: int = SECTION_TOKENS, count: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Each section with its tokens and the number of the window of `limit` tokens in which it begins.

    Windows are laid over a document's sections in order of position. The running count is summed per thousand positions first,
    so a document of very many sections is spread over tasks. Sections without a word begin where the one before them ended; a
    null content counts as empty.
    """
    sized = sections.withColumn("tokens", count(F.coalesce("content", F.lit(""))).cast("bigint"))
    run = running_sum(sized, ["document_id"], ["position"], F.floor(F.col("position") / 1000), F.col("tokens"), "__until")
    window = F.floor((F.col("__until") - F.col("tokens")) / limit).cast("bigint")
    return run.withColumn("window_no", window).drop("__until")


def text_blocks(docs: DataFrame) -> DataFrame:
    """Non-empty blocks of each document with zero-based positions."""
    return docs.select("document_id", "tenant_id", "title", F.posexplode(d.blocks_of(F.col("content"))).alias("position", "block"))


def heading_blocks(docs: DataFrame) -> DataFrame:
    """Blocks with the path of headings above them, the document's own title left out."""
    rows = docs.select("document_id", "title", d.headed(d.blocks_of(F.coalesce("content", F.lit("")))).alias("blocks"))
    return d.block_table(dict(docs.dtypes)["document_id"])(rows.asTable())


def document_status(docs: DataFrame, sections: DataFrame, most: int = MAX_SECTIONS) -> DataFrame:
    """Ready with its section count, or failed with the reason."""
    counts = sections.groupBy("document_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    error = F.when(n == 0, NO_SECTIONS).when(
        n > most, F.concat(F.lit(TOO_MANY[0]), n.cast("string"), F.lit(f"{TOO_MANY[1]}{most}."))
    )
    return (
        docs.select("document_id", "tenant_id")
        .join(counts, "document_id", "left")
        .select("document_id", "tenant_id", n.alias("n"), error.alias("error"))
        .select(
            "document_id", "tenant_id",
            F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"),
            F.when(F.col("error").isNull(), F.col("n")).otherwise(F.lit(0)).alias("section_count"),
            "error",
        )
    )


def section_counts(docs: DataFrame, sections: DataFrame) -> DataFrame:
    counts = sections.groupBy("document_id").agg(F.count("*").alias("sections"))
    return docs.select("document_id", "tenant_id").join(counts, "document_id", "left").na.fill(0, ["sections"])


def replace_sections(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sections after reprocessing: documents in `fresh` lose all their earlier sections."""
    return current.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def without_documents(sections: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sections left after deleting documents."""
    return sections.join(deleted.select("document_id"), "document_id", "left_anti")
