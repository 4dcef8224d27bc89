"""Identity keys: content-addressed ids as hexadecimal prefixes of SHA-256. Null parts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(prefix: str, length: int, *parts: Column, between: str = "\n") -> Column:
    """``prefix`` and the first ``length`` digits of the hash of the joined parts."""
    joined = F.concat_ws(between, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def document_id(title: Column, body: Column) -> Column:
    return digest("doc_", 20, title, content_hash(body))


def catalog_id(source: Column, path: Column) -> Column:
    return digest("local_", 24, source, F.replace(F.lower(path), F.lit("/"), F.lit("\\")), between="|")


def chunk_id(doc_id: Column, index: Column, body: Column) -> Column:
    return F.concat(doc_id, F.lit("_chunk_"), index.cast("string"), F.lit("_"), F.substring(F.sha2(body, 256), 1, 10))


def parent_id(doc_id: Column, index: Column, body: Column) -> Column:
    return digest("parent_", 20, doc_id, index, body)


def child_id(parent: Column, index: Column, body: Column) -> Column:
    return digest("child_", 20, parent, index, body)


def version_group(members: Column) -> Column:
    """The id of a group of documents, from the sorted ids of its members."""
    return digest("version_", 16, F.array_join(F.array_sort(members), "|"))


def owner_document_id(owner: Column, draft: Column) -> Column:
    """The id of a published upload."""
    return digest("owner_", 24, owner, draft, between=":")


def owner_chunk_id(doc_id: Column, version: Column, chunk: Column, text: Column) -> Column:
    """The id of a chunk of a version of a published upload."""
    return F.concat(doc_id, F.lit("_v"), version.cast("string"), F.lit("_"), digest("", 16, chunk, text, between=":"))


def rate_key(client: Column, at: Column) -> Column:
    """The bucket of a client and minute."""
    return F.sha2(F.concat_ws(":", client.cast("string"), F.floor(F.unix_millis(at) / 60000).cast("string")), 256)
