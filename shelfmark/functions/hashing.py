"""Identities of files and folders."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes read from each end of a file.
CHUNK = 64 * 1024


def content_fingerprint(size: Column, mtime_ns: Column, content: Column, chunk: int | None = CHUNK) -> Column:
    """SHA-256 of size, time, the first chunk, and for longer files the last chunk (which may overlap the first).

    Without a chunk it is that of size, time and the whole content.
    """
    known = F.concat_ws(":", F.lit("v2"), size, mtime_ns, F.lit("")).cast("binary")
    if chunk is None:
        return F.sha2(F.concat(known, content), 256)
    head = F.concat(known, F.substring(content, 1, chunk))
    tail = F.substring(content, F.greatest(F.length(content) - chunk + 1, F.lit(1)), F.lit(chunk))
    return F.sha2(F.when(size > chunk, F.concat(head, tail)).otherwise(head), 256)


def folder_fingerprint(path: Column) -> Column:
    """SHA-256 of the folder's relative path in NFC and lower case."""
    return F.sha2(F.concat(F.lit("dir-v2:"), F.lower(path)), 256)


def config_digest(config: dict) -> str:
    """SHA-256 of the configuration as canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
