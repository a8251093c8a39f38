"""Names, paths, storage locations and file types."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernweave.functions.text import remove_accents

# File extension and its media type.
MEDIA_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def safe_name(text: str | None, max_length: int = 255, default: str = "unnamed") -> str:
    """A configuration name as a path part: plain letters, digits, ``_`` and ``-``."""
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    name = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_-]", "_", plain)).strip("_-").lower()
    if len(name) > max_length:  # a digest keeps long names apart
        name = name[: max_length - 9].rstrip("_-") + "_" + hashlib.sha256(name.encode()).hexdigest()[:8]
    return name or default


def identifier(text: str, connection_id: int | None = None) -> str:
    """A catalog name for a connection: letters, digits and ``_``, never starting with a digit."""
    name = re.sub(r"[^A-Za-z0-9_]", "_", text) or "conn"
    name = name if name[0].isalpha() or name[0] == "_" else f"_{name}"
    return (name if connection_id is None else f"{name}_{connection_id}").lower()


def shared_table_name(text: str) -> str:
    """A shared table's name: plain lower-case letters and digits joined by single ``_``."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return safe_name(re.sub(r"[^a-z0-9]+", "_", plain), default="table")


def safe_name_column(c: Column, max_length: int = 255, default: str = "unnamed") -> Column:
    """The same rule for a column of names."""
    ascii_only = F.regexp_replace(remove_accents(c), r"[^\x00-\x7F]", "")
    joined = F.regexp_replace(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_-]", "_"), "_+", "_")
    name = F.lower(F.regexp_replace(joined, r"^[_-]+|[_-]+$", ""))
    short = F.regexp_replace(F.substring(name, 1, max_length - 9), r"[_-]+$", "")
    digest = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    name = F.when(F.length(name) > max_length, F.concat(short, F.lit("_"), digest)).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(name)


def unique_name(base: str, suffix: str, taken: set[str]) -> str:
    """``base``, else ``base_suffix``, else ``base_suffix_n`` with the first free n."""
    if base not in taken:
        return base
    name, n = f"{base}_{suffix}", 1
    while name in taken:
        n += 1
        name = f"{base}_{suffix}_{n}"
    return name


def location_parts(c: Column) -> dict[str, Column]:
    """Scheme, bucket and key of ``scheme://bucket/key`` or ``bucket/key``; absent parts are NULL."""
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/]*)/?(.*)$"
    names = {"scheme": 1, "bucket": 2, "key": 3}
    return {n: F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for n, i in names.items()}


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def media_type(c: Column) -> Column:
    """Media type by file extension."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    name = base_name(F.regexp_replace(c, r"[?#].*$", ""))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(F.try_element_at(known, extension), F.lit(DEFAULT_MEDIA_TYPE))


def asset_path(c: Column, prefix: str) -> Column:
    """Where a copied asset lives: prefix and file name; NULL for an empty source."""
    return F.when(c != "", F.concat(F.lit(prefix.rstrip("/") + "/"), base_name(c)))
