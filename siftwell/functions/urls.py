"""URL, date, state and query-string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import base_name

# State codes and masks.
PRIVATE, PUBLISHED, CACHED, KNOWN, UNKNOWN = 0, 1, 2, 4, 512
PRIVATE_BIT = 8
STATE_NAMES = {PUBLISHED: "PUBLISHED", PRIVATE: "PRIVATE", CACHED: "CACHED", KNOWN: "KNOWN"}
# Short file types, extensions and their mime types.
FILE_TYPES = {"pdf": "application/pdf", "ps": "application/postscript", "txt": "text/plain", "html": "text/html", "doc": "application/msword", "rtf": "text/rtf"}
EXTENSIONS = {".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".py": "text/x-python", ".c": "text/x-csrc", ".h": "text/x-csrc", ".cpp": "text/x-c++src", ".java": "text/x-java"}
RESTRICTIONS = ["filetype", "filename", "searchtype"]


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def encode_url(path: Column) -> Column:
    return F.base64(F.encode(path, "UTF-8"))


def decode_url(url: Column) -> Column:
    return F.decode(F.unbase64(url), "UTF-8")


def public_url(url: Column) -> Column:
    """What peers may see of a file: its base name."""
    return base_name(decode_url(url))


def published_url(path: Column, root: str, ip: Column, port: Column) -> Column:
    """Address of a file below the published root, else null."""
    below = F.substring(path, F.lit(len(root) + 1), F.length(path))
    return F.when(path.startswith(root), F.concat(F.lit("http://"), ip, F.lit(":"), port.cast("string"), F.lit("/pub"), below))


#: scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B), with their marks.
REFERENCE = r"(?s)^([A-Za-z][-A-Za-z0-9+.]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)

    def step(kept: Column, part: Column) -> Column:
        shorter = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", shorter).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve_link(page: Column, link: Column) -> Column:
    """Absolute target of a link on a page."""
    base, own = ([F.regexp_extract(x, REFERENCE, k) for k in range(1, 6)] for x in (page, link))
    scheme, authority, path, query, _ = base
    _, _, own_path, own_query, own_fragment = own
    folder = F.when((path == "") & (authority != ""), "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)?", 1))
    new_path = F.when(own_path == "", path).when(own_path.startswith("/"), without_dots(own_path)).otherwise(without_dots(F.concat(folder, own_path)))
    new_query = F.when((own_path == "") & (own_query == ""), query).otherwise(own_query)
    inside = F.concat(scheme, authority, new_path, new_query, own_fragment)
    return F.when(link == "", page).when(own[0] != "", link).when(own[1] != "", F.concat(scheme, link)).otherwise(inside)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def mime_from_filetype(filetype: Column) -> Column:
    """A short type's mime type; an unknown or full one as it is; empty as null."""
    known = F.element_at(literal_map(FILE_TYPES), filetype)
    return F.coalesce(known, F.nullif(filetype, F.lit("")))


def mime_from_path(path: Column) -> Column:
    """Mime type by the last extension; null if no converter knows it."""
    return F.element_at(literal_map(EXTENSIONS), F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)))


def parse_query(raw: Column) -> Column:
    """struct(words, filetype, filename, searchtype); other ``a:b`` parts stay words."""
    parts = F.filter(F.split(F.trim(raw), r"\s+"), lambda p: p != "")

    def restricts(p: Column) -> Column:
        pieces = F.split(p, ":", -1)
        return (F.size(pieces) == 2) & F.get(pieces, 0).isin(RESTRICTIONS)

    def last(name: str) -> Column:
        found = F.filter(parts, lambda p: restricts(p) & (F.get(F.split(p, ":", -1), 0) == name))
        return F.when(F.size(found) > 0, F.get(F.split(F.get(found, F.size(found) - 1), ":", -1), 1))

    return F.struct(F.filter(parts, lambda p: ~restricts(p)).alias("words"), mime_from_filetype(last("filetype")).alias("filetype"), last("filename").alias("filename"), last("searchtype").alias("searchtype"))


def split_prefixed(words: Column) -> Column:
    """struct(words, url, document_id): the ``url:`` and ``#`` words taken out."""
    urls = F.filter(words, lambda w: w.startswith("url:"))
    ids = F.filter(words, lambda w: w.startswith("#"))
    plain = F.filter(words, lambda w: ~w.startswith("url:") & ~w.startswith("#"))
    return F.struct(plain.alias("words"), F.when(F.size(urls) > 0, F.substring(F.get(urls, F.size(urls) - 1), 5, 1 << 20)).alias("url"), F.when(F.size(ids) > 0, F.substring(F.get(ids, F.size(ids) - 1), 2, 1 << 20)).alias("document_id"))


def publication_date(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "dd MMM yyyy")


def http_date(value: Column) -> Column:
    """Epoch seconds of an HTTP date; null if it is none."""
    clean = F.regexp_replace(F.regexp_replace(value, r"^\w+,\s*", ""), r"\s*GMT$", "")
    return F.unix_timestamp(F.try_to_timestamp(clean, F.lit("dd MMM yyyy HH:mm:ss")))


def content_type(value: Column) -> Column:
    return F.trim(F.get(F.split(value, ";", -1), 0))


def state_bit(state: Column) -> Column:
    """State as one bit: PRIVATE is 0 in the tables and cannot be masked as such."""
    return F.when(state == PRIVATE, PRIVATE_BIT).otherwise(state)


def state_label(state: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(STATE_NAMES), state), F.lit("UNKNOWN"))


def in_mask(state: Column, mask: int) -> Column:
    return state_bit(state).bitwiseAND(F.lit(mask)) != 0


def is_private_ip(ip: Column) -> Column:
    """10/8, 172.16/12 and 192.168/16."""
    part = F.split(ip, r"\.", -1)
    first, second = F.get(part, 0).try_cast("int"), F.get(part, 1).try_cast("int")
    return F.coalesce((first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return ip.startswith("127.")
