"""URLs and titles: canonical forms, hashes, hosts."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache
from urllib.parse import parse_qsl, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track. Names in any case; PREFIXES by their beginning; HOSTS on one host only.
TRACKING = {
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "igsh", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "referrer", "source", "spm", "scid", "cmpid", "campaign_id",
    "at_medium", "at_campaign", "s_kwcid", "vero_id", "vero_conv", "trk", "sc_channel", "sc_campaign", "amp", "usp",
}
PREFIXES = ("utm_", "_hs", "pk_", "piwik_", "matomo_")
HOSTS = {"youtube.com": {"si", "pp", "feature"}, "youtu.be": {"si", "t"}, "open.spotify.com": {"si"}}
AMP_CACHE = ".cdn.ampproject.org"


@cache
def tracker(host: str) -> re.Pattern:
    """Names of query parameters that go on a host."""
    names = sorted(TRACKING | HOSTS.get(host, set()))
    return re.compile("|".join([*map(re.escape, names), *(re.escape(p) + ".*" for p in PREFIXES)]), re.I | re.S)


def plain_path(path: str) -> str:
    """A path without the marks of its accelerated form: a segment `amp` at the end, the first one inside, and the ending .amp."""
    head, *parts = path.split("/")
    is_amp = [p.lower() == "amp" for p in parts]
    last = len(parts) - 1 if parts and parts[-1] else len(parts) - 2  # of the segments that have a name
    if last >= 0 and is_amp[last]:
        parts[last:], is_amp[last:] = [""], [False]
    if True in is_amp[:-1]:
        del parts[is_amp.index(True)]
    if parts:
        stem, dot, ending = parts[-1].rpartition(".")
        if dot and ending.lower() in ("htm", "html") and stem.lower().endswith(".amp"):
            parts[-1] = stem[: -len(".amp")] + dot + ending
        elif parts[-1].lower().endswith(".amp"):
            parts[-1] = parts[-1][: -len(".amp")]
    return "/".join([head, *parts])


def canonical_url(raw: str | None) -> str | None:
    """https, lower-case host without www., port and fragment; AMP forms resolved; tracking parameters gone, the rest sorted.

    None for null, for what isn't http(s) and for what can't be read.
    """
    try:
        parts = urlsplit((raw or "").strip())
        host = (parts.hostname or "").lower()
        parts.port  # noqa: B018  raises for a bad port
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not host or re.search(r"[\s<>^|]", host):
        return None
    path, query = parts.path or "/", parts.query
    cached = re.match(r"/[cvia]/(?:s/)?([^/]+)(/.*)?$", path) if host.endswith(AMP_CACHE) else None
    if cached:
        host, path = cached[1].lower(), cached[2] or "/"
    host = host.removeprefix("www.").removeprefix("amp.")
    path = plain_path(path)
    path = re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    goes = tracker(host if host in HOSTS else "").fullmatch
    kept = sorted(((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not goes(k)), key=lambda x: x[0])
    form = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    return f"https://{host}{path}" + ("?" + "&".join(f"{form(k)}={form(v)}" for k, v in kept) if kept else "")


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def title_key(title: str | None) -> str | None:
    """A title for comparison: compatibility forms unified, lower case, without signs and white space. None if nothing is left."""
    key = re.sub(r"[!-/:-@\[-`{-~、-〜「」『』・]|\s", "", unicodedata.normalize("NFKC", title or "").lower())
    return key or None


@F.pandas_udf(T.StringType())
def canonical(url: pd.Series) -> pd.Series:
    return url.map(canonical_url)


@F.pandas_udf(T.StringType())
def title_hash(title: pd.Series) -> pd.Series:
    return title.map(lambda t: (k := title_key(t)) and short_hash(k))


def url_hash(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 32)


def domain(column: Column) -> Column:
    """Host of a canonical URL."""
    return F.regexp_extract(column, r"^https://([^/?]+)", 1)


def canonical_builtin(column: Column) -> Column:
    """The common part of `canonical` without Python: scheme, host case, www., port, fragment, trailing slash; the query as it is."""
    bare = F.regexp_replace(column, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?)://(?:www\.)?([^/:?]+)", 1))
    rest = F.regexp_extract(bare, r"^(?i:https?)://[^/?]+([^?]*)", 1)
    query = F.regexp_extract(bare, r"(\?.+)$", 1)
    path = F.regexp_replace(rest, r"/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), query))


def host_as_written(column: Column) -> Column:
    """What stands between the scheme and the next slash, with port, www. and case."""
    return F.when(F.instr(column, "://") > 0, F.substring_index(F.substring_index(column, "://", -1), "/", 1)).otherwise(F.substring_index(column, "/", 1))


def light(column: Column) -> Column:
    """Without fragment and one trailing slash: for a check whether a URL exists."""
    return F.regexp_replace(F.regexp_replace(column, r"#.*$", ""), r"/$", "")


def allowed(column: Column) -> Column:
    """http and https only; false for null."""
    return F.coalesce(column.rlike(r"^(?i)https?://[^\s/]+"), F.lit(False))
