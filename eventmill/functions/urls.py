"""URL columns: normal forms, domains, ids, file names and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that must not be fetched (private, loopback, link-local, reserved and the like).
_BLOCKED_IPV4 = (
    r"^(?:0|10|127)\.", r"^169\.254\.", r"^172\.(?:1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.", r"^192\.0\.[02]\.",
    r"^198\.(?:18|19)\.", r"^198\.51\.100\.", r"^203\.0\.113\.", r"^2[4-5][0-9]\.",
)
# IPv6 literals that must not be fetched (unspecified, loopback, unique local, link-local, mapped).
_BLOCKED_IPV6 = r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*|2001:db8:.*|100::.*)$"


def normalize_url(c: Column) -> Column:
    """Lower case without scheme, www, trailing slashes, and a query that begins with utm_ or ref."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"^https?://", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^www\.", ""), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\?utm_.*$", ""), r"\?ref=.*$", "")


def extract_domain(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://", ""), r"^www\.", "")
    return F.substring_index(bare, "/", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)


def source_id_from_url(source: Column, url: Column, form: str = "segment") -> Column:
    """``source:name``: the last path segment, the whole path without .html, or the segment decoded and cut to 80."""
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    if form == "path":
        name = F.regexp_replace(path, r"\.html$", "")
    elif form == "decoded":
        name = F.left(F.coalesce(F.try_url_decode(last), last), F.lit(80))
    else:
        name = last
    return F.concat(source, F.lit(":"), name)


def showtime_id(source_id: Column, start: Column, with_time: bool = True) -> Column:
    return F.concat(source_id, F.lit(":"), F.date_format(start, "yyyyMMdd-HHmm" if with_time else "yyyyMMdd"))


def image_file_name(url: Column, slug: Column, date: Column | None = None) -> Column:
    """``slug-hash.ext`` (the URL's stem without a slug), in a folder of year and month if there is a date."""
    leaf = F.element_at(F.split(url_path(url), "/"), -1)
    stem = F.coalesce(F.nullif(slug, F.lit("")), F.nullif(F.regexp_replace(leaf, r"\.[^.]*$", ""), F.lit("")), F.lit("image"))
    ext = F.lower(F.regexp_extract(leaf, r"\.([A-Za-z]{3,4})$", 1))
    name = F.concat(stem, F.lit("-"), F.left(F.md5(url), F.lit(8)), F.lit("."), F.when(ext == "", "jpg").otherwise(ext))
    return name if date is None else F.concat(F.coalesce(F.date_format(date, "yyyy/MM/"), F.lit("")), name)


def is_safe_url(c: Column) -> Column:
    """Whether the scheme is http(s) and the host neither local nor a literal address out of the public ranges."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    v6 = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    blocked = F.lit(False)
    for pattern in _BLOCKED_IPV4:
        blocked = blocked | host.rlike(pattern)
    literal = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    local = host.isin("localhost", "localhost.localdomain") | host.endswith(".localhost")
    ok = c.rlike(r"(?i)^https?://") & (host != "") & ~local & ~(literal & blocked) & ~v6.rlike(_BLOCKED_IPV6)
    return F.coalesce(ok, F.lit(False))


def event_permalink(start: Column, slug: Column) -> Column:
    return F.concat(F.lit("/events/"), F.date_format(start, "yyyy/MM/dd/"), slug, F.lit("/"))


def absolute_url(base: Column, link: Column) -> Column:
    """``link`` as seen from ``base``: absolute, scheme-relative, root-relative, or relative to the base's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z]+:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.concat(site, F.lit("/"), F.regexp_replace(F.regexp_replace(url_path(base), r"[^/]*$", ""), r"^/", ""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .otherwise(F.concat(folder, link))
    )
