"""Link hygiene expressions: identity key, classification, extraction.

A link is split once with a regular expression (``try_parse_url`` rejects paths
with spaces). Default ports are dropped and hosts lower-cased; path folding,
punycode and percent re-encoding are left as received.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import NOT_WS, WS, let, trim

# Hosts whose path alone identifies the content.
PATH_IDENTIFIED = ("instagram.com", "tiktok.com", "facebook.com", "pinterest.com")
# Tracking keys, as a prefix pattern for the identity key ...
TRACKING_KEY = (
    r"(?i)^(utm_|fbclid|gclid|igshid|igsh|si$|ref$|ref_src|spm|mc_cid|mc_eid|_t$|_r$"
    r"|is_from_webapp|sender_device)"
)
# ... and as exact names for the cleaned website link.
TRACKING_NAMES = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "igshid", "igsh", "si", "ref", "ref_src", "spm",
    "mc_cid", "mc_eid", "_t", "_r", "is_from_webapp", "sender_device",
)
# Hosts per platform, blocked names and suffixes, id shapes.
INSTAGRAM_HOSTS = ("instagram.com", "www.instagram.com", "m.instagram.com")
TIKTOK_HOSTS = (
    "tiktok.com", "www.tiktok.com", "m.tiktok.com", "vm.tiktok.com", "vt.tiktok.com",
)
YOUTUBE_HOSTS = (
    "youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be",
)
BLOCKED_NAMES = ("localhost", "metadata.google.internal", "instance-data")
BLOCKED_SUFFIXES = (".local", ".internal", ".localdomain", ".home.arpa", ".lan")
SHORTCODE = r"^[A-Za-z0-9_-]{5,32}\z"
VIDEO_ID = r"^\d{6,25}\z"
# Rejection sentences.
REASON = {
    "blank": "No URL to import.",
    "malformed": "That does not look like a URL.",
    "scheme": "Only http(s) links can be imported.",
    "credentials": "Links with embedded credentials are not accepted.",
    "port": "Only standard web ports are accepted.",
    "blocked": "That host is not reachable from here.",
    "no_dot": "That does not look like a public website.",
    "instagram": "That Instagram link is not a post or reel.",
    "tiktok": "That TikTok link is not a video.",
    "youtube": "That YouTube link is not a single video.",
}

_URL = (
    r"^([A-Za-z][A-Za-z0-9+.-]*):(?://)?(?:([^/?#]*)@)?"
    r"(\[[0-9A-Fa-f:.]+\]|[^/?#:]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?\z"
)
_HOST_OK = r"""^(?:\[[0-9a-f:.]+\]|[^\s#%/:<>?@\[\\\]^|]+)\z"""


def _with_parts(raw: Column, body: Callable[[UrlParts], Column]) -> Column:
    """``body`` over the pieces of an absolute URL, split once."""

    def tidy(pieces: Column) -> Column:
        raw_scheme, credentials, raw_host, raw_port, path, query = (
            F.get(pieces, F.lit(i)) for i in range(6))
        scheme, hostname = F.lower(raw_scheme), F.lower(raw_host)
        default = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
        web = scheme.isin("http", "https")
        return F.struct(
            scheme.alias("scheme"), hostname.alias("hostname"),
            credentials.alias("credentials"), path.alias("path"),
            F.when(raw_port == default, F.lit("")).otherwise(raw_port).alias("port"),
            F.substring(query, 2, 1 << 30).alias("query"), F.coalesce(web, F.lit(False)).alias("web"),
            ((F.size(pieces) == 6)
             & (~web | F.regexp_like(hostname, F.lit(_HOST_OK)))).alias("ok"))

    # One match per link: the groups come back joined by a mark no URL contains.
    text = F.translate(trim(raw), "\t\n\r\x01", "")
    marked = F.regexp_replace(text, _URL, "\x01".join(f"${i}" for i in range(1, 7)))
    return let(let(F.split(marked, "\x01"), tidy), lambda p: body(UrlParts(p)))


class UrlParts:
    """Named access to the split pieces; ``ok`` is false when the URL is malformed."""

    def __init__(self, p: Column):
        self.scheme, self.credentials, self.hostname = p["scheme"], p["credentials"], p["hostname"]
        self.port, self.path, self.query = p["port"], p["path"], p["query"]
        self.web, self.ok = p["web"], p["ok"]
        self.host = F.when(self.port == "", self.hostname).otherwise(
            F.concat(self.hostname, F.lit(":"), self.port))


def _pairs(query: Column) -> Column:
    """Query pieces in order; a bare key gets its ``=``."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _with_query(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def canonical_url(raw: Column) -> Column:
    """Identity key of a link; NULL unless it is an absolute http(s) URL."""

    def key_of(u: UrlParts) -> Column:
        base_host = F.regexp_replace(u.host, r"^(?:www|m|mobile)\.", "")
        path = F.regexp_replace(u.path, r"(?<!/)/++\z", "")
        return F.when(u.ok & u.web, let(base_host, lambda host: _with_query(
            F.concat(u.scheme, F.lit("://"), host, path),
            F.when(u.query == "", F.lit("")).otherwise(_identity_query(host, u.query)))))

    return _with_parts(raw, key_of)


def _identity_query(host: Column, query: Column) -> Column:
    """The part of the query that identifies content, by host rule."""
    path_only = reduce(
        lambda a, b: a | b,
        [(host == h) | F.endswith(host, F.lit("." + h)) for h in PATH_IDENTIFIED])
    video = F.try_element_at(
        F.filter(_pairs(query), lambda p: F.startswith(p, F.lit("v="))), F.lit(1))
    kept = F.filter(_pairs(query), lambda p: ~F.regexp_like(_key(p), F.lit(TRACKING_KEY)))
    # Sorting on (key, position) keeps repeated keys in the order received.
    ranked = F.array_sort(F.transform(
        kept, lambda p, i: F.struct(_key(p).alias("k"), i.alias("i"), p.alias("p"))))
    return (
        F.when(host == "youtube.com", F.coalesce(F.nullif(video, F.lit("v=")), F.lit("")))
        .when(path_only, F.lit(""))
        .otherwise(F.array_join(F.transform(ranked, lambda r: r["p"]), "&")))


def host_of(raw: Column) -> Column:
    """Display host: no leading ``www.``; empty text when it is not a URL."""
    shown = _with_parts(raw, lambda u: F.when(u.ok, F.regexp_replace(u.host, r"^www\.", "")))
    return F.coalesce(shown, F.lit(""))


def _segments(path: Column) -> Column:
    def decoded(s: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)

    return F.filter(F.transform(F.split(path, "/"), decoded), lambda s: s != "")


def _struct(ok: bool, platform, url, host, ident, reason) -> Column:
    def text(v) -> Column:
        return v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        F.lit(ok).alias("ok"), text(platform).alias("platform"), text(url).alias("canonical_url"),
        text(host).alias("host"), text(ident).alias("id"), text(reason).alias("reason"))


def _reject(reason: str) -> Column:
    return _struct(False, None, None, None, None, REASON[reason])


def classify(raw: Column) -> Column:
    """``STRUCT<ok, platform, canonical_url, host, id, reason>`` for one link."""

    def guarded(u: UrlParts) -> Column:
        return (
            F.when(~u.ok, _reject("malformed"))
            .when(~u.web, _reject("scheme"))
            .when(u.credentials != "", _reject("credentials"))
            .when(~u.port.isin("", "80", "443"), _reject("port"))
            .otherwise(let(F.regexp_replace(u.hostname, r"\.\z", ""), lambda h: by_host(u, h))))

    def by_host(u: UrlParts, host: Column) -> Column:
        path = F.when(u.path == "", F.lit("/")).otherwise(u.path)
        clean = F.array_join(
            F.filter(_pairs(u.query), lambda p: ~_key(p).isin(*TRACKING_NAMES)), "&")
        segments = _segments(u.path)
        return (
            F.when(host.isin(*INSTAGRAM_HOSTS), let(
                segments, lambda seg: _instagram(u, host, path, clean, seg)))
            .when(host.isin(*TIKTOK_HOSTS), let(segments, lambda seg: _tiktok(host, path, seg)))
            .when(host.isin(*YOUTUBE_HOSTS), let(segments, lambda seg: _youtube(u, host, seg)))
            .otherwise(_website(u, host, path, clean)))

    def with_scheme(text: Column) -> Column:
        has_scheme = F.regexp_like(text, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:"))
        return F.when(has_scheme, text).otherwise(F.concat(F.lit("https://"), text))

    text = F.coalesce(trim(raw), F.lit(""))
    return let(text, lambda t: F.when(t == "", _reject("blank")).otherwise(
        _with_parts(with_scheme(t), guarded)))


def _instagram(u: UrlParts, host: Column, path: Column, clean: Column, seg: Column) -> Column:
    # A share token is spelled like a post id, so the share form is tested first.
    shared = _with_query(F.concat(u.scheme, F.lit("://"), u.host, path), clean)
    neighbours = F.transform(seg, lambda s, i: F.struct(
        s.alias("kind"), F.get(seg, i + 1).alias("code")))
    posts = F.filter(neighbours, lambda p: (
        p["kind"].isin("reel", "reels", "p", "tv")
        & F.coalesce(F.regexp_like(p["code"], F.lit(SHORTCODE)), F.lit(False))))

    def post_url(post: Column) -> Column:
        kind = F.when(post["kind"] == "p", F.lit("p")).otherwise(F.lit("reel"))
        url = F.concat(
            F.lit("https://www.instagram.com/"), kind, F.lit("/"), post["code"], F.lit("/"))
        return F.when(post.isNull(), _reject("instagram")).otherwise(
            _struct(True, "instagram", url, host, post["code"], None))

    return F.when(F.get(seg, F.lit(0)) == "share", _struct(
        True, "instagram", shared, host, None, None)).otherwise(
        let(F.get(posts, F.lit(0)), post_url))


def _tiktok(host: Column, path: Column, seg: Column) -> Column:
    first = F.get(seg, F.lit(0))
    user = F.when(F.startswith(first, F.lit("@")), first).otherwise(F.concat(F.lit("@"), first))

    def video(at: Column) -> Column:
        ident = F.when(at > 1, F.get(seg, at))
        url = F.concat(F.lit("https://www.tiktok.com/"), user, F.lit("/video/"), ident)
        return (
            F.when(F.regexp_like(ident, F.lit(VIDEO_ID)),
                   _struct(True, "tiktok", url, host, ident, None))
            .when(host.isin("vm.tiktok.com", "vt.tiktok.com") | (first == "t"), _struct(
                True, "tiktok", F.concat(F.lit("https://"), host, path), host, None, None))
            .otherwise(_reject("tiktok")))

    return let(F.array_position(seg, F.lit("video")).cast("int"), video)


def _youtube(u: UrlParts, host: Column, seg: Column) -> Column:
    first = F.get(seg, F.lit(0))
    v = F.substring(F.get(
        F.filter(_pairs(u.query), lambda p: _key(p) == "v"), F.lit(0)), 3, 1 << 30)
    ident = (
        F.when(host == "youtu.be", first)
        .when(first == "watch", v)
        .when(first.isin("shorts", "embed", "live"), F.get(seg, F.lit(1))))
    return let(ident, lambda i: F.when(F.regexp_like(i, F.lit(SHORTCODE)), _struct(
        True, "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), i), host, i, None,
    )).otherwise(_reject("youtube")))


def _website(u: UrlParts, host: Column, path: Column, clean: Column) -> Column:
    blocked = reduce(
        lambda a, b: a | b,
        [F.endswith(host, F.lit(s)) for s in BLOCKED_SUFFIXES], host.isin(*BLOCKED_NAMES))
    # Upgrading to https also drops the port that is then the default one.
    authority = F.when(u.port == "443", u.hostname).otherwise(u.host)
    url = _with_query(F.concat(F.lit("https://"), authority, path), clean)
    return (
        F.when(blocked, _reject("blocked"))
        .when(~F.contains(host, F.lit(".")), _reject("no_dot"))
        .otherwise(_struct(True, "web", url, host, None, None)))


def extract_urls(text: Column) -> Column:
    """Links in free text, in order, deduplicated, trailing punctuation removed."""
    found = F.regexp_extract_all(
        text, F.lit(rf"""(?i)https?://(?:(?![<>"'`]){NOT_WS})+"""), F.lit(0))
    trimmed = F.transform(
        found, lambda u: F.regexp_replace(u, r"""[),.;:!?'"»”]+\z""", ""))
    return F.array_distinct(
        F.filter(trimmed, lambda u: F.regexp_like(u, F.lit(r"(?i)^https?://"))))


def utf16_slice(text: Column, offset: Column, length: Column) -> Column:
    """Part of a text by UTF-16 units, as chat services count; halves of a pair are dropped."""
    digits = F.substring(F.hex(F.encode(text, "UTF-16BE")), 4 * offset + 1, 4 * length)
    whole = F.regexp_replace(F.regexp_replace(digits, "^D[C-F]..", ""), "D[89AB]..$", "")
    return F.decode(F.unhex(whole), "UTF-16BE")


def message_urls(text: Column, entities: Column) -> Column:
    """Links of a message, in order, without repeats.

    ``entities`` (type, offset, length, url) are the spans the service marked: a
    ``url`` is its visible text, a ``text_link`` brings an address of its own.
    The text is only searched where they give none.
    """
    marked = F.filter(entities, lambda e: e["type"].isin("url", "text_link"))
    raw = F.transform(marked, lambda e: F.when(e["type"] == "text_link", e["url"]).otherwise(
        utf16_slice(text, e["offset"], e["length"])))
    first = F.transform(raw, lambda u: F.regexp_replace(
        F.regexp_extract(u, f"^{WS}*({NOT_WS}*)", 1), r"""[),.;:!?'"»”]+\z""", ""))
    listed = F.array_distinct(F.filter(first, lambda u: F.regexp_like(u, F.lit(r"(?i)^https?://"))))
    return F.when(F.size(listed) > 0, listed).otherwise(extract_urls(text))


# IPv4 ranges that are not globally routable, as (first, prefix length).
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.0.0", 16), ("100.64.0.0", 10),
    ("198.18.0.0", 15), ("224.0.0.0", 3),
)


def _v4_number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def is_private_ip(ip: Column) -> Column:
    """True unless the text is a globally routable literal address."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4_pattern = rf"^{octet}\.{octet}\.{octet}\.{octet}\z"

    def v4_private(text: Column) -> Column:
        octets = F.transform(F.split(text, r"\."), lambda o: o.try_cast("long"))
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
        return let(number, lambda n: reduce(lambda a, b: a | b, [
            n.between(_v4_number(lo), _v4_number(lo) + (1 << (32 - bits)) - 1)
            for lo, bits in PRIVATE_V4]))

    def v6_shaped(s: Column) -> Column:
        groups = F.size(F.split(s, ":"))
        full = (groups == 8) & ~F.contains(s, F.lit("::"))
        shortened = (groups <= 9) & (F.size(F.split(s, "::")) == 2)
        return (
            F.regexp_like(s, F.lit(r"^[0-9a-f:]+(?:\d+\.\d+\.\d+\.\d+)?\z"))
            & (full | shortened) & ~F.regexp_like(s, F.lit(r"[0-9a-f]{5}")))

    def v6_private(s: Column) -> Column:
        mapped = F.regexp_extract(s, r"^::ffff:(\d+\.\d+\.\d+\.\d+)\z", 1)
        return F.when(~v6_shaped(s), F.lit(True)).otherwise(
            s.isin("::", "::1") | F.regexp_like(s, F.lit(r"^f(?:[cd]|e[89ab]|f)"))
            | let(mapped, lambda m: F.when(m == "", F.lit(False)).otherwise(v4_private(m))))

    is_v4 = F.regexp_like(ip, F.lit(v4_pattern))
    return F.when(is_v4, v4_private(ip)).otherwise(
        F.coalesce(let(F.substring_index(F.lower(ip), "%", 1), v6_private), F.lit(True)))
