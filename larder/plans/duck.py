"""Building blocks of the check SQL, written for DuckDB (RE2 patterns, list lambdas)."""

from __future__ import annotations

_WS_BODY = (r"\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
            r"\x{3000}\x{FEFF}")
WS = rf"[\n{_WS_BODY}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def trim(x: str) -> str:
    return sub(x, rf"^{WS}+|{WS}+$")


def collapse(x: str) -> str:
    return sub(x, f"{WS}+", " ")


def normalise(x: str) -> str:
    x = sub(x, r"\r\n?", "\n")
    x = sub(x, r"\x{A0}", " ")
    x = sub(x, r"[ \t]+", " ")
    x = sub(x, rf"[{_WS_BODY}]+(\n|$)", r"\1")
    return trim(sub(x, r"\n{3,}", "\n\n"))


def half_up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


URL = (r"^([A-Za-z][A-Za-z0-9+.-]*):(?://)?(?:([^/?#]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]*)"
       r"(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$")
TRACKING = (r"^(?i:utm_|fbclid|gclid|igshid|igsh|si$|ref$|ref_src|spm|mc_cid|mc_eid|_t$|_r$"
            r"|is_from_webapp|sender_device)")


def url_parts(src: str, col: str, prefix: str = "u", scheme_default: bool = False) -> str:
    """CTEs ``{prefix}_s`` and ``{prefix}_p``: rows of src plus the split pieces of ``col``."""
    s = trim(col)
    if scheme_default:
        s = (f"CASE WHEN regexp_matches({s}, '(?i)^[a-z][a-z0-9+.-]*:') THEN {s} "
             f"ELSE 'https://' || {s} END")
    g = lambda i: f"regexp_extract(_s, {q(URL)}, {i})"
    return f"""{prefix}_s AS (SELECT *, {s} AS _s FROM {src}),
{prefix}_r AS (SELECT *, lower({g(1)}) AS _scheme, {g(2)} AS _cred, lower({g(3)}) AS _hostname,
  {g(4)} AS _rawport, {g(5)} AS _path, substr({g(6)}, 2) AS _query FROM {prefix}_s),
{prefix}_p AS (SELECT *, CASE WHEN _rawport = CASE _scheme WHEN 'https' THEN '443' ELSE '80' END
  THEN '' ELSE _rawport END AS _port, _scheme IN ('http', 'https') AS _web,
  list_transform(list_filter(string_split(_query, '&'), lambda p: p <> ''),
    lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS _pairs,
  regexp_matches(_hostname, '^(\\[[0-9a-f:.]+\\]|[^\\s#%/:<>?@\\[\\]^|\\\\]+)$') AS _hostok
  FROM {prefix}_r)"""


def identity_key(src: str, col: str, out: str = "key", prefix: str = "u") -> str:
    """CTE chain ending in ``{prefix}_key``: src plus the identity key of ``col``."""
    return url_parts(src, col, prefix) + f""",
{prefix}_h AS (SELECT *, regexp_replace(_hostname || CASE WHEN _port = '' THEN '' ELSE ':' || _port END,
  '^(www|m|mobile)\\.', '') AS _host FROM {prefix}_p),
{prefix}_q AS (SELECT *, CASE
  WHEN _host = 'youtube.com' THEN coalesce(nullif(list_filter(_pairs, lambda p: starts_with(p, 'v='))[1], 'v='), '')
  WHEN regexp_matches(_host, '(^|\\.)(instagram|tiktok|facebook|pinterest)\\.com$') THEN ''
  ELSE coalesce(array_to_string(list_transform(list_sort(list_transform(
    list_filter(_pairs, lambda p: NOT regexp_matches(string_split(p, '=')[1], {q(TRACKING)})),
    lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': p}})), lambda r: r.p), '&'), '') END AS _kept
  FROM {prefix}_h),
{prefix}_key AS (SELECT * EXCLUDE (_s, _scheme, _cred, _hostname, _rawport, _path, _query, _port, _web,
  _pairs, _hostok, _host, _kept), CASE WHEN _web AND _hostok THEN _scheme || '://' || _host ||
  regexp_replace(_path, '/+$', '') || CASE WHEN _kept = '' THEN '' ELSE '?' || _kept END END AS {out}
  FROM {prefix}_q)"""


def classified(src: str, col: str, prefix: str = "c") -> str:
    """CTE chain ending in ``{prefix}_cls``: src plus ok, platform, canonical_url, host, post_id, reason."""
    names = ("utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid igshid igsh si ref "
             "ref_src spm mc_cid mc_eid _t _r is_from_webapp sender_device").split()
    listed = ", ".join(q(n) for n in names)
    short = "'^[A-Za-z0-9_-]{5,32}$'"
    return url_parts(src, col, prefix, scheme_default=True) + f""",
{prefix}_a AS (SELECT *, regexp_replace(_hostname, '\\.$', '') AS _host,
  list_filter(string_split(_path, '/'), lambda s: s <> '') AS _seg,
  CASE WHEN _path = '' THEN '/' ELSE _path END AS _p,
  coalesce(array_to_string(list_filter(_pairs, lambda p: string_split(p, '=')[1] NOT IN ({listed})), '&'), '') AS _clean,
  trim(coalesce({col}, '')) AS _text FROM {prefix}_p),
{prefix}_b AS (SELECT *, CASE WHEN _clean = '' THEN '' ELSE '?' || _clean END AS _qs,
  _hostname || CASE WHEN _port = '' THEN '' ELSE ':' || _port END AS _auth,
  list_filter(list_transform(_seg, lambda s, i: {{'kind': s, 'code': _seg[i + 1]}}),
    lambda x: x.kind IN ('reel', 'reels', 'p', 'tv') AND coalesce(regexp_matches(x.code, {short}), false))[1] AS _post,
  list_position(_seg, 'video') AS _vat,
  CASE WHEN _host = 'youtu.be' THEN _seg[1] WHEN _seg[1] = 'watch' THEN
      substr(list_filter(_pairs, lambda p: starts_with(p, 'v='))[1], 3)
    WHEN _seg[1] IN ('shorts', 'embed', 'live') THEN _seg[2] END AS _yt FROM {prefix}_a),
{prefix}_k AS (SELECT *, CASE WHEN _text = '' THEN 'blank'
  WHEN _scheme = '' OR (_web AND NOT _hostok) THEN 'malformed' WHEN NOT _web THEN 'scheme'
  WHEN _cred <> '' THEN 'credentials' WHEN _port NOT IN ('', '80', '443') THEN 'port'
  WHEN _host IN ('instagram.com', 'www.instagram.com', 'm.instagram.com') THEN
    CASE WHEN _seg[1] = 'share' THEN 'ig_share' WHEN _post IS NOT NULL THEN 'ig_post' ELSE 'instagram' END
  WHEN _host IN ('tiktok.com', 'www.tiktok.com', 'm.tiktok.com', 'vm.tiktok.com', 'vt.tiktok.com') THEN
    CASE WHEN _vat > 1 AND regexp_matches(_seg[_vat + 1], '^[0-9]{{6,25}}$') THEN 'tt_video'
      WHEN _host IN ('vm.tiktok.com', 'vt.tiktok.com') OR _seg[1] = 't' THEN 'tt_short' ELSE 'tiktok' END
  WHEN _host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com', 'youtu.be') THEN
    CASE WHEN regexp_matches(_yt, {short}) THEN 'yt' ELSE 'youtube' END
  WHEN _host IN ('localhost', 'metadata.google.internal', 'instance-data')
    OR regexp_matches(_host, '\\.(local|internal|localdomain|home\\.arpa|lan)$') THEN 'blocked'
  WHEN NOT contains(_host, '.') THEN 'no_dot' ELSE 'web' END AS _kind FROM {prefix}_b),
{prefix}_cls AS (SELECT * EXCLUDE (_s, _scheme, _cred, _hostname, _rawport, _path, _query, _port, _web, _pairs,
  _hostok, _host, _seg, _p, _clean, _text, _qs, _auth, _post, _vat, _yt, _kind),
  _kind IN ('ig_share', 'ig_post', 'tt_video', 'tt_short', 'yt', 'web') AS ok,
  CASE _kind WHEN 'ig_share' THEN 'instagram' WHEN 'ig_post' THEN 'instagram' WHEN 'tt_video' THEN 'tiktok'
    WHEN 'tt_short' THEN 'tiktok' WHEN 'yt' THEN 'youtube' WHEN 'web' THEN 'web' END AS platform,
  CASE _kind WHEN 'ig_share' THEN _scheme || '://' || _auth || _p || _qs
    WHEN 'ig_post' THEN 'https://www.instagram.com/' || CASE _post.kind WHEN 'p' THEN 'p' ELSE 'reel' END || '/' || _post.code || '/'
    WHEN 'tt_video' THEN 'https://www.tiktok.com/' || CASE WHEN starts_with(_seg[1], '@') THEN '' ELSE '@' END || _seg[1] || '/video/' || _seg[_vat + 1]
    WHEN 'tt_short' THEN 'https://' || _host || _p WHEN 'yt' THEN 'https://www.youtube.com/watch?v=' || _yt
    WHEN 'web' THEN 'https://' || CASE WHEN _port = '443' THEN _hostname ELSE _auth END || _p || _qs END AS canonical_url,
  CASE WHEN _kind IN ('ig_share', 'ig_post', 'tt_video', 'tt_short', 'yt', 'web') THEN _host END AS host,
  CASE _kind WHEN 'ig_post' THEN _post.code WHEN 'tt_video' THEN _seg[_vat + 1] WHEN 'yt' THEN _yt END AS post_id,
  CASE _kind WHEN 'blank' THEN 'No URL to import.' WHEN 'malformed' THEN 'That does not look like a URL.'
    WHEN 'scheme' THEN 'Only http(s) links can be imported.'
    WHEN 'credentials' THEN 'Links with embedded credentials are not accepted.'
    WHEN 'port' THEN 'Only standard web ports are accepted.' WHEN 'blocked' THEN 'That host is not reachable from here.'
    WHEN 'no_dot' THEN 'That does not look like a public website.'
    WHEN 'instagram' THEN 'That Instagram link is not a post or reel.' WHEN 'tiktok' THEN 'That TikTok link is not a video.'
    WHEN 'youtube' THEN 'That YouTube link is not a single video.' END AS reason FROM {prefix}_k)"""


GLYPHS = {"½": "0.5", "⅓": "0.3333333333333333", "⅔": "0.6666666666666666", "¼": "0.25", "¾": "0.75",
          "⅕": "0.2", "⅖": "0.4", "⅗": "0.6", "⅘": "0.8", "⅙": "0.16666666666666666",
          "⅚": "0.8333333333333334", "⅛": "0.125", "⅜": "0.375", "⅝": "0.625", "⅞": "0.875"}


def parse_qty(x: str) -> str:
    s = x
    for g, v in GLYPHS.items():
        s = f"replace({s}, '{g}', ' {v} ')"
    s = trim(collapse(s))
    num = lambda p, i: f"TRY_CAST(regexp_extract(_v, '{p}', {i}) AS DOUBLE)"
    mixed, frac = r"^(\d+)\s+(\d+)\s*/\s*(\d+)$", r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"
    return (f"list_transform([{s}], lambda _v: CASE WHEN regexp_matches(_v, '^\\d+([.,]\\d+)?$') "
            f"THEN TRY_CAST(replace(_v, ',', '.') AS DOUBLE) WHEN regexp_matches(_v, '{frac}') THEN "
            f"{num(frac, 1)} / nullif({num(frac, 2)}, 0) WHEN regexp_matches(_v, '{mixed}') THEN "
            f"{num(mixed, 1)} + {num(mixed, 2)} / nullif({num(mixed, 3)}, 0) END)[1]")


def snap(x: str) -> str:
    """Value of a number after it was written as kitchen text."""
    tries = " ".join(
        f"WHEN floor((_r - floor(_r)) * {d} + 0.5) BETWEEN 1 AND {d - 1} AND "
        f"abs((_r - floor(_r)) - floor((_r - floor(_r)) * {d} + 0.5) / {d}.0::DOUBLE) < 0.02 "
        f"THEN floor(_r) + floor((_r - floor(_r)) * {d} + 0.5) / {d}.0::DOUBLE" for d in (2, 3, 4, 6, 8))
    return (f"list_transform([floor(({x}) * 1000 + 0.5) / 1000], lambda _r: CASE WHEN _r = floor(_r) "
            f"THEN _r {tries} ELSE floor(_r * 10 + 0.5) / 10 END)[1]")


def format_qty(x: str) -> str:
    whole = "CAST(CAST(floor(_r) AS BIGINT) AS VARCHAR)"
    tries = " ".join(
        f"WHEN floor((_r - floor(_r)) * {d} + 0.5) BETWEEN 1 AND {d - 1} AND "
        f"abs((_r - floor(_r)) - floor((_r - floor(_r)) * {d} + 0.5) / {d}.0::DOUBLE) < 0.02 "
        f"THEN CASE WHEN floor(_r) > 0 THEN {whole} || ' ' ELSE '' END || "
        f"CAST(CAST(floor((_r - floor(_r)) * {d} + 0.5) AS BIGINT) AS VARCHAR) || '/{d}'"
        for d in (2, 3, 4, 6, 8))
    tenth = "CAST(floor(_r * 10 + 0.5) AS BIGINT)"
    return (f"list_transform([floor(({x}) * 1000 + 0.5) / 1000], lambda _r: CASE WHEN _r IS NULL OR _r <= 0 "
            f"THEN '' WHEN _r = floor(_r) THEN {whole} {tries} WHEN {tenth} % 10 = 0 THEN "
            f"CAST({tenth} // 10 AS VARCHAR) ELSE CAST({tenth} // 10 AS VARCHAR) || '.' || "
            f"CAST({tenth} % 10 AS VARCHAR) END)[1]")


LEADING = (r"^((?:\d+\s+\d+\s*/\s*\d+)|(?:\d+\s*/\s*\d+)|(?:\d+(?:[.,]\d+)?)|[½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞])\s+(.+)$")


def lead(x: str) -> str:
    return parse_qty(f"nullif(regexp_extract({trim(x)}, {q(LEADING)}, 1), '')")


def rest(x: str) -> str:
    return (f"CASE WHEN regexp_matches({trim(x)}, {q(LEADING)}) THEN "
            f"{trim(f'regexp_extract({trim(x)}, {q(LEADING)}, 2)')} ELSE {trim(x)} END")


def merge_key(x: str) -> str:
    return collapse(sub(f"lower({trim(x)})", "[^a-z0-9 ]"))


def cap(x: str, n: int) -> str:
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE "
            f"{sub(f'substr({x}, 1, {n - 1})', rf'{WS}+$')} || '…' END")


NUM = rf"(?:\d+(?:[.,]\d+)?(?:{WS}*/{WS}*\d+)?|\d+{WS}+\d+{WS}*/{WS}*\d+|[½⅓⅔¼¾⅛⅜⅝⅞])"
UNIT = (r"(?:g|kg|ml|l|oz|lb|lbs|cup|cups|tsp|tbsp|teaspoons?|tablespoons?|cloves?|pinch|handful|slices?|sticks?"
        r"|cans?|tins?|pints?|quarts?|mins?|minutes?|hrs?|hours?|scoops?|sprigs?|bunch|dash|pkg|packets?)")
VERB = (r"(?i)\b(?:preheat|bake|baked|baking|mix|stir|whisk|fold|chop|dice|diced|mince|minced|saut[ée]|fry"
        r"|air[- ]?fry|boil|simmer|roast|grill|blend|marinate|season|drain|knead|pour|combine|garnish|sprinkle"
        r"|toss|serve|serves|cook|cooked|heat|melt|spread|layer|refrigerate|chill|rest|sear|steam|whip|coat|brush"
        r"|skillet|oven|saucepan)\b")
HEADING = (r"(?i)\b(?:ingredients?|method|directions?|instructions?|steps?|you(?:'|’)?ll need|what you need"
           r"|shopping list|recipe below|full recipe)\b")


def clean_for_score(x: str) -> str:
    return sub(normalise(x), rf"(^|{WS})#[\p{{L}}\p{{N}}_]+", " ")


def score_of_clean(c: str) -> str:
    return f"""CASE WHEN coalesce(length({c}), 0) < 40 THEN 0.0::DOUBLE ELSE
  least(len(regexp_extract_all({c}, {q(rf"(?i)(?:^|{WS}|[(\[]){NUM}{WS}*-?{WS}*{UNIT}\b")})), 8) * 0.9::DOUBLE
  + least(len(list_filter(string_split({c}, chr(10)), lambda l: regexp_matches(l,
      {q(rf"^{WS}*(?:[-*•–—·▪\x{{FE0F}}>]|\d+[.)])?{WS}*{NUM}{WS}*[^\n{_WS_BODY}]")}))), 8) * 0.6::DOUBLE
  + least(len(list_distinct(list_transform(regexp_extract_all({c}, {q(VERB)}), lambda v: lower(v)))), 8) * 0.45::DOUBLE
  + least(len(regexp_extract_all({c}, {q(HEADING)})), 3) * 1.2::DOUBLE
  + CASE WHEN length({c}) > 350 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END END"""


ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
            "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "eacute": "é", "egrave": "è",
            "agrave": "à", "ccedil": "ç", "ouml": "ö", "uuml": "ü", "auml": "ä", "deg": "°", "frac12": "½",
            "frac14": "¼", "frac34": "¾", "middot": "·", "bull": "•", "copy": "©", "reg": "®", "trade": "™",
            "times": "×"}


def decode(x: str) -> str:
    """Numeric, then named references (splitting at ``&`` makes each a single pass)."""
    dec = (f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i > 1 AND "
           f"regexp_matches(p, '^#[0-9]{{1,7}};') THEN chr(CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INTEGER)) || "
           f"regexp_replace(p, '^#[0-9]+;', '') WHEN i > 1 THEN '&' || p ELSE p END), '')")
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ENTITIES.items())
    name = "lower(regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1))"
    named = f"CASE {name} {whens} END"
    return (f"array_to_string(list_transform(string_split({dec}, '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {named} "
            f"IS NOT NULL THEN {named} || regexp_replace(p, '^[A-Za-z][A-Za-z0-9]*;', '') ELSE '&' || p END), '')")


def drop_non_text(x: str) -> str:
    tags = "script style noscript svg iframe template form nav footer header aside".split()
    alts = "|".join(rf"{t}\b[^>]*>.*?(?:</{t}[^>]*(?:>|$)|$)" for t in tags)
    return sub(x, f"(?is)<(?:{alts})", " ")


def html_text(x: str) -> str:
    s = sub(drop_non_text(x), r"(?s)<!--.*?-->", " ")
    s = sub(s, r"(?i)<br\s*/?>", "\n")
    s = sub(s, r"(?i)</(?:p|div|li|tr|h[1-6]|section|article|ul|ol|blockquote)\s*>", "\n")
    s = sub(s, r"(?i)<li\b[^>]*>", "\n- ")
    s = sub(s, r"<[^>]+>", " ")
    return normalise(sub(decode(s), r"[ \t]{2,}", " "))


def title(x: str) -> str:
    raw = f"nullif(regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1), '')"
    return trim(collapse(decode(raw)))
