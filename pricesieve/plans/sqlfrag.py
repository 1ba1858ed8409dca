"""DuckDB SQL fragments used by the oracle texts (RE2 dialect)."""
from __future__ import annotations

from pricesieve import constants as K
from pricesieve.functions.html import REFERENCE, reference_names

# Python's str.isspace() set, spelled for RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    """SQL string literal (standard quoting, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def unescape(x: str) -> str:
    """Character references decoded: text between them and their values, zipped."""
    names = reference_names()
    table = f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in names.items())}}}"
    code = "(CASE WHEN lower(e[3]) = 'x' THEN CAST('0x' || e[4:-2] AS BIGINT) ELSE CAST(e[3:-2] AS BIGINT) END)"
    dec = f"""CASE WHEN e[2] <> '#' THEN coalesce(known[e[2:-2]], e)
      WHEN {code} < 160 THEN known[CAST({code} AS VARCHAR)]
      WHEN {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(CAST({code} AS INTEGER)) END"""
    dec = dec.replace("known", table)
    rx = q(REFERENCE)
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, {rx}), "
            f"list_append(list_transform(regexp_extract_all({x}, {rx}), lambda e: {dec}), '')), lambda z: z[1] || z[2]), '')")


def drop_invisible(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for t in K.HTML_DROP_BLOCKS:
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    return x


def html_text(x: str) -> str:
    return strip(collapse(unescape(f"regexp_replace({drop_invisible(x)}, '<[^>]*>', ' ', 'g')")))


def html_blocks(x: str) -> str:
    x = f"regexp_replace({drop_invisible(x)}, '(?is)<head\\b[^>]*>.*?</head\\s*>', ' ', 'g')"
    blocks = "|".join(K.HTML_BLOCK_TAGS)
    x = f"regexp_replace({x}, '(?i)</?(?:{blocks})\\b[^>]*>', chr(10), 'g')"
    x = unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    x = f"regexp_replace({x}, '[ \\t\\x{{a0}}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n *', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(x)


def lines_of(src: str, key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    """Numbered stripped lines (blank ones included) of a text table."""
    return f"""(SELECT {key}{extra}, i - 1 AS line_no, {strip('parts[i]')} AS line
     FROM (SELECT *, string_split({text}, chr(10)) AS parts FROM {src}) s,
          generate_series(1, len(parts)) AS g(i))"""


def re2(pattern: str) -> str:
    """A Python pattern for RE2: escaped non-ASCII characters lose their backslash."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and ord(pattern[i + 1]) > 127:
            out.append(pattern[i + 1])
            i += 2
            continue
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)


URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(x: str, k: int) -> str:
    p = f"regexp_extract({x}, '(?s){URL_RE}', {k})"
    return f"lower({p})" if k == 1 else p


def _dots(p: str) -> str:
    p = f"regexp_replace({p}, '/(\\./)+', '/', 'g')"
    p = f"regexp_replace({p}, '/\\.$', '/')"
    for _ in range(4):
        p = f"regexp_replace({p}, '/[^/]+/\\.\\.(/|$)', '/')"
        p = f"regexp_replace({p}, '^/\\.\\.(/|$)', '/')"
    return p


def urljoin(base: str, href: str) -> str:
    """The standard library's urljoin for http(s) bases, written with string functions."""
    bs, bn, bp, bq = (url_part(base, k) for k in (1, 2, 3, 4))
    hs, hp, hq, hf = url_part(href, 1), url_part(href, 3), url_part(href, 4), url_part(href, 5)
    tail = f"(CASE WHEN {hq} <> '' THEN '?' || {hq} ELSE '' END || CASE WHEN {hf} <> '' THEN '#' || {hf} ELSE '' END)"
    merged = f"(CASE WHEN starts_with({hp}, '/') THEN {hp} ELSE regexp_replace({bp}, '[^/]*$', '') || {hp} END)"
    return f"""(CASE WHEN {href} IS NULL THEN NULL
      WHEN {href} = '' THEN {base}
      WHEN {hs} <> '' AND {hs} <> {bs} THEN {href}
      WHEN starts_with({href}, '//') THEN {bs} || ':' || {href}
      WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN {bs} || ':' || regexp_extract({href}, '^[^:]*:(.*)$', 1)
      WHEN {hp} = '' THEN {bs} || '://' || {bn} || {bp}
           || CASE WHEN {hq} <> '' THEN '?' || {hq} WHEN {bq} <> '' THEN '?' || {bq} ELSE '' END
           || CASE WHEN {hf} <> '' THEN '#' || {hf} ELSE '' END
      ELSE {bs} || '://' || {bn} || {_dots(f"(CASE WHEN starts_with({merged}, '/') THEN {merged} ELSE '/' || {merged} END)")}
           || {tail} END)"""
