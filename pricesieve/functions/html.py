"""HTML to text as column expressions (regex passes; no DOM)."""
from __future__ import annotations

import html as _html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import collapse_ws, match_pieces, pystrip

REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


def reference_names() -> dict[str, str]:
    """Names of the standard list, and the code points below 160 that HTML reads apart
    (control characters, Windows letters), by their decimal number."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return names | {str(i): _html.unescape(f"&#{i};") for i in range(160)}


def unescape(c: Column) -> Column:
    """Decode named and numeric character references, each closed by a semicolon (without
    one a name may be a query parameter of a link); unknown names stay as they are, numbers
    that are no character become U+FFFD.  One pass: decoded text is not decoded again."""
    known = F.str_to_map(F.lit("\u001d".join(f"{k}\u001e{v}" for k, v in reference_names().items())),
                         F.lit("\u001d"), F.lit("\u001e"))

    def decoded(ref: Column) -> Column:
        body = F.substring(ref, 2, F.length(ref) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)) \
            .otherwise(F.substr(body, F.lit(2))).cast("long")
        char = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        number = F.coalesce(F.try_element_at(known, code.cast("string")), char)
        return F.when(body.startswith("#"), number).otherwise(F.coalesce(F.try_element_at(known, body), ref))

    return F.array_join(F.transform(match_pieces(c, REFERENCE),
                                    lambda x, i: F.when(i % 2 == 1, decoded(x)).otherwise(x)), "")


def strip_invisible(html: Column) -> Column:
    """Drop comments and script / style / template blocks."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for t in K.HTML_DROP_BLOCKS:
        c = F.regexp_replace(c, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ")
    return c


def html_text(html: Column) -> Column:
    """Visible text, pieces joined by one space, white space collapsed and stripped."""
    c = F.regexp_replace(strip_invisible(html), r"<[^>]*>", " ")
    return pystrip(collapse_ws(unescape(c)))


def html_blocks(html: Column) -> Column:
    """Plain text with one line per block element; links keep their text, images and
    the head are dropped, spaces collapsed within lines, at most one blank line."""
    c = F.regexp_replace(strip_invisible(html), r"(?is)<head\b[^>]*>.*?</head\s*>", " ")
    blocks = "|".join(K.HTML_BLOCK_TAGS)
    c = F.regexp_replace(c, rf"(?i)</?(?:{blocks})\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    c = unescape(c)
    c = F.regexp_replace(c, r"[ \t\x{a0}]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return pystrip(c)
