"""Column functions on text taken from pages: cleaning, line handling, clipping, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, letters that draw nothing, and characters that are removed.
BLANK = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{115F}\x{1160}\x{3164}\x{FFA0}"
# Anything but ASCII and the letters and signs of U+00A1 to U+024F, all of which draw something or are blank.
_RARE = r"\x00-\x08\x0E-\x1F\x7F-\xA0\xAD\x{250}-\x{10FFFF}"
INVISIBLE = rf"[{_RARE}&&[\p{{Cc}}\p{{Cf}}\p{{Co}}\x{{FE00}}-\x{{FE0F}}\x{{180B}}-\x{{180D}}\x{{180F}}\x{{34F}}\x{{17B4}}\x{{17B5}}\x{{2065}}\x{{FFF0}}-\x{{FFF8}}\x{{E0000}}-\x{{E0FFF}}&&[^{BLANK}\x{{600}}-\x{{605}}\x{{6DD}}\x{{70F}}\x{{890}}\x{{891}}\x{{8E2}}\x{{110BD}}\x{{110CD}}]]]"
JOINING = r"\p{IsArabic}\p{IsSyriac}\p{IsNko}\p{IsMongolian}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{So}\x{1F3FB}-\x{1F3FF}"
_HELD = "﷐﷑"
_JOINERS = "‌‍"


def strip_invisible(s: Column) -> Column:
    """``s`` without characters that draw nothing; joiners stay between joining letters or emoji."""
    for joiner, held in zip(_JOINERS, _HELD, strict=True):
        s = F.regexp_replace(s, rf"([{JOINING}]){joiner}(?=[{JOINING}])", "$1" + held)
    return F.translate(F.regexp_replace(s, INVISIBLE, ""), _HELD, _JOINERS)


_UNUSUAL = f"[{_RARE}]"


def clean(s: Column) -> Column:
    """One line of plain words: runs of white space are one space, edges are trimmed, and
    characters that draw nothing are gone. Null stays null. Texts of plain letters, which one
    scan tells, take one replacement instead of four."""
    plain = F.trim(F.regexp_replace(s, r"[\t-\r ]+", " "))
    return F.when(s.rlike(_UNUSUAL), F.trim(F.regexp_replace(strip_invisible(s), f"[{BLANK}]+", " "))).otherwise(plain)


def collapse(s: Column) -> Column:
    """``clean`` with one space kept at each edge that had white space; blank text is one space."""
    body = clean(s)
    head = F.when(s.rlike(f"^[{BLANK}]"), " ").otherwise("")
    tail = F.when(s.rlike(f"[{BLANK}]$"), " ").otherwise("")
    return F.when(s == "", "").when(body == "", " ").otherwise(F.concat(head, body, tail))


def href(s: Column) -> Column:
    """A cleaned address as one token, its spaces percent-encoded."""
    return F.replace(clean(s), F.lit(" "), F.lit("%20"))


def flatten(s: Column) -> Column:
    """``s`` on one line: line breaks become spaces, tabs and runs of spaces stay."""
    broken = F.regexp_replace(s, r"[\n\r\x{B}\f\x{85}\x{2028}\x{2029}]", " ")
    return F.when(s.rlike(_UNUSUAL), strip_invisible(broken)).otherwise(broken)


def lines(s: Column, spaces: bool = False) -> Column:
    """The lines of text whose white space keeps breaks, as an array: ends trimmed, blank edges
    dropped, at most one blank line in a row. With ``spaces``, inner white space stays."""
    broken = F.regexp_replace(s, r"\r\n", "\n")
    if spaces:
        spaced, plain = (F.regexp_replace(broken, b, " ") for b in (rf"[{BLANK}&&[^\n\t]]", r"[\x{B}\f\r ]"))
        trimmed = lambda x: F.regexp_replace(x, r"[ \t]+$", "")
    else:
        spaced, plain = (F.regexp_replace(broken, b, " ") for b in (rf"[{BLANK}&&[^\n]]+", r"[\t\x{B}\f\r ]+"))
        trimmed = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    each = F.transform(F.split(F.when(s.rlike(_UNUSUAL), strip_invisible(spaced)).otherwise(plain), "\n"), trimmed)
    joined = F.regexp_replace(F.array_join(each, "\n"), r"\n{3,}", "\n\n")
    body = F.regexp_replace(joined, r"^\n+|\n+$", "")
    cut = lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, "\n"))
    return F.get(F.transform(F.array(body), cut), F.lit(0))  # worked out once


def white_space_mode(ws: Column) -> Column:
    """What a white-space style keeps: none, breaks or spaces."""
    return F.when(ws.isin("pre", "pre-wrap", "break-spaces"), "spaces").when(ws == "pre-line", "breaks").otherwise("none")


def letters(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{M}\p{Nd}]", ""))


def label_differs(name: Column, shown: Column) -> Column:
    """True where a label and the words shown contradict: neither holds the other's letters."""
    a, b = letters(name), letters(shown)
    return (a != "") & (b != "") & ~a.contains(b) & ~b.contains(a)


def clip(s: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def quote(s: Column, n: int) -> Column:
    """``s`` clipped, with backslashes and quotes escaped, in double quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(clip(s, n), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def clip_bytes(s: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` UTF-8 bytes that ends at a character, with an ellipsis if cut."""
    prefix = F.substring(s, 1, n)
    sizes = F.transform(F.split(prefix, ""), lambda c: F.octet_length(c))
    fit = F.aggregate(sizes, F.struct(F.lit(0).alias("b"), F.lit(0).alias("n")), lambda a, z: F.when(a["b"] + z <= n, F.struct((a["b"] + z).alias("b"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(n + 1).alias("b"), a["n"].alias("n"))))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(F.substr(s, F.lit(1), fit["n"]), F.lit("…")))


def first_line(s: Column) -> Column:
    return F.substring_index(s, "\n", 1)


def token_estimate(chars: Column) -> Column:
    """Tokens of a text of so many characters: four to a token, rounded up."""
    return F.ceil(chars / 4).cast("long")


# Challenge wording, matched as whole words.
CHALLENGE_PHRASES = ("unusual traffic", "verify you are human", "verify you are a human", "not a robot", "are you a robot", "checking your browser", "complete the following challenge")


def words_of(s: Column) -> Column:
    """Letters and digits as lower-case words with single spaces around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def has_phrase(s: Column, phrases: tuple[str, ...] = CHALLENGE_PHRASES) -> Column:
    words = words_of(s)
    out = F.lit(False)
    for p in phrases:
        out = out | words.contains(f" {p} ")
    return out


def spellings(v: Column) -> Column:
    """How a page or a log may write a secret: as it is, cleaned, escaped in strings, HTML and
    URLs; distinct, longest first."""

    def forms(b: Column) -> list[Column]:
        escaped = F.replace(F.replace(b, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        html = b
        for raw, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
            html = F.replace(html, F.lit(raw), F.lit(entity))
        query = F.url_encode(b)
        path = query
        for enc, raw in (("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")):
            path = F.replace(path, F.lit(enc), F.lit(raw))
        return [b, escaped, html, query, path, href(b)]

    every = F.filter(F.array_distinct(F.array(*forms(v), *forms(clean(v)))), lambda x: x != "")
    return F.array_sort(every, lambda a, b: F.when(F.octet_length(a) != F.octet_length(b), F.octet_length(b) - F.octet_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
