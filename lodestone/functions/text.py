"""Text functions as DataFrame columns, all inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CHUNK_OVERLAP, CHUNK_SIZE, HEADINGS, MARKDOWN, QUESTION_PREFIXES, SIMPLIFIED, TERMINAL_MARKS, TRADITIONAL, TRADITIONAL_PHRASES

#: White space as a text's strip() and \s see it: Unicode's and four separators.
_SPACE = r"[\s\x1c-\x1f]"
CJK = r"[一-鿿]"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip(text: Column) -> Column:
    """The text without white space at its ends; where there is none, only the ends are looked at."""
    edged = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(f"(?U){_SPACE}")
    return let(text, lambda x: F.when(edged(x), F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")).otherwise(x))


def normalize_text(text: Column) -> Column:
    """Line feeds only, single blanks, at most one empty line in a row, stripped."""
    text = let(text, lambda x: F.when(F.contains(x, F.lit("\r")), F.regexp_replace(x, "\r\n|\r", "\n")).otherwise(x))
    text = F.regexp_replace(text, " [ \t]+|\t[ \t]*", " ")  # all runs but single blanks
    return strip(let(text, lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without white space and case."""
    bare = lambda x: F.when(_is_ascii(x), F.regexp_replace(x, rf"{_SPACE}+", "")).otherwise(F.regexp_replace(x, rf"(?U){_SPACE}+", ""))
    return F.sha2(F.lower(let(text, bare)), 256)


def cjk_grams(text: Column, sizes=(2, 3, 4)) -> Column:
    """All n-grams of each run of CJK characters, run by run, size by size."""
    grams = lambda run, n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    runs = F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda run: F.flatten(F.array(*[grams(run, n) for n in sizes]))))


def searchable_text(text: Column) -> Column:
    return F.concat(text, F.lit("\n"), F.array_join(cjk_grams(text), " "))


def embedding_terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and _ of two or more, then the CJK n-grams."""
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)), cjk_grams(text))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"(?U)\n{_SPACE}*\n"), lambda p: strip(p)), lambda p: p != "")


def pack_paragraphs(parts: Column, size: int = CHUNK_SIZE) -> Column:
    """Join paragraphs by an empty line as long as the result isn't over `size`."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def add(s: Column, p: Column) -> Column:
        joined = F.concat(s["now"], F.lit("\n\n"), p)
        return (
            F.when(s["now"] == "", F.struct(p.alias("now"), s["done"].alias("done")))
            .when(F.length(joined) <= size, F.struct(joined.alias("now"), s["done"].alias("done")))
            .otherwise(F.struct(p.alias("now"), F.concat(s["done"], F.array(s["now"])).alias("done")))
        )

    return F.aggregate(parts, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def split_long(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` that end after a line feed or full stop in their second half, if there is one."""
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be under half the size, else windows don't advance")
    n = F.length(text)
    least_step = size // 2 + 2 - overlap

    def windows(parts: Column) -> Column:
        """Strings of the text, given as parts of `size` characters, so none is searched from the start."""
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        at = lambda begin, length: let(F.floor(begin / size).cast("int"), lambda i: F.substring(F.concat(part(i), part(i + 1)), begin - i * size + 1, length))
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<struct<at:int,length:int>>").alias("cuts"))

        def step(s: Column, _: Column) -> Column:
            window = at(s["at"], F.lit(size))
            upto_break = F.length(F.regexp_extract(window, "(?s)^.*[\n。.]", 0))  # 0 without a break
            length = F.when(upto_break - 1 > size // 2, upto_break).otherwise(F.length(window))
            cuts = lambda k: F.concat(s["cuts"], F.array(F.struct(s["at"].alias("at"), k.alias("length"))))
            moved = let(length, lambda k: F.struct(F.greatest(F.lit(0), s["at"] + k - overlap).alias("at"), (s["at"] + k >= n).alias("over"), cuts(k).alias("cuts")))
            return F.when(s["over"], s).otherwise(moved)

        steps = F.sequence(F.lit(0), F.ceil(n / least_step).cast("int") + 1)
        found = F.aggregate(steps, start, step, lambda s: s["cuts"])
        return F.filter(F.transform(found, lambda c: strip(at(c["at"], c["length"]))), lambda x: x != "")

    return F.when(n <= size, F.array(text)).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), windows))


def chunk_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of a normalised text, in order."""
    return F.flatten(F.transform(pack_paragraphs(paragraphs(text), size), lambda t: split_long(t, size, overlap)))


def to_simplified(text: Column) -> Column:
    """As `questions.to_simplified`: by OpenCC in an Arrow function if it is installed, else by the small table."""
    from . import questions, udfs

    if questions._opencc is not None:
        return udfs.simplified(text)
    for old, new in TRADITIONAL_PHRASES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def strip_markdown(text: Column) -> Column:
    """Labels for links; without heading, bullet and number marks, emphasis and code marks; lines kept."""
    for pattern, put in MARKDOWN:
        # lines end at line feeds only, and white space is Unicode's and four separators
        pattern = "(?dmU)" + pattern.replace(r"\s", _SPACE)
        text = F.regexp_replace(text, pattern, "$1" if put else "")
    return text


def human_text(text: Column, max_len: int | None = None, simplify: bool = False) -> Column:
    """Plain one-line text; entities are decoded beforehand (see `udfs.unescape`)."""
    if simplify:
        text = to_simplified(text)
    text = F.regexp_replace(strip_markdown(text), rf"(?U){_SPACE}+", " ")
    text = F.btrim(strip(text), F.lit(" -#\t\r\n"))
    if max_len is None:
        return text
    cut = F.concat(F.regexp_replace(F.substring(text, 1, max_len - 1), rf"(?U){_SPACE}+\z", ""), F.lit("…"))
    return F.when(F.length(text) > max_len, cut).otherwise(text)


def trim_terminal(text: Column) -> Column:
    return F.rtrim(text, F.lit(TERMINAL_MARKS))


def split_sentences(text: Column) -> Column:
    """Sentences of an unescaped text, without headings and questions."""
    parts = F.split(strip_markdown(text), rf"(?U)(?<=[。！？!?；;]){_SPACE}*|(?<=\.){_SPACE}+|\n+")
    question = lambda s: F.endswith(s, F.lit("?")) | F.endswith(s, F.lit("？"))
    asks = lambda s: s.rlike("^(" + "|".join(QUESTION_PREFIXES) + ")")
    return F.filter(F.transform(parts, lambda p: human_text(p)), lambda s: (s != "") & ~s.isin(*HEADINGS) & ~question(s) & ~asks(s))


def keyword_score(text: Column, terms: Column) -> Column:
    """3 for each term of four or more characters that stands in the text, 1 for each shorter one."""
    points = lambda x, term: F.when(F.contains(x, F.lower(term)), F.when(F.length(term) >= 4, 3).otherwise(1)).otherwise(0)
    return let(F.lower(text), lambda x: F.aggregate(terms, F.lit(0), lambda s, term: s + points(x, term)))


@cache
def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters that are left without them."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.when(_is_ascii(text), F.lower(text)).otherwise(F.lower(F.regexp_replace(F.translate(text, *_folds()), r"\p{M}+", "")))


def index_tokens(text: Column) -> Column:
    """Runs of letters and numbers of the folded text, in order; a run of CJK is one token."""
    every = lambda x: F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    return let(text, lambda x: F.when(_is_ascii(x), F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))).otherwise(every(x)))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def unwrap_redirect(url: Column) -> Column:
    """The target of a search engine's redirect link."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.try_url_decode(F.regexp_extract(full, r"[?&]uddg=([^&#]*)", 1))
    is_redirect = full.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*duckduckgo\.com/l/")
    return F.when(is_redirect & (F.coalesce(target, F.lit("")) != ""), target).otherwise(full)


def unwrap_bing(url: Column) -> Column:
    """The target coded in a result link's `u` parameter; the link itself if that can't be read."""
    coded = F.try_url_decode(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1))
    payload = F.translate(F.substring(coded, F.lit(3), F.length(coded)), "-_", "+/")
    target = F.try_to_binary(payload, F.lit("base64"))
    text = F.when(F.is_valid_utf8(target.cast("string")), target.cast("string"))
    found = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*bing\.com([/?#]|$)") & F.startswith(coded, F.lit("a1"))
    return F.when(found, F.coalesce(text, url)).otherwise(url)
