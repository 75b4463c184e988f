"""Text primitives as columns: folding, words, phonetic keys, edit distance and tolerance. Offsets are code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the Latin blocks with marks, and what is left of each without its marks.
_MARKED = {chr(c): base for c in range(0xC0, 0x250) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)}
#: Possessive loops: a word of any number of parts is matched without recursion.
WORD = r"[\p{L}\p{Nd}\p{M}]++(?:['’\-‐][\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*+)*+"
#: Applied in order to a folded word; capitals are final, so that no output is rewritten.
KEY_RULES = (
    ("ph", "F"), ("qu?", "K"), ("ch", "CH"), ("c(?=[ei])", "S"), ("c", "K"), ("g(?=[ei])", "Y"), ("y(?=[aeiou])", "Y"), ("y", "I"), ("[vw]", "B"),
    ("z", "S"), ("j", "Y"), (r"h|[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}]", ""), ("^x", "S"), ("x", "KS"),
)
SHORT, LONG = 4, 8
#: Hits whose places are summed up in one go.
BLOCK = 64


_BARE = str.maketrans(_MARKED)


def fold_word(word: str) -> str:
    """`fold` of a word of ASCII and of the letters of `_MARKED`'s blocks."""
    return (word if word.isascii() else word.translate(_BARE)).lower()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}", "")


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(text))


def same_letters(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def contains(haystack: Column, needle: Column) -> Column:
    return F.contains(fold(haystack), fold(needle))


def spaced(text: Column) -> Column:
    """Folded letters and digits, a space before, after and instead of all else."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def contains_words(haystack: Column, needle: Column) -> Column:
    """needle stands in haystack with no letter or digit beside it."""
    return F.contains(spaced(haystack), spaced(needle)) & (F.length(F.trim(spaced(needle))) > 0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def folded_words(text: Column) -> Column:
    """A text's words, folded. The text is folded whole, unless it holds a mark or a capital sigma, which hang on what stands beside
    them: a mark may begin a word, and a sigma is written otherwise at a word's end."""
    return F.when(F.regexp_like(text, F.lit(r"[\p{M}\x{3A3}]")), F.transform(words(text), fold)).otherwise(words(fold(text)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _starts(gaps: Column, hits: Column) -> Column:
    """array<int>: where each hit starts. Sums run inside blocks of BLOCK hits, so that no step copies more than a block's."""
    none = F.array().cast("array<int>")

    def block(at: Column, part: Column) -> Column:
        add = lambda a, s: F.struct((a["at"] + s["g"] + s["h"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["g"])).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), add)

    def over(x: Column) -> Column:
        last = F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
        done = F.aggregate(parts, F.array(F.struct(F.lit(0).alias("at"), none.alias("out"))), lambda acc, p: F.concat(acc, F.array(block(F.element_at(acc, -1)["at"], p))))
        return F.flatten(F.transform(done, lambda d: d["out"]))

    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    return bound(lengths, over)


#: Stands for a hit where a text is parted; of all characters a text is least likely to hold it.
MARK = "\0"


def gaps(text: Column, pattern: str) -> Column:
    """What stands around a pattern's hits. `split` compiles its pattern anew for each row, but finds a single character without
    one: hits become that character first. Only a text that itself holds it is split by the pattern."""
    filled = F.concat(F.split(text, pattern, -1), F.array(F.lit("")))  # a zero-length hit at the start leaves one gap too few
    return F.when(F.contains(text, F.lit(MARK)), filled).otherwise(F.split(F.regexp_replace(text, pattern, MARK), MARK, -1))


def cut(text: Column, pattern: str) -> Column:
    """The hits of a pattern and the gaps around them."""
    return F.struct(gaps(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))


def cut_spans(x: Column) -> Column:
    """array<struct<start, len, value>> of a cut text's hits."""
    found = F.zip_with(_starts(x["g"], x["h"]), x["h"], lambda s, v: F.struct(s.alias("start"), F.length(v).alias("len"), v.alias("value")))
    return F.filter(found, lambda p: p["len"] > 0)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, len, value>> of the leftmost matches; the gaps between matches give their places."""
    none = F.array().cast("array<struct<start:int,len:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(cut(text, pattern), cut_spans)).otherwise(none)


def tokens(text: Column) -> Column:
    """array<struct<start, len, word, gap>>: the words with their places and the text up to the next word."""

    def made(x: Column) -> Column:
        places = F.zip_with(_starts(x["g"], x["h"]), x["h"], lambda s, v: F.struct(s.alias("start"), F.length(v).alias("len"), v.alias("word")))
        return F.zip_with(places, F.slice(x["g"], 2, F.size(x["h"])), lambda p, g: F.struct(p["start"].alias("start"), p["len"].alias("len"), p["word"].alias("word"), g.alias("gap")))

    return bound(cut(F.coalesce(text, F.lit("")), WORD), made)


def collapse(x: Column) -> Column:
    """Repeated neighbours become one, digits excepted."""
    return F.regexp_replace(x, r"(\P{Nd})\1+", "$1")


#: The same rules for a word of ASCII letters, as literals: what follows a letter is given back. A caret marks the start.
ASCII_RULES = (
    ("ph", "F"), ("qu", "K"), ("q", "K"), ("ch", "CH"), ("ce", "Se"), ("ci", "Si"), ("c", "K"), ("ge", "Ye"), ("gi", "Yi"), *((f"y{v}", f"Y{v}") for v in "aeiou"),
)
ASCII_DROPPED = "h" + "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())


def _ascii_key(word: Column) -> Column:
    """Of a folded word."""
    out = word
    for literal, to in ASCII_RULES:
        out = F.replace(out, F.lit(literal), F.lit(to))
    out = F.concat(F.lit("^"), F.translate(out, "yvwzj" + ASCII_DROPPED, "IBBSY"))
    out = F.substring(F.replace(F.replace(out, F.lit("^x"), F.lit("^S")), F.lit("x"), F.lit("KS")), 2, 1 << 30)
    return collapse(F.lower(out))


def phonetic_key(word: Column) -> Column:
    """Most folded words are ASCII, and literals are found several times faster than patterns."""
    folded = fold(word)
    out = folded
    for pattern, to in KEY_RULES:
        out = F.regexp_replace(out, pattern, to)
    plain = (F.length(folded) == F.octet_length(folded)) & ~F.contains(folded, F.lit("\0"))
    return F.when(plain, _ascii_key(folded)).otherwise(collapse(F.lower(out)))


def budget(a: Column, b: Column) -> Column:
    """Edits that keys of these lengths may differ by."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n < SHORT, 0).when(n < LONG, 1).otherwise(2)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a filter on one of them is not moved to where it would compute it again."""
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select("*", made.alias("__once")).select("*", "__once.*").drop("__once")


def accepts(a: Column, b: Column) -> Column:
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= budget(a, b)) & (F.levenshtein(a, b) <= budget(a, b)))


def ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def has_digit(word: Column) -> Column:
    return F.regexp_like(word, F.lit(r"\p{Nd}"))


def to_digits(text: Column, table: dict[str, str]) -> Column:
    """The digits that a run of digit words says; null if any word is none."""
    digit = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    said = F.transform(F.split(F.regexp_replace(F.lower(F.trim(text)), r"[\s,–-]+", " "), " "), lambda w: F.element_at(digit, w))
    return F.when(F.exists(said, lambda d: d.isNull()), F.lit(None).cast("string")).otherwise(F.array_join(said, ""))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tightened(text: Column) -> Column:
    """A span's text without what is no letter or digit at its ends."""
    return F.regexp_replace(text, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")


def utf16_slice(text: Column, start: Column, length: Column) -> Column:
    """The part of a text that stands at UTF-16 offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, length * 2), "UTF-16BE")


#: Code points of a chunk of a long text.
CHUNK = 1024


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, start: Column, length: Column) -> Column:
    """The part of a chunked text from a code point on."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + F.greatest(length, F.lit(1)) - 1) / CHUNK).cast("int")
    joined = F.when(first == last, F.get(pieces, first)).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.when(length <= 0, "").otherwise(F.substring(F.coalesce(joined, F.lit("")), start - first * CHUNK + 1, length))
