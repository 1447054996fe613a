"""Segmentation: sentences, clauses, field labels and the units of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

#: A field separator, a daṇḍa or pipe, a period between no digits, a line that starts with a number.
SENTENCE = r"[।॥|]|:-|(?<![0-9])[.](?![0-9])|\n\s*(?=[0-9]{1,3}[).])"
CLAUSE = r",|\s=\s"
_BLANKS = " \t\n\x0b\f\r"
_VIRAMA, _JOINER = "්", "‍"


def let(value: Column, body) -> Column:
    """Evaluates a value once and gives it to the body; an expression that is named twice is evaluated twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(sizes: Column) -> Column:
    """Of an array of whole numbers the sums of those before each, in blocks of about the root of their number.

    A fold that carries the sums would copy them at each step, so its cost would grow as the square.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)

    def blocks(size: Column, k: Column) -> Column:
        of_blocks = F.transform(upto(F.ceil(F.size(size) / k).cast("int")), lambda b: total(F.slice(size, b * k + 1, k)))
        before = lambda of: F.transform(of, lambda _, b: total(F.slice(of, F.lit(1), b)))
        place = lambda ahead: F.transform(size, lambda _, i: F.get(ahead, F.floor(i / k).cast("int")) + total(F.slice(size, F.floor(i / k).cast("int") * k + 1, i % k)))
        return let(of_blocks, lambda of: let(before(of), place))

    return let(sizes, lambda size: let(F.greatest(F.ceil(F.sqrt(F.size(size))).cast("int"), F.lit(1)), lambda k: blocks(size, k)))


def pieces(text: Column, boundary: str) -> Column:
    """The stripped, non-empty pieces between matches of a boundary: the texts of `spans`."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), boundary, -1), lambda p: F.btrim(p, F.lit(_BLANKS))), "")


def spans(text: Column, boundary: str, offset: Column | None = None) -> Column:
    """Array of (text, start, end) of the stripped, non-empty pieces between matches of a boundary, in code points.

    Pieces and separators are cut by one pattern each and put end to end, so offsets are exact.
    """
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(f"({boundary})"), F.lit(1))
    base = offset if offset is not None else F.lit(0)

    def found(both: Column) -> Column:
        at = starts(F.transform(both, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        laid = F.zip_with(both, at, lambda x, a: F.struct(F.btrim(x["p"], F.lit(_BLANKS)).alias("text"), (base + a + F.length(x["p"]) - F.length(F.ltrim(x["p"], F.lit(_BLANKS)))).alias("start")))
        return F.transform(F.filter(laid, lambda x: x["text"] != ""), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end")))

    whole = F.struct(F.btrim(text, F.lit(_BLANKS)).alias("text"), (base + F.length(text) - F.length(F.ltrim(text, F.lit(_BLANKS)))).alias("start"), (base + F.length(F.rtrim(text, F.lit(_BLANKS)))).alias("end"))
    # a text without a boundary is one piece
    one = F.filter(F.array(whole), lambda x: x["text"] != "")
    return F.when(F.regexp_like(text, F.lit(boundary)), let(F.arrays_zip(F.split(text, boundary, -1).alias("p"), marks.alias("m")), found)).otherwise(one)


def sentences(text: Column) -> Column:
    """Sentences with their spans. A text that a boundary starts or ends makes no empty one."""
    return spans(text, SENTENCE)


def clause_spans(sentence: Column) -> Column:
    """Clauses of a (text, start, end) sentence with spans in the source; one without a boundary is its own clause."""
    found = spans(sentence["text"], CLAUSE, sentence["start"])
    return let(found, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(sentence["text"].alias("text"), sentence["start"].alias("start"), sentence["end"].alias("end")))))


def field_state(text: Column, labels: dict[str, str]) -> Column:
    """The state that a sentence names if it is a field label and nothing else, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.trim(text))


def codepoints(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != "")


def utf8_bytes(text: Column) -> Column:
    """Two hex digits a byte."""
    return F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1))


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\X)"), F.lit(1))


def aksharas(text: Column) -> Column:
    """Orthographic syllables: a cluster that ends in a virama joins the next, not across blanks and marks."""
    empty = F.slice(F.array(F.lit("")), 1, 0)
    flush = lambda acc: F.when(acc["open"] != "", F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    def step(acc: Column, g: Column) -> Column:
        letter = F.regexp_like(g, F.lit(r"\p{L}"))
        before = F.when(letter, acc["out"]).otherwise(flush(acc))
        joined = F.concat(F.when(letter, acc["open"]).otherwise(F.lit("")), g)
        binds = F.rtrim(g, F.lit(_JOINER)).endswith(_VIRAMA) & ~F.regexp_like(g, F.lit(r"^\s+$"))
        return F.struct(F.when(binds, before).otherwise(F.concat(before, F.array(joined))).alias("out"), F.when(binds, joined).otherwise(F.lit("")).alias("open"))

    return F.aggregate(graphemes(text), F.struct(empty.alias("out"), F.lit("").alias("open")), step, flush)


#: Unit name -> segmenter.
UNITS = {"word": tokens, "akshara": aksharas, "grapheme": graphemes, "codepoint": codepoints, "byte": utf8_bytes}


def units(text: Column, kind: str) -> Column:
    return UNITS[kind](text)


def affix(word: Column, n: int, end: bool = False) -> Column:
    """The first, or last, n grapheme clusters of a word."""
    g = graphemes(word)
    return F.array_join(F.slice(g, F.greatest(F.size(g) - n + 1, F.lit(1)) if end else F.lit(1), F.lit(n)), "")


def malformed(cluster: Column) -> Column:
    """Whether a cluster starts with a combining mark or is a virama alone."""
    return F.regexp_like(cluster, F.lit(rf"^\p{{M}}|^{_VIRAMA}[{_JOINER}]*$"))
