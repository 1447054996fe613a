"""String scalars over Columns. All but Unicode normalisation stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[ \t\n\r\f\x0B]"
#: Genus names that are no genus but the start of a sentence, a place or an author.
NO_GENUS = tuple("DC Don Lam See The Comp Linn Name Nees Roxb That This Wall Hindi Often Willd Bengal Bombay Ceylon Indian Coluber Columba Sanskrit According".split())
#: Small letters of epithets.
_SMALL = "a-zæëïöü"


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def run(s):  # Arrow batches; the JVM has no normaliser in SQL
        return s.fillna("").str.normalize(form)

    return run


def nfc(s: Column) -> Column:
    """Composed form; null is empty. Text that is ASCII never leaves the JVM."""
    return F.when(F.coalesce(F.octet_length(s) == F.length(s), F.lit(True)), F.coalesce(s, F.lit(""))).otherwise(_normal("NFC")(s))


def nfd(s: Column) -> Column:
    """Decomposed form; null is empty."""
    return F.when(F.coalesce(F.octet_length(s) == F.length(s), F.lit(True)), F.coalesce(s, F.lit(""))).otherwise(_normal("NFD")(s))


def strip(s: Column, chars: str = " \t\n\r\f\x0b") -> Column:
    """Without the characters given at either end."""
    return F.btrim(s, F.lit(chars))


def tokens(s: Column) -> Column:
    """Words between blanks; null and blank text have none."""
    return F.array_remove(F.split(F.coalesce(s, F.lit("")), BLANK + "+"), "")


def slug(s: Column) -> Column:
    """Composed, blanks and slashes as underscores, without colons."""
    return F.translate(nfc(s), " /:", "__")


def deburr(s: Column) -> Column:
    """Lower case without diacritics; brackets and stops as blanks, blanks made one, none at the ends."""
    plain = F.when(F.coalesce(F.octet_length(s) == F.length(s), F.lit(True)), F.coalesce(s, F.lit(""))).otherwise(_bare(s))
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[()\[\],.;:]", " "), BLANK + "+", " "))


@F.pandas_udf(T.StringType())
def _bare(s):
    return s.fillna("").str.normalize("NFKD").str.replace(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]", "", regex=True)


def sandhi_strip(s: Column) -> Column:
    """Without colons and blanks, then h, m and n at the end, so that inflected spellings compare equal."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(s, "[: ]+$", ""), "[hmn]+$", ""))


def clean_side(s: Column) -> Column:
    """(text, gloss) of one side of a pair: the Latin gloss in brackets apart, no number at the end, stripped."""
    gloss = F.regexp_extract(s, r"\(([A-Za-z][^)]*)\)", 1)
    rest = F.regexp_replace(s, r"\([A-Za-z][^)]*\)", "")
    return F.struct(strip(F.regexp_replace(rest, r"[0-9]+[.)]?\s*$", ""), " .,;:-()\t\n").alias("text"), F.nullif(F.trim(gloss), F.lit("")).alias("gloss"))


def parse_substances(s: Column, stop: str | None = None) -> Column:
    """Names of a list between commas, of two characters or more, up to where the pattern `stop` begins prose."""
    cut = F.regexp_replace(s, f"(?s)(?:{stop}).*$", "") if stop else s
    return F.filter(F.transform(F.split(F.coalesce(cut, F.lit("")), "[,،।]+"), lambda x: strip(x, " .,;:-()\t\n")), lambda x: F.length(x) >= 2)


def binomial_pairs(s: Column, ascii_edges: bool = False) -> Column:
    """Pairs in a text that have the form of `Genus species`, as they stand there.

    A pair starts and ends at the edge of a word; with ascii_edges as SQL engines without Unicode edges see it: only
    ASCII letters, digits and the underscore are of a word, whatever the JVM's own rule is.
    """
    pair, start, end = rf"[A-Z][{_SMALL}]{{2,}}\s+[A-Z]?[a-z][{_SMALL}]{{2,}}", r"\b", r"\b"
    if ascii_edges:
        pair = pair.replace(r"\s", r"[\t\n\f\r ]")
        start, end = "(?<![A-Za-z0-9_])", "(?:(?<=[a-z])(?![A-Za-z0-9_])|(?<=[æëïöü])(?=[A-Za-z0-9_]))"
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(start + pair + end), F.lit(0))


def latin_binomials(s: Column, stop=NO_GENUS) -> Column:
    """`Genus species` pairs in a text, without those whose genus is in the stop list."""
    return F.filter(F.transform(binomial_pairs(s), lambda x: F.regexp_replace(x, BLANK + "+", " ")), lambda x: ~F.substring_index(x, " ", 1).isin(*stop))


def parse_traditional(s: Column, keys: str = "abc") -> Column:
    """`(a) x (b) y` as a map from each key to its names, in order; a key without a name has an empty array."""
    marked = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(rf"[(][{keys}][)][^)(]+(?=[(][{keys}][)]|$)"), F.lit(0))
    name = lambda x: strip(F.regexp_replace(x, rf"^\([{keys}]\)", ""), " ,\t\n")
    own = lambda k: F.filter(F.transform(F.filter(marked, lambda x: x.startswith(f"({k})")), name), lambda x: x != "")
    return F.create_map(*(c for k in keys for c in (F.lit(k), own(k))))


def first_suffix(s: Column, suffixes) -> Column:
    """The value of the first suffix in order that a text ends in, else null; suffixes are (suffix, value)."""
    out = F.lit(None).cast("string")
    for suffix, value in reversed(list(suffixes)):
        out = F.when(s.endswith(suffix), F.lit(value)).otherwise(out)
    return out


def head_lemma(words: Column, lemmas: Column) -> Column:
    """The lemma of the last word that a map of lemmas knows, else null."""
    known = F.filter(F.transform(words, lambda w: F.try_element_at(lemmas, w)), lambda x: x.isNotNull())
    return F.try_element_at(known, F.lit(-1))


def clauses(s: Column, marks: str = "[.।॥]") -> Column:
    """Stripped, non-empty pieces between sentence marks."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), marks), strip), lambda x: x != "")


def last_word(clause: Column) -> Column:
    """The last word of a clause that holds a letter, without marks around it; null if none does."""
    return F.try_element_at(F.filter(F.transform(tokens(clause), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$", "")), lambda w: w != ""), F.lit(-1))


def batch_label(path: Column) -> Column:
    """`from-to-until` of a file name, else null."""
    return F.nullif(F.regexp_extract(path, r"(\d+-to-\d+)", 1), F.lit(""))


def html_escape(s: Column) -> Column:
    """& < > and double quotes as entities."""
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def node_type(node_id: Column, types: dict[str, str]) -> Column:
    """Type by the prefix of an id before the first colon, else null."""
    table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    return F.try_element_at(table, F.substring_index(node_id, ":", 1))


def is_artefact(token: Column) -> Column:
    """Whether a token is punctuation, digits or Latin letters only."""
    return F.regexp_like(token, F.lit(r"^[A-Za-z\d\W]+$")) | F.regexp_like(token, F.lit(r"^[\P{L}\d]+$"))


def is_sinhala(char: Column) -> Column:
    """Whether a character is of the Sinhala block or a zero-width joiner."""
    return F.regexp_like(char, F.lit(r"^[\x{0D80}-\x{0DFF}\x{200D}]$"))


def script_class(token: Column) -> Column:
    """`tatsama` for words with letters or signs of learned borrowings, `latin`, `number`, else `other`."""
    learned = r"[\x{0D9B}\x{0D9D}\x{0DA1}\x{0DA3}\x{0DA8}\x{0DAA}\x{0DAE}\x{0DB0}\x{0DB5}\x{0DB7}\x{0DC2}\x{0DC1}\x{0D83}\x{0D9E}]|\x{0DCA}\x{200D}"
    return F.when(F.regexp_like(token, F.lit(learned)), "tatsama").when(F.regexp_like(token, F.lit(r"^[A-Za-z]+$")), "latin").when(F.regexp_like(token, F.lit(r"^\d+$")), "number").otherwise("other")


def plausible_binomial(s: Column) -> Column:
    """Whether a name looks like a binomial: a capitalised genus of three letters, a lower-case epithet of three."""
    return F.coalesce(F.regexp_like(s, F.lit(r"^[A-Z][a-z]{2,} [a-z][a-z-]{2,}$")), F.lit(False))


def page_number(s: Column) -> Column:
    """Whether a row is a page number only: up to four digits, perhaps between dashes."""
    return F.coalesce(F.regexp_like(s, F.lit(r"^\s*[-–]?\s*\d{1,4}\s*[-–]?\s*$")), F.lit(False))


def content_token(token: Column, stop=()) -> Column:
    """Whether a token, stripped of marks, has two characters or more, a letter and is no stop word."""
    bare = strip(token, " .,;:-–()[]\"'|")
    has = (F.length(bare) >= 2) & F.regexp_like(bare, F.lit(r"\p{L}"))
    return F.coalesce(has & ~F.lower(bare).isin(*stop) if stop else has, F.lit(False))


def lcs_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length of both), the edit ratio with insertions and deletions only; a fold over both strings.

    The state is one row of the dynamic programme, so memory is linear in the shorter text.
    """
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    cells = chars(short)
    zero = F.transform(cells, lambda _: F.lit(0))

    def row(above: Column, ch: Column) -> Column:
        step = lambda acc, i: F.struct(
            F.greatest(F.when(F.get(cells, i) == ch, F.when(i > 0, F.get(above, i - 1)).otherwise(0) + 1).otherwise(0), F.get(above, i), acc["left"]).alias("left"),
            F.concat(acc["row"], F.array(F.greatest(F.when(F.get(cells, i) == ch, F.when(i > 0, F.get(above, i - 1)).otherwise(0) + 1).otherwise(0), F.get(above, i), acc["left"]))).alias("row"),
        )
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(cells) - 1, F.lit(0))), lambda i: i < F.size(cells))
        return F.aggregate(places, F.struct(F.lit(0).alias("left"), F.slice(zero, 1, 0).alias("row")), step, lambda acc: acc["row"])

    best = F.coalesce(F.try_element_at(F.aggregate(chars(long_), zero, row), F.lit(-1)), F.lit(0))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * best / total)
