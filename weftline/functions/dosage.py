"""Dosage: numbers, units and systems of measures; quantity texts to grams by one fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import let
from .text import nfc

FRACTIONS = dict(zip("½¼¾⅓⅔⅛⅜⅝⅞", (a / b for a, b in ((1, 2), (1, 4), (3, 4), (1, 3), (2, 3), (1, 8), (3, 8), (5, 8), (7, 8))), strict=True))
_GLYPHS = "".join(FRACTIONS)
_N = "[0-9]+"
_TOKEN = rf"{_N}/{_N}|{_N}[.]{_N}|{_N}|[{_GLYPHS}]|\S+"


@dataclass(frozen=True)
class Units:
    """A registry: symbol -> (kind, aliases), and by system the grams, or millilitres, of one unit, in order of systems."""

    symbols: dict[str, tuple[str, tuple[str, ...]]]
    grams: dict[str, dict[str, float]]
    millilitres: dict[str, dict[str, float]]
    default: str

    @classmethod
    def from_document(cls, doc: dict) -> Units:
        """From a JSON registry with `symbols`, `systems` and `metadata`."""
        systems = doc.get("systems") or {}
        part = lambda key: {s: {k: float(v) for k, v in (r.get(key) or {}).items() if v is not None} for s, r in systems.items()}
        listed = doc.get("symbols") or {}
        symbols = {name: (about.get("kind", ""), tuple(about.get("aliases") or ())) for name, about in listed.items()}
        return cls(symbols, part("absolute_grams"), part("absolute_ml"), (doc.get("metadata") or {}).get("default_system", next(iter(systems), "")))

    def aliases(self) -> dict[str, str]:
        return {a: s for s, (_, more) in self.symbols.items() for a in (s, *more)}

    def factors(self, kind: str, system: str | None = None) -> dict[str, float]:
        """Factor of each symbol: that of the system asked for, else of the first other that has one."""
        table = self.grams if kind == "mass" else self.millilitres
        wanted = system if system in table else self.default
        out: dict[str, float] = {}
        for name in (wanted, *(s for s in table if s != wanted)):
            for symbol, value in table.get(name, {}).items():
                out.setdefault(symbol, value)
        return out


def parse_number(token: Column) -> Column:
    """2, 2.5, 2,5, 1/2, ½ and 2½ as doubles; else null, and null over zero."""
    t = F.trim(token)
    glyph = F.create_map(*(F.lit(x) for pair in FRACTIONS.items() for x in pair))
    mixed = rf"^({_N})([{_GLYPHS}])$"
    ratio = rf"^({_N})\s*/\s*({_N})$"
    number = lambda s: s.try_cast("double")
    return (
        F.when(F.try_element_at(glyph, t).isNotNull(), F.try_element_at(glyph, t))
        .when(F.regexp_like(t, F.lit(mixed)), number(F.regexp_extract(t, mixed, 1)) + F.try_element_at(glyph, F.regexp_extract(t, mixed, 2)))
        .when(F.regexp_like(t, F.lit(ratio)), F.try_divide(number(F.regexp_extract(t, ratio, 1)), number(F.regexp_extract(t, ratio, 2))))
        .when(F.regexp_like(t, F.lit(r"^[+-]?(\d+[.,]?\d*|[.,]\d+)([eE][+-]?\d+)?$")), number(F.replace(t, F.lit(","), F.lit("."))))
    )


def _map(table: dict, kind: str) -> Column:
    if not table:
        return F.create_map().cast(f"map<string,{kind}>")
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair)).cast(f"map<string,{kind}>")


def unit_in_text(text: Column, registry: Units) -> Column:
    """Symbol of the longest alias that stands anywhere in a text; null if none does."""
    out = F.lit(None).cast("string")
    for alias, symbol in sorted(registry.aliases().items(), key=lambda x: len(x[0])):
        out = F.when(F.contains(text, F.lit(alias)), F.lit(symbol)).otherwise(out)
    return out


def to_grams(text: Column, registry: Units, system: str | None = None, density: float = 1.0) -> Column:
    """(grams, ml, unit, count, n_units) of a quantity text such as `pala 1 kalan 3`; all null where nothing is matched.

    Tokens become numbers and symbols, a glued `pala3` both. From left to right each unit takes the number just before
    it if no other has it, else the one just after, else 1. Masses and volumes (by density) are summed; relative units
    match but weigh nothing. An unknown system is the default one.
    """
    alias, kind = _map(registry.aliases(), "string"), _map({s: k for s, (k, _) in registry.symbols.items()}, "string")
    grams, ml = _map(registry.factors("mass", system), "double"), _map(registry.factors("volume", system), "double")
    atom = lambda n, s: F.struct(n.cast("double").alias("n"), s.cast("string").alias("s"))
    null = F.lit(None)
    glued = "^(.+?)([0-9].*)$"

    def atoms(tok: Column) -> Column:
        own = F.try_element_at(alias, tok)
        head, tail = F.try_element_at(alias, F.regexp_extract(tok, glued, 1)), parse_number(F.regexp_extract(tok, glued, 2))
        pair = F.array(atom(null, head), atom(tail, null))
        return let(parse_number(tok), lambda n: F.when(n.isNotNull(), F.array(atom(n, null))).when(own.isNotNull(), F.array(atom(null, own))).otherwise(pair))

    found = F.regexp_extract_all(nfc(text), F.lit(f"({_TOKEN})"), F.lit(1))
    flat = F.filter(F.flatten(F.transform(found, atoms)), lambda a: a["n"].isNotNull() | a["s"].isNotNull())
    none = F.slice(F.array(atom(null, null)), 1, 0)
    state = lambda out, last, waiting: F.struct(out.alias("out"), last.cast("double").alias("last"), waiting.cast("string").alias("waiting"))
    closed = lambda acc: F.when(acc["waiting"].isNotNull(), F.concat(acc["out"], F.array(atom(F.lit(1.0), acc["waiting"])))).otherwise(acc["out"])

    def step(acc: Column, a: Column) -> Column:
        number = F.when(acc["waiting"].isNotNull(), state(F.concat(acc["out"], F.array(atom(a["n"], acc["waiting"]))), null, null)).otherwise(state(acc["out"], a["n"], null))
        unit = F.when(acc["last"].isNotNull(), state(F.concat(acc["out"], F.array(atom(acc["last"], a["s"]))), null, null)).otherwise(state(closed(acc), null, a["s"]))
        return F.when(a["n"].isNotNull(), number).otherwise(unit)

    pairs = F.aggregate(flat, state(none, null, null), step, closed)

    def weigh(p: Column) -> Column:
        k = F.try_element_at(kind, p["s"])
        g, v = F.try_element_at(grams, p["s"]), F.try_element_at(ml, p["s"])
        good = (k == "relative") | ((k == "mass") & g.isNotNull()) | ((k == "volume") & v.isNotNull())
        return F.struct(
            F.coalesce(good, F.lit(False)).alias("good"), p["n"].alias("n"), p["s"].alias("s"),
            F.when(k == "mass", p["n"] * g).when(k == "volume", p["n"] * v * density).otherwise(0.0).alias("g"), F.when(k == "volume", p["n"] * v).otherwise(0.0).alias("v"),
        )

    positive = lambda c: F.when(c > 0, c)

    def figures(done: Column) -> Column:
        total = lambda field: let(F.aggregate(done, F.lit(0.0), lambda acc, x: acc + x[field]), positive)
        head = F.get(done, F.lit(0))
        return F.struct(total("g").alias("grams"), total("v").alias("ml"), head["s"].alias("unit"), head["n"].alias("count"), F.size(done).alias("n_units"))

    # bound once: each figure would read the text anew
    return let(F.filter(F.transform(pairs, weigh), lambda x: x["good"]), figures)


def system_fallback(wanted: DataFrame, factors: DataFrame, systems: list[str]) -> DataFrame:
    """Adds factor and used_system to (symbol, system): the system's own factor, else that of the first other in order.

    `factors` has (symbol, system, factor); it is grouped by symbol once and joined, so it may be of any size.
    """
    rank = _map({s: i for i, s in enumerate(systems)}, "int")
    listed = factors.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.try_element_at(rank, F.col("system")).alias("rank"), F.col("system").alias("system"), F.col("factor").alias("factor")))).alias("_w_all"))
    joined = wanted.join(listed, "symbol", "left")
    own = F.filter("_w_all", lambda x: x["system"] == F.col("system"))
    best = F.coalesce(F.get(own, F.lit(0)), F.get(F.col("_w_all"), F.lit(0)))
    return joined.withColumn("factor", best["factor"]).withColumn("used_system", best["system"]).drop("_w_all")
