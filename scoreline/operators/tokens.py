"""Parsing of overlay tokens (array<struct<text,conf>>) to fields, by patterns over the joined tokens.

Tokens are joined by a mark that no token holds, so that "token" and "neighbour" are plain regular expressions, and
all of it stays in the JVM. Parsers are tried in order, each for its layout; the generic one comes last and takes what no other
claims. ``with_parser`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S = "\\u0001"  # stands for the mark in patterns
NOISE = rf"[^\w{S}]"

# What tokens look like in each layout.
COMPOUND = r"(\d+)-(\d+)/(\d+)\.(\d+)\(\d+\)"
STATS = rf"(?:\d+-?\d*\(\d+\)|\d+{S}\(\d+\))"
OVER_TOTAL = rf"{S}(\d+)\.(\d+)[^{S}]*{S}{NOISE}{{0,2}}\(\d+\)"
OVER_FUSED = rf"{S}(\d+)\.(\d+)[^\d{S}]{{0,3}}\(\d+\)"
OVER_BARE = rf"{S}(\d+)\.(\d+)[^{S}]*{S}\d{{1,2}}[\)\]\}}]"
LABEL = rf"{S}(?i:BOWLER|B)[:.]?{S}([A-Za-z]+)\*?(?={S})"


def joined(tokens: Column) -> Column:
    mark = F.lit("\u0001")
    return F.concat(mark, F.array_join(F.transform(tokens, lambda t: t["text"]), "\u0001"), mark)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _nth(text: Column, pattern: str, n: int, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(n))


def _name(found: Column) -> Column:
    return F.nullif(F.trim(F.replace(found, F.lit("\u0001"), F.lit(" "))), F.lit(""))


#: Fields that a parser may give, and their types.
FIELDS = {"runs": "int", "wickets": "int", "over_number": "int", "ball_in_over": "int", "batter": "string", "non_striker": "string", "bowler": "string", "run_rate": "double"}


@dataclass(frozen=True)
class Parser:
    """A layout: what text of joined tokens it claims, and the fields it reads from such text (others are null).

    Both are functions of the text column and give column expressions, which may call a UDF of one's own. strategy is the
    way of preparing frames that the layout reads best with.
    """

    name: str
    claims: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]
    strategy: str = "global"


def _shape(t: Column) -> Column:
    return F.when(t.rlike(OVER_TOTAL), 1).when(t.rlike(OVER_FUSED), 2).when(t.rlike(OVER_BARE), 3)


def _club(t: Column) -> dict[str, Column]:
    pre, post = F.regexp_extract(t, rf"^(.*?){COMPOUND}", 1), F.regexp_extract(t, rf"{COMPOUND}(.*)$", 5)
    named = rf"((?:{S}[A-Za-z]+)+){S}{STATS}(?={S})"
    score = {name: _first(t, COMPOUND, i) for i, name in enumerate(("runs", "wickets", "over_number", "ball_in_over"), 1)}
    return score | {"batter": _name(_nth(pre, named, 1)), "non_striker": _name(_nth(pre, named, 2)), "bowler": _name(_nth(post, named, 1))}


def _separate(t: Column) -> dict[str, Column]:
    shape, shaped = _shape(t), (OVER_TOTAL, OVER_FUSED, OVER_BARE)

    def by_shape(of: Callable[[str], Column]) -> Column:
        return F.coalesce(*(F.when(shape == i, of(p)) for i, p in enumerate(shaped, 1)))

    before, after = by_shape(lambda p: F.regexp_extract(t, rf"^(.*?){p}", 1)), by_shape(lambda p: F.regexp_extract(t, rf"{p}(.*)$", 3))
    score = rf"{S}{NOISE}?(\d+)-(\d+)(?={S}|$)"
    figures = rf"((?:{S}[A-Za-z]+){{1,2}})(?:{S}[^{S}]{{1,2}})?{S}{NOISE}?\d+-\d+{S}{NOISE}{{0,2}}\(\d+\)"
    return {
        "runs": _last(before, score, 1),
        "wickets": _last(before, score, 2),
        "over_number": by_shape(lambda p: F.regexp_extract(t, p, 1)),
        "ball_in_over": by_shape(lambda p: F.regexp_extract(t, p, 2)),
        "bowler": _name(_first(after, figures)),
        "run_rate": _first(t, rf"{S}(?i:CRR):?{S}(\d+\.\d+)(?={S})"),
    }


def _generic(t: Column) -> dict[str, Column]:
    place, total = rf"{S}(\d+)\.(\d+)(?={S})", rf"{S}(\d+)/(\d+)(?={S})"
    rest = F.regexp_replace(t, LABEL, "")  # without the label and the name it claims
    return {
        "runs": _first(t, total, 1),
        "wickets": _first(t, total, 2),
        "over_number": _first(t, place, 1),
        "ball_in_over": _first(t, place, 2),
        "batter": _first(rest, rf"{S}([A-Za-z]+)\*(?={S})"),
        "non_striker": _first(rest, rf"{S}([A-Za-z]+)(?={S})"),
        "bowler": _last(t, LABEL),
        "run_rate": _nth(t, rf"{S}(\d+\.\d+)(?={S})", 2),
    }


CLUB = Parser("club", lambda t: t.rlike(COMPOUND), _club, "local")
SEPARATE = Parser("separate", lambda t: _shape(t).isNotNull(), _separate, "local")
GENERIC = Parser("generic", lambda t: F.lit(True), _generic)
PARSERS = (CLUB, SEPARATE, GENERIC)


def with_parser(parser: Parser, parsers: tuple[Parser, ...] = PARSERS) -> tuple[Parser, ...]:
    """parsers with one more, tried after the others but before the last, which takes all."""
    if parser.name in {p.name for p in parsers}:
        raise ValueError(f"there is a parser {parser.name}")
    return (*parsers[:-1], parser, parsers[-1])


def parse(readings: DataFrame, tokens: str = "tokens", parsers: tuple[Parser, ...] = PARSERS) -> DataFrame:
    """readings with layout, the first parser's that claims the tokens, its FIELDS, and token_confidence."""
    t = F.col("__text")
    rows = readings.withColumn("__text", joined(F.col(tokens)))
    rows = rows.withColumn("layout", F.coalesce(*(F.when(p.claims(t), p.name) for p in parsers)))
    read = {p.name: p.fields(t) for p in parsers}
    unknown = {f for fields in read.values() for f in fields} - set(FIELDS)
    if unknown:
        raise ValueError(f"no fields of a reading: {', '.join(sorted(unknown))}")
    fields = {}
    for name, kind in FIELDS.items():
        found = F.coalesce(F.lit(None), *(F.when(F.col("layout") == p, own[name].cast("string")) for p, own in read.items() if name in own))
        fields[name] = found if kind == "string" else found.try_cast(kind)
    total_confidence = F.aggregate(F.transform(F.col(tokens), lambda x: x["conf"].cast("double")), F.lit(0.0), lambda s, x: s + x)
    confidence = F.try_divide(total_confidence, F.size(tokens) * 100.0)
    return rows.withColumns({**fields, "token_confidence": F.coalesce(confidence, F.lit(0.0))}).drop("__text")
