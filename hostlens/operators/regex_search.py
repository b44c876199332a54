"""Regular expressions over names through a gram index.

A pattern is a search, case-insensitive, as in Python's ``re``.  Python's own
parser gives its structure; from it follow the texts a match must hold, as
alternatives of literal pieces.  Every alternative needs all grams (runs of three
characters, or fewer where no piece is that long) of its pieces, so its rarest
gram finds all names it can match, and each name so found is then searched.

Grams are compared in a folded form that maps all case variants of a letter
to one, so folding loses no match.  Names leave the map tasks only under grams
that some pattern asks for.  A pattern without any required character (``.*``)
matches names by being tried on each, in the tasks that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.text import strip_ws
from hostlens.session import cut_lineage

GRAM = 3
MOST_ALTERNATIVES = 32          # a part of a pattern with more counts as unknown
MOST_MEMBERS = 4                # so does a larger character class
TRIED_AT_ONCE = 1000            # patterns without grams in one pass over the names
_GAP = None


def fold(text: str) -> str:
    """Upper then lower case; the final sigma and the dot that case mapping adds are evened out."""
    return text.upper().lower().replace("ς", "σ").replace("\u0307", "")


def folded(name: Column) -> Column:
    # the inner translate also keeps the optimiser from dropping upper() below lower()
    return F.translate(F.lower(F.translate(F.upper(name), "\u0307", "")), "ς\u0307", "σ")


def _then(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """All alternatives of one part followed by those of another; unknown if too many."""
    if len(left) * len(right) > MOST_ALTERNATIVES:
        return [(_GAP,)]
    out = {}
    for a in left:
        for b in right:
            joined = (*a[:-1], a[-1] + b[0], *b[1:]) if a and b and a[-1] is not _GAP and b[0] is not _GAP else (*a, *b)
            out[joined] = None
    return list(out)


def _pieces(parsed) -> list[tuple]:
    """Alternatives of a parsed pattern: literal pieces and gaps, in order."""
    out = [()]
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = [(fold(chr(arg)),)]
        elif op is sre.IN:
            members = [fold(chr(x)) for kind, x in arg if kind is sre.LITERAL]
            part = [(m,) for m in dict.fromkeys(members)] if len(members) == len(arg) <= MOST_MEMBERS else [(_GAP,)]
        elif op is sre.BRANCH:
            part = list(dict.fromkeys(p for branch in arg[1] for p in _pieces(branch)))
        elif op is sre.SUBPATTERN:
            part = _pieces(arg[-1])
        elif op is sre.ATOMIC_GROUP:
            part = _pieces(arg)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            inner, part = _pieces(inner), [()]
            for _ in range(min(least, GRAM)):
                part = _then(part, inner)
            if least == 0 and most == 1:
                part = [(), *inner]
            elif most != least or least > GRAM:
                part = _then(part, [(_GAP,)])
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = [()]
        else:
            part = [(_GAP,)]
        out = _then(out, part if len(part) <= MOST_ALTERNATIVES else [(_GAP,)])
    return out


def required_grams(pattern: str) -> list[list[str]] | None:
    """For each alternative the grams that a match must hold; [[]] if nothing
    is required, None if the pattern is not valid."""
    try:
        re.compile(pattern, re.IGNORECASE)
        alternatives = _pieces(sre_parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError):
        return None
    out = []
    for pieces in alternatives:
        texts = [p for p in pieces if p]
        n = min(GRAM, max(map(len, texts), default=0))
        grams = sorted({t[i:i + n] for t in texts for i in range(len(t) - n + 1)}) if n else []
        if not grams:
            return [[]]
        out.append(grams)
    return out


def _analysed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(p, i, g) for p in b["pattern"] if (found := required_grams(p)) is not None
               for i, grams in enumerate(found) for g in (grams or [None])]
        yield pd.DataFrame({"pattern": pd.Series([x[0] for x in out], dtype=object), "alt": pd.Series([x[1] for x in out], dtype="int64"),
                            "gram": pd.Series([x[2] for x in out], dtype=object)})


class _Compiled(dict):
    def __missing__(self, pattern: str):
        if len(self) > 10_000:
            self.clear()
        self[pattern] = re.compile(pattern, re.IGNORECASE)
        return self[pattern]


@F.pandas_udf(T.BooleanType())
def _found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    compiled = _Compiled()
    for patterns, names in batches:
        yield pd.Series([compiled[p].search(n) is not None for p, n in zip(patterns, names)], dtype=bool)


def _grams(s: Column) -> Column:
    """All runs of one to GRAM characters."""
    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))

    return F.array_distinct(F.concat(*map(runs, range(1, GRAM + 1))))


def regex_join(patterns: DataFrame, names: DataFrame, pattern_col: str = "pattern", name_col: str = "name") -> DataFrame:
    """All (pattern, name) where the pattern is found in the name.

    Equal patterns and names count once, null ones are left out, and a pattern
    that is no valid regular expression is found nowhere."""
    asked = cut_lineage(patterns.select(F.col(pattern_col).alias("pattern")).where("pattern IS NOT NULL").distinct()
                        .mapInPandas(_analysed, "pattern string, alt bigint, gram string"))
    known = names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct()
    grams = asked.where("gram IS NOT NULL")
    postings = cut_lineage(known.select("name", F.explode(_grams(folded(F.col("name")))).alias("gram"))
                           .join(grams.select("gram").distinct(), "gram", "left_semi"))
    # an alternative with a gram that no name has matches none, the others go by their rarest
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (grams.join(counts, "gram", "left").groupBy("pattern", "alt").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
              .where("x.n > 0").select("pattern", "x.gram").distinct())
    out = rarest.join(postings, "gram").select("pattern", "name").where(_found("pattern", "name"))
    anything = [r[0] for r in asked.where("gram IS NULL").select("pattern").toLocalIterator()]
    for at in range(0, len(anything), TRIED_AT_ONCE):
        out = out.unionByName(known.mapInPandas(_tried(anything[at:at + TRIED_AT_ONCE]), "pattern string, name string"))
    return out.distinct()


def _tried(patterns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(p, re.compile(p, re.IGNORECASE)) for p in patterns]
        for b in batches:
            for p, search in compiled:
                hit = b[[search.search(n) is not None for n in b["name"]]]
                if len(hit):
                    yield pd.DataFrame({"pattern": p, "name": hit["name"]})
    return run


def name_regex_search(terms: DataFrame, taxa: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """P5 with regular expressions: taxa in whose name the term is found; for terms
    found in none, taxa in whose name the term's first word is found.
    Output: term, match_level ('species' | 'genus'), tax_id, name."""
    first = F.element_at(F.split(strip_ws(F.col("term")), r"(?U)\s+"), 1)
    asked = terms.select("term").where("term IS NOT NULL").distinct().select("term", F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.col("term").alias("pattern")), F.struct(F.lit(2).alias("level"), first.alias("pattern")))).alias("a"))
    asked = cut_lineage(asked.select("term", "a.level", "a.pattern"))
    hits = cut_lineage(asked.join(regex_join(asked, taxa, "pattern", name_col), "pattern"))
    best = hits.groupBy("term").agg(F.min("level").alias("level"))
    return hits.join(best, ["term", "level"]).join(taxa.select(F.col(id_col).alias("tax_id"), F.col(name_col).alias("name")), "name").select(
        "term", F.when(F.col("level") == 1, "species").otherwise("genus").alias("match_level"), "tax_id", "name")
