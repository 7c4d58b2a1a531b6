"""Token budgets: how much body fits beside a question and rendered metadata, and cuts at sentence ends."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumiform.functions.render import FORMATS, RENDERERS

MAX_TOKENS, SPECIAL_TOKENS, SAFETY, FLOOR = 512, 3, 5, 20
#: Characters from the end of a cut in which a sentence end is looked for.
TAIL = 500

Counter = Callable[[Column], Column]


def word_count(text: Column) -> Column:
    """Tokens as runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def subword_count(text: Column) -> Column:
    """Tokens of about four characters inside words, a stand-in for subword vocabularies."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S{1,4}"), F.lit(0)))


TOKENIZERS: dict[str, tuple[Counter, str]] = {"words": (word_count, r"\s*\S+"), "subwords": (subword_count, r"\s*\S{1,4}")}


def metadata_tokens(pairs: Column, count: Counter, formats: tuple[str, ...] = FORMATS) -> Column:
    """The most tokens that the metadata takes in any format."""
    return F.greatest(*[count(RENDERERS[f](pairs, F.lit(""))) for f in formats])


def budget_of(question: Column, pairs: Column, count: Counter, max_tokens: int = MAX_TOKENS) -> Column:
    """Tokens left for the body; it may be negative."""
    return F.lit(max_tokens) - count(question) - metadata_tokens(pairs, count) - SPECIAL_TOKENS - SAFETY


def tightest(budgets: Mapping[str, Column]) -> tuple[Column, Column]:
    """The least budget and the name of the first tokenizer that has it."""
    least = F.least(*budgets.values()) if len(budgets) > 1 else next(iter(budgets.values()))
    name = F.coalesce(*[F.when(b == least, F.lit(n)) for n, b in budgets.items()])
    return least, name


def truncate(body: Column, budget: Column, name: str) -> Column:
    """The body within budget tokens: null under FLOOR, whole if it fits, else cut behind the last sentence end of the last TAIL characters,
    or at the last space beyond the 20th character, or hard."""
    count, piece = TOKENIZERS[name]

    def within(b: Column) -> Column:
        cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(piece), F.lit(0)), F.lit(1), F.greatest(b, F.lit(1))), "")
        ended = once(cut, lambda c: once(F.regexp_extract(F.substr(c, tail_of(c) + 1), r"(?s)^(.*[.!?])(?:[ \t\n].*)?$", 1), lambda sentence: at_end(c, sentence)))
        return F.when(b < FLOOR, F.lit(None).cast("string")).when(body == "", F.lit("")).when(count(body) <= b, body).otherwise(F.rtrim(ended))

    return once(budget, within)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once: a plain expression would be made again wherever it stands."""
    return F.transform(F.array(value), use)[0]


def tail_of(cut: Column) -> Column:
    """Where the part begins in which a sentence end is looked for."""
    return F.greatest(F.length(cut) - TAIL, F.lit(0))


def at_end(cut: Column, sentence: Column) -> Column:
    """cut behind the last sentence end, at its last space, or as it is."""
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # place of the last space
    return F.when(F.length(sentence) > 0, F.concat(F.left(cut, tail_of(cut)), sentence)).when((F.instr(cut, " ") > 0) & (space > 20), F.left(cut, space)).otherwise(cut)


def refit(question: Column, pairs: Column, body: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Every tokenizer budgets and cuts on its own; the shortest cut wins, the first of equal ones, null if one has no room."""
    cuts = F.array(*[truncate(body, budget_of(question, pairs, TOKENIZERS[n][0], max_tokens), n) for n in TOKENIZERS])
    shorter = lambda a, b: F.when(F.length(b) < F.length(a), b).otherwise(a)
    return once(cuts, lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.aggregate(F.slice(c, F.lit(2), F.size(c)), F.element_at(c, 1), shorter)))
