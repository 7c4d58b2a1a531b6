"""Column functions on text: tokens, markup, answers, names and progress lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def lit_or_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(lit_or_col(text)), F.lit(WORD), F.lit(0))


def first_tokens(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def named_characters() -> dict[str, int]:
    """The code points of HTML's named references, from the standard library's table."""
    from html.entities import name2codepoint

    return {**name2codepoint, "apos": 39}


def numbered_characters() -> dict[int, int]:
    """What references to control characters mean: those from 128 to 159 are Windows-1252's."""
    told = {i: ord(bytes([i]).decode("cp1252", "replace")) for i in range(128, 160)}
    return {i: c for i, c in told.items() if c != 0xFFFD} | {0: 0xFFFD}


def character(point: Column) -> Column:
    """The character of a code point; U+FFFD for surrogates and what is beyond Unicode."""
    fine = F.when((point > 0x10FFFF) | point.between(0xD800, 0xDFFF), 0xFFFD).otherwise(point)
    return F.decode(F.unhex(F.lpad(F.hex(fine.cast("long")), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """text with its character references decoded, named and numbered, each once; unknown ones and those without a semicolon stay."""
    names = F.create_map(*[x for k, v in named_characters().items() for x in (F.lit(k), F.lit(v))])
    numbers = F.create_map(*[x for k, v in numbered_characters().items() for x in (F.lit(k), F.lit(v))])

    def part(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        number = F.when(F.lower(F.left(name, F.lit(2))) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10).cast("int")).when(F.startswith(name, F.lit("#")), F.substr(name, F.lit(2)).cast("int"))
        point = F.coalesce(F.try_element_at(numbers, number), number, F.try_element_at(names, name))
        return F.when(point.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(character(point), F.substr(piece, F.length(name) + 2)))

    pieces = F.split(text, "&")
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), part), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Tags become spaces, references are decoded, white space is one space."""
    return squeeze(decode_entities(F.regexp_replace(html, r"(?s)<[^>]+>", " ")))


def clean_cell(html: Column) -> Column:
    """A table cell without reference marks, tags, and hidden spans with all that they hold."""
    from lumiform.functions import markup

    return html_to_text(F.regexp_replace(markup.strip_spans(html, markup.HIDDEN), r'(?is)<sup[^>]*class="[^"]*reference[^"]*"[^>]*>.*?</sup>', ""))


def clean_key(key: Column) -> Column:
    """A key without leading bullets, dashes and arrows."""
    return F.trim(F.regexp_replace(key, "^[•*–—\\-→›» \\t]+", ""))


def contains_any(needles: Column, haystack: Column) -> Column:
    """Whether a non-blank needle occurs, in any case."""
    return F.coalesce(F.exists(needles, lambda n: (F.trim(n) != "") & F.contains(F.lower(haystack), F.lower(n))), F.lit(False))


def answer_class(answers: Column, metadata: Column, body: Column) -> Column:
    """Where an answer stands: metadata_only, body_only, both, neither; no_answer without a non-blank answer."""
    usable = F.coalesce(F.exists(answers, lambda a: F.trim(a) != ""), F.lit(False))
    m, b = contains_any(answers, metadata), contains_any(answers, body)
    return F.when(~usable, "no_answer").when(m & b, "both").when(m, "metadata_only").when(b, "body_only").otherwise("neither")


def logit_score(logits: Column) -> Column:
    """The score of a classifier head: the second of two logits, else the first."""
    return F.when(F.size(logits) == 2, F.element_at(logits, 2)).otherwise(F.element_at(logits, 1))


def arm_name(fold: Column, weight: Column, rank: Column, only: Column, seed: Column) -> Column:
    """The display name of an experimental arm."""
    head = F.when(only.isNotNull(), F.concat(F.lit("only_"), only)).when(fold.isNotNull(), F.concat(F.lit("held_"), fold)).otherwise("all")
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", weight), "0+$", ""), r"\.$", "")
    return F.concat(head, F.lit("_w"), shown, F.when(rank.isNotNull(), F.concat(F.lit("_r"), rank.cast("string"))).otherwise(""), F.when(seed != 0, F.concat(F.lit("_s"), seed.cast("string"))).otherwise(""))


def swept_value(path: Column, name: str) -> Column:
    """The value of a swept quantity in a file name."""
    return F.nullif(F.regexp_extract(path, rf"{name}([0-9.]*[0-9])", 1), F.lit("")).cast("double")


def cohen_band(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("trivial")


def band_rank(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 0.8, 3).when(a >= 0.5, 2).when(a >= 0.2, 1).otherwise(0)


def bands_crossed(before: Column, after: Column) -> Column:
    return band_rank(after) - band_rank(before)


def relative_change(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before) / before)


def intervals_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def duration(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    return F.when(done <= 0, F.lit(0.0)).otherwise(F.greatest(total - done, F.lit(0)) * elapsed / done)


def shorten(name: Column, width: int) -> Column:
    """The end of a name that is too long, behind dots."""
    return F.when(F.length(name) > width, F.concat(F.lit("..."), F.right(name, F.lit(width - 3)))).otherwise(name)


def elide(text: Column, width: int) -> Column:
    """A text that is too long without its middle."""
    head = (width - 3 + 1) // 2
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(width - 3 - head)))).otherwise(text)


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    filled = F.when(total > 0, F.least(F.floor(done * width / total), F.lit(width))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))


def progress_line(fields: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields])


def parse_progress(line: Column) -> Column:
    """key=value fields of a line as a map; null without any."""
    return F.when(F.contains(line, F.lit("=")), F.map_from_entries(F.transform(F.filter(F.split(line, " "), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1)))))
