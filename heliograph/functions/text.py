"""Tags, labels and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_MARK = "\u0001"

#: Words that are no tags.
STOP_WORDS = ("a", "an", "the", "of", "and", "with", "in", "on", "at", "is", "are", "to", "for")


def tags_from_text(text: Column, most: int = 12, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first distinct words of a caption: lower case, quotes trimmed, over two characters, no stop words."""
    words = F.transform(F.split(text, r"[^\w']+"), lambda w: F.btrim(F.lower(w), F.lit("'")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))), 1, most)


def tags_from_name(name: Column, most: int = 6) -> Column:
    """Words of a file name without its extension."""
    words = F.split(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), r"[_\- ]+")
    return F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, most)


def tags_joined(tags: Column) -> Column:
    return F.array_join(tags, TAG_MARK)


def tags_split(text: Column) -> Column:
    """The tags of a joined text; empty ones are left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), TAG_MARK), lambda t: t != "")


def aperture(numerator: Column, denominator: Column) -> Column:
    """F-number to one decimal; null without a denominator."""
    return F.when(denominator != 0, F.round(numerator / denominator, 1))


def shutter(seconds: Column) -> Column:
    """``1/N`` below a second, else seconds with one decimal."""
    return F.when(seconds.isNull() | (seconds <= 0), F.lit(None)).when(seconds < 1, F.concat(F.lit("1/"), F.round(1 / seconds).cast("int").cast("string"))).otherwise(F.format_string("%.1fs", seconds.cast("double")))


def summary_line(*parts: Column) -> Column:
    """The parts that there are, with a middle dot between them."""
    return F.concat_ws(" · ", *parts)


def bytes_text(n: Column) -> Column:
    """A size in units of 1024."""
    value = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1 << 20, F.format_string("%.1f KB", value / 1024))
        .when(n < 1 << 30, F.format_string("%.1f MB", value / (1 << 20)))
        .otherwise(F.format_string("%.2f GB", value / (1 << 30)))
    )


def capture_date(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy:MM:dd HH:mm:ss")


def loose_object(text: Column) -> Column:
    """What stands from the first ``{`` to the last ``}``, for JSON inside other text."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parsed_rating(text: Column) -> Column:
    """Scores within 0 to 1, a known flag (else NONE) and the rationale, out of loose JSON; null where there is none."""
    raw = F.from_json(loose_object(text), "overall double, sharpness double, exposure double, flag string, rationale string")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    flag = F.upper(raw["flag"])
    return F.when(
        raw.isNotNull(),
        F.struct(
            unit(raw["overall"]).alias("overall"), unit(raw["sharpness"]).alias("sharpness"), unit(raw["exposure"]).alias("exposure"),
            F.when(flag.isin("PICK", "REJECT"), flag).otherwise("NONE").alias("flag"), raw["rationale"].alias("rationale"),
        ),
    )


def export_name(template: Column, name: Column, date: Column) -> Column:
    """A file name from a template with ``{name}`` and ``{date}``."""
    return F.replace(F.replace(template, F.lit("{name}"), name), F.lit("{date}"), date)


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def path_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 24)


def decoded_words(ids: Column, words: dict[int, str]) -> Column:
    """Ids to text by a small vocabulary: unknown ids are left out, no space before punctuation."""
    table = F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.lit(v))))
    known = F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda w: w.isNotNull())
    return F.regexp_replace(F.array_join(known, " "), r" ([.,!?;:])", "$1")
