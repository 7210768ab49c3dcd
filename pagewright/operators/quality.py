"""Quality of a converted page: a struct-valued native Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import first_lines, let, occurrences, opening_text, paragraph_count, trim_space, visible_text

# Phrases of a page's shell, and the thresholds of the score.
SHELL_PHRASES = (
    "skip to content",
    "skip to main content",
    "search the blog",
    "search docs",
    "primary navigation",
    "repository files navigation",
    "you signed in with another tab or window",
    "you signed out in another tab or window",
    "you switched accounts on another tab or window",
    "please reload this page",
    "dismiss alert",
    "open more actions menu",
    "go to file",
    "top stories",
    "career site cookie settings",
    "loading",
    "birthday mode",
    "notifications",
    "new issue",
)
FULL_LENGTH, FULL_PARAGRAPHS = 800, 3
LEAST_LENGTH, LEAST_PARAGRAPHS, LEAST_SCORE = 80, 1, 0.18
OPENING_LINES, TABLE_LINES = 14, 12


def shell_penalty(markdown: Column) -> Column:
    def weigh(opening: Column) -> Column:
        hits = sum((F.when(opening.contains(p), 1).otherwise(0) for p in SHELL_PHRASES), F.lit(0))
        raw = 0.06 * hits.cast("double") + F.when(occurrences(opening, "search") >= 2, 0.04).otherwise(0.0) + F.when(opening.contains("navigation"), 0.04).otherwise(0.0)
        return F.least(raw, F.lit(0.4))

    return let(F.lower(opening_text(markdown, OPENING_LINES)), weigh)


def table_penalty(markdown: Column) -> Column:
    opening = first_lines(markdown, TABLE_LINES, trim_space)

    def weigh(lines: Column) -> Column:
        rows = F.size(F.filter(lines, lambda x: x.startswith("|") | x.contains("| --- |")))
        pipes = F.aggregate(lines, F.lit(0), lambda n, x: n + occurrences(x, "|"))
        return F.when((rows >= 3) | (pipes >= 16), 0.18).when((rows >= 2) | (pipes >= 8), 0.1).otherwise(0.0)

    return let(opening, weigh)


def link_density(links: Column, length: Column) -> Column:
    return F.when(length > 0, links.cast("double") / length).otherwise(F.lit(0.0))


def density_bonus(density: Column) -> Column:
    return F.when(density <= 0.01, 0.1).when(density <= 0.02, 0.07).when(density <= 0.03, 0.03).otherwise(0.0)


def quality(markdown: Column, title: Column, links: Column, images: Column, used_main: Column, fallback: Column) -> Column:
    """STRUCT of counts, density, score in 0..1 and flags."""
    def build(m: Column) -> Column:
        has_title = trim_space(title) != ""
        density = link_density(links, m["length"])
        score = F.when(has_title, 0.2).otherwise(0.0) + F.when(m["length"] >= FULL_LENGTH, 0.4).otherwise(0.4 * (m["length"].cast("double") / FULL_LENGTH))
        score = score + F.when(m["paragraphs"] >= FULL_PARAGRAPHS, 0.2).otherwise(0.2 * (m["paragraphs"].cast("double") / FULL_PARAGRAPHS))
        score = score + density_bonus(density) + F.when(images > 0, 0.1).otherwise(0.0) - m["shell"] - m["table"]
        return F.struct(
            m["length"].alias("text_length"), m["paragraphs"].alias("paragraph_count"), links.cast("int").alias("link_count"), images.cast("int").alias("image_count"),
            has_title.alias("title_present"), density.alias("link_density"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("quality_score"), used_main.alias("used_main_content"), fallback.alias("fallback_used"),
        )

    measured = F.struct(
        F.length(visible_text(markdown)).alias("length"), paragraph_count(markdown).alias("paragraphs"), shell_penalty(markdown).alias("shell"), table_penalty(markdown).alias("table")
    )
    return let(measured, build)


def needs_fallback(q: Column) -> Column:
    return (q["text_length"] < LEAST_LENGTH) | (q["paragraph_count"] < LEAST_PARAGRAPHS) | (q["quality_score"] < LEAST_SCORE)
