"""Pages to documents: a kernel pass, native hooks and scoring, and a second pass only for weak rows.

The fallback is null-gated: the second kernel gets NULL unless the first result is weak, so nothing is
computed twice and there is neither a union nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import trim_space
from pagewright.operators.kernel import page_kernel, row_kernel
from pagewright.operators.lines import hook_steps
from pagewright.operators.postprocess import postprocess
from pagewright.operators.quality import needs_fallback, quality
from pagewright.options import ConvertOptions

ERROR_BLANK = "html is required"


def _text(df: DataFrame, name: str) -> Column:
    return trim_space(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def effective_url(df: DataFrame) -> Column:
    """final_url if it is not blank, else url; both trimmed, missing columns empty."""
    final = _text(df, "final_url")
    return F.when(final != "", final).otherwise(_text(df, "url"))


def distinct_references(values: Column) -> Column:
    """Trimmed, non-empty, distinct in first-seen order; null is empty."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), trim_space)
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def always() -> Column:
    """True, but not deterministic to the planner: a caller's filter on what it guards is not pushed below it, where
    every step would be copied into the next as often as that refers to it."""
    return F.spark_partition_id() >= 0


class Finish:
    """Markdown after the built-in hooks, the caller's, and post-processing: a column at a time, built once for any number of passes."""

    def __init__(self, raw: str, out: str, options: ConvertOptions):
        self.out = out
        last = F.when(always(), postprocess(F.col(out)))
        self.steps = [*hook_steps(F.col(raw), out), *(hook(F.col(out)) for _, hook in options.after_hooks), last]

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumn(self.out, step)
        return df


class _Pass:
    """One kernel pass. The native expressions are built once and serve both passes under the same names."""

    def __init__(self, options: ConvertOptions):
        self.finish = Finish("_raw", "_md", options)
        self.scored = quality(F.col("_md"), F.col("_title"), F.size("_links"), F.size("_images"), F.col("_used"), F.col("_fell"))

    def __call__(self, df: DataFrame, kernel: Column, used_main: Column, fallback: bool) -> DataFrame:
        """Adds _kernel, _md, _links, _images, _quality; null where the kernel got null."""
        k = F.col("_kernel")
        df = df.withColumn("_kernel", kernel).withColumns(
            {"_raw": k["md_raw"], "_title": k["title"], "_links": distinct_references(k["links"]), "_images": distinct_references(k["images"]), "_used": used_main, "_fell": F.lit(fallback)}
        )
        return self.finish(df).withColumn("_quality", F.when(k.isNotNull() & k["error"].isNull(), self.scored))


PARTS = ("_kernel", "_md", "_links", "_images", "_quality")


def convert_pages(pages: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Columns of ``pages`` but html, and markdown, html_clean, metadata, links, images, quality, error.

    ``pages`` has html and, as it likes, url, final_url and content_type (ignored). If it has a column
    ``options`` (struct only_main_content, include_selectors, exclude_selectors), that decides by row. Blank
    or null html gives empty outputs and error 'html is required', a page whose conversion raises empty outputs
    and the exception's message (or either fails the query, if strict); no output is null but error.
    """
    options = options or ConvertOptions()
    by_row = "options" in pages.columns
    outputs = ("markdown", "html_clean", "metadata", "links", "images", "quality", "error")
    kept = [c for c in pages.columns if c not in ("html", "options", *outputs)]
    blank = trim_space(F.coalesce(F.col("html"), F.lit(""))) == ""
    if options.strict:
        blank = F.when(blank, F.raise_error(F.lit(ERROR_BLANK)).cast("boolean")).otherwise(False)
    main = F.coalesce(F.col("options.only_main_content"), F.lit(True)) if by_row else F.lit(options.only_main)
    df = pages.withColumns({"_url": effective_url(pages), "_html": F.when(~blank, F.col("html")), "_only": main})
    if by_row:
        run = row_kernel(options)
        lists = [F.col("options.include_selectors"), F.col("options.exclude_selectors")]
        first, second = run(F.col("_html"), F.col("_url"), F.col("_only"), *lists), lambda weak: run(F.when(weak, F.col("_html")), F.col("_url"), F.lit(False), *lists)
    else:
        full = page_kernel(options, False)
        first, second = page_kernel(options, options.only_main)(F.col("_html"), F.col("_url")), lambda weak: full(F.when(weak, F.col("_html")), F.col("_url"))
    run_pass = _Pass(options)
    df = run_pass(df, first, F.col("_only"), False)
    takes_full = by_row or options.only_main
    if takes_full:
        weak = F.coalesce(F.col("_only") & needs_fallback(F.col("_quality")), F.lit(False))
        df = df.withColumn("_weak", weak).withColumnsRenamed({p: "_main" + p for p in PARTS})
        df = run_pass(df, second(F.col("_weak")), F.lit(False), True)

    def pick(part: str) -> Column:
        return F.when(F.col("_weak"), F.col(f"_{part}")).otherwise(F.col(f"_main_{part}")) if takes_full else F.col(f"_{part}")

    meta = F.col("_main_kernel" if takes_full else "_kernel")
    text = lambda name: F.coalesce(meta[name], F.lit(""))
    canonical = F.when(text("canonical_url") == "", F.col("_url")).otherwise(text("canonical_url"))
    names = ("title", "description", "language", "author", "og_title", "og_description")
    fields = {n: text(n) for n in names} | {"canonical_url": canonical}
    metadata = F.struct(*[fields[n].alias(n) for n in ("title", "description", "canonical_url", "language", "author", "og_title", "og_description")], F.create_map().cast("map<string,string>").alias("extras"))
    empty = F.struct(
        *[F.lit(0).alias(n) for n in ("text_length", "paragraph_count", "link_count", "image_count")], F.lit(False).alias("title_present"), F.lit(0.0).alias("link_density"),
        F.lit(0.0).alias("quality_score"), F.col("_only").alias("used_main_content"), F.lit(False).alias("fallback_used"),
    )
    # a main pass that failed has no quality, so it is never weak and no second pass hides it
    failed = pick("kernel")["error"]
    if options.strict:
        failed = F.when(failed.isNotNull(), F.raise_error(failed).cast("string"))
    return df.select(
        *kept,
        F.coalesce(pick("md"), F.lit("")).alias("markdown"),
        F.coalesce(pick("kernel")["html_clean"], F.lit("")).alias("html_clean"),
        metadata.alias("metadata"),
        pick("links").alias("links"),
        pick("images").alias("images"),
        F.when(always(), F.coalesce(pick("quality"), empty)).alias("quality"),
        F.when(F.col("_html").isNull(), F.lit(ERROR_BLANK)).otherwise(failed).alias("error"),
    )


def to_markdown(pages: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Conversion alone, without quality or fallback: columns of ``pages`` but html, and markdown."""
    options = options or ConvertOptions()
    kept = [c for c in pages.columns if c not in ("html", "markdown")]
    df = pages.withColumn("_kernel", page_kernel(options, options.only_main)(F.col("html"), effective_url(pages)))
    df = Finish("_raw", "_md", options)(df.withColumn("_raw", F.col("_kernel")["md_raw"]))
    return df.select(*kept, F.coalesce("_md", F.lit("")).alias("markdown"))
