"""Chat formatting in native DataFrame code: typed content parts, a reversible template, a loss mask.

A message is a list of parts. Text parts are escaped; image, audio and document parts become ordered
placeholders ``<|image:3|>`` whose references go to ``attachments`` with their expanded token counts.
Every control string starts with ``<|``; inside texts ``\\`` is doubled and ``<|`` becomes ``<\\|``, so no text
can forge one, and reading back (each ``\\x`` to ``x``) is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: image patches of 28 pixels a side, audio frames a second, tokens a document page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(part: Column) -> Column:
    """Expanded tokens of an attachment; missing measures count as one patch, frame or page. Text: 0."""
    patches = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / PATCH)
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def text_parts(text: Column) -> Column:
    """One text part; null text is empty."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")]
    fields += [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts array<PART>).

    Returns conv_id, n_turns, formatted, loss_spans (start, length in code points of what follows the
    middle mark in turns of ``loss_roles``), attachments (place from 1, turn index, kind, ref, tokens) and
    expanded_tokens. Rows go by turn; ties by role, then parts; null turns first. A null role is empty, null
    parts and unknown kinds are empty text; null conv_id is one conversation; repeated rows are repeated turns.
    Adjoining texts are escaped as if they were one. An empty table gives no rows. Each turn is shaped on its
    own; places and attachment numbers are running sums in turn order, so work is linear in a conversation.
    """
    telling = lambda p: _attached(p) | (F.coalesce(p["text"], F.lit("")) != "")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), telling).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumns({"places": _places(F.col("parts")), "loss": F.col("role").isin(*loss_roles), "head": F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))}).withColumns(
        {"index": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0))}
    )
    shaped = numbered.withColumn("body", _flat_parts(F.col("parts"), F.col("places"), F.col("before")))
    size = F.length("head") + F.length("body") + len(END)
    visited = shaped.withColumn("at", F.coalesce(F.sum(size).over(earlier), F.lit(0))).select(
        "conv_id", "index", F.concat("head", "body", F.lit(END)).alias("line"),
        F.when(F.col("loss"), F.struct((F.col("at") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length"))).alias("span"),
        F.transform(
            F.filter("parts", _attached),
            lambda p, k: F.struct((F.col("before") + k + 1).cast("int").alias("place"), F.col("index").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
        ).alias("found"),
    )
    lines = F.sort_array(F.collect_list(F.struct("index", "line", "span", "found")))
    grouped = visited.groupBy("conv_id").agg(F.count("*").alias("n_turns"), lines.alias("lines"))
    attachments = F.flatten(F.transform("lines", lambda t: t["found"]))
    return grouped.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("lines", lambda t: t["line"]), "").alias("formatted"),
        F.transform(F.filter("lines", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def _places(parts: Column) -> Column:
    """Indexes of the attachments among the parts."""
    return F.filter(F.transform(parts, lambda p, i: F.when(_attached(p), i)), lambda i: i.isNotNull())


def _flat_parts(parts: Column, places: Column, before: Column) -> Column:
    """Escaped texts and numbered placeholders in order; ``before``: attachments of earlier turns.

    Where one text ends in ``<`` and the next begins with ``|``, the two would make a control string that
    neither holds, so it is escaped across the seam. A placeholder ends in ``>`` and cannot do that.
    """
    def piece(part: Column, i: Column) -> Column:
        last = F.get(parts, i - 1)
        seam = F.coalesce((i > 0) & ~_attached(last) & last["text"].endswith("<") & part["text"].startswith("|"), F.lit(False))
        placeholder = F.concat(F.lit("<|"), part["kind"], F.lit(":"), (before + F.array_position(places, i)).cast("string"), F.lit("|>"))
        return F.when(_attached(part), placeholder).otherwise(F.concat(F.when(seam, F.lit("\\")).otherwise(F.lit("")), escape(part["text"])))

    return F.array_join(F.transform(parts, piece), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the template: adds turns array<struct<role, text>> and loss_text, both unescaped; placeholders read as they stand."""
    chunks = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda c: c != "")
    bare = F.transform(chunks, lambda c: c.substr(F.lit(len(START) + 1), F.length(c)))
    middle = lambda c: F.instr(c, MIDDLE)
    turns = F.transform(bare, lambda c: F.struct(unescape(c.substr(F.lit(1), middle(c) - 1)).alias("role"), unescape(c.substr(middle(c) + len(MIDDLE), F.length(c))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
