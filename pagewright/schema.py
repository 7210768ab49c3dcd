"""Explicit schemas of what the engine reads and writes. Nothing is inferred."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OPTIONS = _struct(only_main_content=T.BooleanType(), include_selectors=T.ArrayType(_S), exclude_selectors=T.ArrayType(_S))
REQUEST = _struct(url=_S, final_url=_S, content_type=_S, html=_S, options=OPTIONS)
ENVELOPE = _struct(html=_S, url=_S, final_url=_S, content_type=_S, title=_S, rendered=T.BooleanType())
METADATA = _struct(title=_S, description=_S, canonical_url=_S, language=_S, author=_S, og_title=_S, og_description=_S, extras=T.MapType(_S, _S))
QUALITY = _struct(
    text_length=T.IntegerType(), paragraph_count=T.IntegerType(), link_count=T.IntegerType(), image_count=T.IntegerType(), title_present=T.BooleanType(),
    link_density=T.DoubleType(), quality_score=T.DoubleType(), used_main_content=T.BooleanType(), fallback_used=T.BooleanType(),
)
RESPONSE = _struct(markdown=_S, html_clean=_S, metadata=METADATA, links=T.ArrayType(_S), images=T.ArrayType(_S), quality=QUALITY)
#: What the page kernel emits for one row.
KERNEL = _struct(
    title=_S, description=_S, canonical_url=_S, language=_S, author=_S, og_title=_S, og_description=_S, html_clean=_S, md_raw=_S, links=T.ArrayType(_S), images=T.ArrayType(_S), error=_S
)
PAGE = _struct(page_id=T.LongType(), url=_S, html=_S)
