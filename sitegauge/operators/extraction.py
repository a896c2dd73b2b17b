"""HTML pages to one row of facts each. Pages are parsed once; all rules then read columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitegauge.functions.html_facts import page_facts

FACTS = """
title string, metas map<string,string>, canonical string, headings array<struct<level:int,text:string>>,
links array<struct<href:string,resolved:string,rel:string,target:string,title:string,internal:boolean,is_anchor:boolean,protocol_relative:boolean,has_image:boolean,text:string>>,
images array<struct<src:string,alt:string,width:string,height:string,loading:string,priority:string,srcset:string,style_dims:boolean,in_picture:boolean>>,
iframes array<struct<src:string,has_dims:boolean>>,
scripts array<struct<src:string,type:string,in_head:boolean,blocking:boolean,inline_bytes:bigint>>,
stylesheets array<struct<href:string,media:string,blocking:boolean>>, inline_style_bytes bigint, json_ld array<string>,
tags map<string,int>, node_count int, max_depth int, microdata int, duplicate_ids array<struct<id:string,count:int>>,
text string, visible_text string, has_doctype boolean, charset string, lang string, has_favicon boolean, favicon string,
hreflang array<struct<lang:string,href:string>>, comments array<string>, hidden array<struct<reason:string,tag:string,text:string,links:array<struct<href:string,text:string>>>>, html_bytes bigint,
labels array<string>, redirects array<struct<where:string,target:string>>, meta_counts map<string,int>, json_ld_broken int, json_ld_types array<string>, json_strings array<string>, tels array<string>, mails array<string>,
nodes array<struct<types:array<string>,keys:array<string>,filled:array<string>,name:string,headline:string,description:string,questions:array<string>,phones:array<string>,emails:array<string>,same_as:array<string>,areas:array<string>,hours:array<string>,address:string>>
"""


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, html and the facts of every page, by one Arrow map without a shuffle."""
    facts = T._parse_datatype_string(FACTS.strip())
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *facts])
    arrow = to_arrow_schema(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_facts(h, u) for h, u in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            columns = [pa.array([list(m[f.name].items()) if pa.types.is_map(f.type) else m[f.name] for m in made], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return pages.select("page_id", F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)


def word_count(text: str) -> Column:
    return F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(text, r"\s+")))
