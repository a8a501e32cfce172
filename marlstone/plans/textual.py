"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import sql
from .base import query, table


@query(f"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {sql.BLANKS})), lambda x: x <> '') as ls from documents)
    select doc_id, md5(array_to_string(ls, chr(10))) as digest, len(ls) as kept, 0 as removed from l""")
def text_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_lines("text")
    rows = table(spark, d, "documents").select("doc_id", c.alias("c"))
    n = F.when(F.col("c.text") == "", 0).otherwise(F.size(F.split("c.text", "\n")))
    return rows.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("digest"), n.alias("kept"), F.size("c.removed").alias("removed"))


@query(r"""with p as (select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]*(/.*)$', 1) as path from pages),
    s as (select page_id, path, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1') as stem from p)
    select page_id, path, regexp_replace(regexp_replace(regexp_replace(stem, '^[0-9]+[.、\s]+', ''), '\s+', '', 'g'), '^[：:]+|[：:]+$', '', 'g') as topic, 'unknown' as version from s""")
def text_filename_topic(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "://[^/]*(/.*)$", 1)
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", "path", text.filename_topic("path").alias("topic"), text.document_version(F.col("path")).alias("version"))


@query("""select doc_id, case when n < 1024 then cast(n as varchar) || ' B' when n < 1048576 then printf('%.1f', n / 1024.0) || ' KiB' else printf('%.1f', n / 1048576.0) || ' MiB' end as shown from (select doc_id, n_chars * 1000 + 512 as n from documents)""")
def text_human_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 1000 + 512).alias("n"))
    return rows.select("doc_id", text.human_bytes(F.col("n")).alias("shown"))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
    select doc_id, count(*) as n_lines, count(*) filter (where regexp_full_match(trim(line), '[0-9\s.,，、:：;；\-—_()/（）]+')) as number_lines, sum(case when regexp_extract(line, '^(\d+(?:\.\d+)*)[.、\s]', 1) <> '' then 1 else 0 end)::bigint as headings from l group by all""")
def text_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split(text.text_of("text"), "\n")).alias("line"))
    numbered = text.heading_number(F.col("line")) != ""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.page_number_only("line")).alias("number_lines"), F.count_if(numbered).alias("headings"))
