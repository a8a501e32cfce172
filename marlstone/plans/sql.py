"""Pieces of the checking SQL (DuckDB)."""

from __future__ import annotations

TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:[_-][a-z0-9]+)*')"
BLANKS = "E' \\t\\n\\x0b\\x0c\\r'"


def bm25(texts: str, queries: str) -> str:
    """CTEs up to bm25(qid, id, s) from selects of (id, txt) and (qid, txt)."""
    return f"""
        texts as ({texts}), asks as ({queries}),
        toks as (select id, unnest({TOKENS.format('txt')}) as tok from texts),
        lens as (select id, len({TOKENS.format('txt')}) as len from texts),
        stats as (select count(*) as n, greatest(avg(len), 1) as avg_len from lens),
        tfs as (select id, tok, count(*) as tf from toks group by all),
        dfs as (select tok, count(*) as df from tfs group by all),
        asked as (select distinct qid, unnest({TOKENS.format('txt')}) as tok from asks),
        bm25 as (
            select qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as s
            from asked join tfs using (tok) join dfs using (tok) join lens using (id), stats group by all
        )"""


def cosine(where: str = "true") -> str:
    """CTE cos(qid, id, s): embeddings against those of the benchmark items' ids."""
    vec = "list_transform(embedding, lambda x: cast(x as double))"
    return f"""
        v as (select vec_id, {vec} as e from embeddings),
        cos as (
            select q.vec_id as qid, d.vec_id as id, list_dot_product(d.e, q.e) / (sqrt(list_dot_product(d.e, d.e)) * sqrt(list_dot_product(q.e, q.e))) as s
            from v d, v q where q.vec_id in (select item_id from benchmark) and {where}
        )"""


def ranked(source: str, name: str, k: int, digits: int = 6, where: str = "true") -> str:
    """CTE ``name``(qid, id, s, r) of the best k."""
    return f"{name} as (select * from (select qid, id, s, row_number() over (partition by qid order by round(s, {digits}) desc, id) as r from {source} where {where}) where r <= {k})"


RRF = "rrf as (select qid, id, sum(1.0 / (60 + r)) as f from (select qid, id, r from lex union all select qid, id, r from sem) group by all)"
