"""SQL fragments for DuckDB shared by several checks."""

from __future__ import annotations


def simhash_sql(source: str, text: str, name: str = "hashes") -> str:
    """CTEs ending in ``hashes(id, simhash)`` for the rows of ``source``."""
    votes = ",\n".join(
        f"sum((h >> {b}) & 1::ubigint) * 2 > count(*) as b{b}" for b in range(64)
    )
    value = " + ".join(f"case when b{b} then {1 << b}::hugeint else 0 end" for b in range(64))
    return f"""words as (
        select id, regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') as w from {source}),
    letters as (select id, length(w) as n, unnest(string_split(w, '')) as c,
                       generate_subscripts(string_split(w, ''), 1) as i from words),
    windows as (
        select id, n, i, concat(c, lead(c, 1) over p, lead(c, 2) over p, lead(c, 3) over p) as g
        from letters window p as (partition by id order by i)),
    shingles as (
        select id, ('0x' || substr(md5(g), 17, 16))::ubigint as h from windows where i <= greatest(n - 3, 1)),
    votes as (select id, {votes} from shingles group by id),
    {name} as materialized (
        select id, cast(case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint
                             else v end as bigint) as simhash
        from (select id, {value} as v from votes))
    """


WORDS_SQL = r"list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def counted_sql(rows: str, dim: int = 768) -> str:
    """CTEs ``counted`` (id, bucket, c) and ``weighed`` (id, bucket, x: the embedding's entries) of ``rows`` (id, body)."""
    return f""", spelled as (select id, unnest({WORDS_SQL.format("lower(body)")}) as word from {rows}),
    counted as materialized (
        select id, cast('0x' || substr(md5(word), 1, 8) as bigint) % {dim} as bucket, count(*) as c from spelled group by all),
    weighed as materialized (
        select id, bucket, cast(cast(c / sqrt(sum(c * c) over (partition by id)) as float) as double) as x from counted)
    """
