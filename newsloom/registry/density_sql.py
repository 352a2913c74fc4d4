"""Density clusters in plain SQL, for small tables: the check of ``cluster_stories``."""

from __future__ import annotations

# ``vecs`` (id, v) in, ``stories`` (id, story) out. Cosines are rounded as in the engine, so that equal distances tie.
DENSITY_SQL = """
units as materialized (select id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u from vecs),
pairs as materialized (
    select a.id as a, b.id as b, sqrt(greatest(2 - 2 * round(list_inner_product(a.u, b.u), 12), 0)) as d
    from units a join units b on a.id <> b.id),
cores as materialized (
    select a as id, max(d) as core from (select a, d from pairs qualify row_number() over (partition by a order by d, b) <= 3) group by a),
reach as materialized (
    select least(a, b) as a, greatest(a, b) as b, a as x, b as y, greatest(d, p.core, q.core) as w
    from pairs join cores p on p.id = a join cores q on q.id = b),
-- every set of rows has its least outgoing edge in the tree, so labels may be merged one hop a round
joining as (
    select 0 as round, id as x, id as label, cast(null as varchar) as a, cast(null as varchar) as b, cast(null as double) as w from units
    union all
    select n.round + 1, n.x, least(n.label, min(n.target) over (partition by n.label), coalesce(min(n.caller) over (partition by n.label), n.label)), n.a, n.b, n.w
    from (
        with state as (select * from joining),
        out as (
            select s.label, min(struct_pack(w := r.w, a := r.a, b := r.b, target := t.label)) as e
            from reach r join state s on s.x = r.x join state t on t.x = r.y where s.label <> t.label group by s.label)
        select s.round, s.x, s.label, e.a, e.b, e.w, e.target as target, c.label as caller
        from state s join out o on o.label = s.label
        left join (select e.target as called, min(label) as label from out group by 1) c on c.called = s.label) n
),
tree as materialized (
    select a, b, w, row_number() over (order by w, a, b) as seq, dense_rank() over (order by w) as level
    from (select distinct a, b, w from joining where a is not null)),
parts as (
    select cast(0 as bigint) as seq, id as x, id as label from units
    union all
    select p.seq + 1, p.x, case when p.label = q.lb or p.label = q.la then least(q.la, q.lb) else p.label end
    from parts p cross join (
        select t.seq, max(s.label) filter (where s.x = t.a) as la, max(s.label) filter (where s.x = t.b) as lb
        from parts s join tree t on t.seq = s.seq + 1 where s.x in (t.a, t.b) group by t.seq) q),
levels as materialized (
    select t.level, t.w, p.x, p.label, count(*) over (partition by t.level, p.label) as size
    from parts p join (select level, max(w) as w, max(seq) as seq from tree group by level) t on t.seq = p.seq),
began as materialized (
    select level, label from (
        select l.level, l.label, count(distinct k.label) as kids
        from levels l left join levels k on k.level = l.level - 1 and k.x = l.x and k.size >= 3
        where l.size >= 3 group by all) where kids <> 1),
within as materialized (
    select level, w, x, label, max(start) over rows_of as s_level, arg_max(label, start) over rows_of as s_label
    from (
        select l.level, l.w, l.x, l.label, case when b.label is not null then l.level end as start
        from levels l left join began b on b.level = l.level and b.label = l.label where l.size >= 3)
    window rows_of as (partition by x order by level rows unbounded preceding)),
named as materialized (
    select level, w, x, max(s_level) over (partition by level, label) as s_level, arg_max(s_label, s_level) over (partition by level, label) as s_label from within),
entered as materialized (
    select s_level, s_label, x, min(level) as level, max(1 / greatest(w, 1e-6)) as density from named group by s_level, s_label, x),
lasted as materialized (select s_level, s_label, max(level) as last from named group by all),
clusters as materialized (
    select row_number() over (order by s_level, s_label) as k, s_level, s_label, last from lasted),
ended as materialized (
    select c.k, p.k as parent, 1 / greatest(n.w, 1e-6) as density
    from clusters c
    join named n on n.level = c.last + 1 and n.x = c.s_label
    join clusters p on p.s_level = n.s_level and p.s_label = n.s_label),
stable as materialized (
    select c.k, e.parent, coalesce(sum(i.density - e.density), 0) as stability
    from clusters c join entered i using (s_level, s_label) left join ended e on e.k = c.k group by c.k, e.parent),
summed as (
    select cast(0 as bigint) as k, cast([] as double[]) as best, cast([] as boolean[]) as chosen
    union all
    select n.k, list_append(n.best, greatest(n.stability, n.below)), list_append(n.chosen, n.parent is not null and n.stability >= n.below)
    from (
        select s.k, s.parent, s.stability, p.best, p.chosen,
               coalesce((select sum(p.best[c.k]) from stable c where c.parent = s.k), 0) as below
        from summed p join stable s on s.k = p.k + 1) n),
picked as materialized (select chosen from summed order by k desc limit 1),
above as (
    select k, k as up from clusters
    union all
    select a.k, s.parent from above a join stable s on s.k = a.up where s.parent is not null),
topmost as materialized (select a.k, max(a.up) as story from above a, picked where chosen[a.up] group by a.k),
stories as (
    select e.x as id, t.story
    from (select x, arg_min(s_level, level) as s_level, arg_min(s_label, level) as s_label from entered group by x) e
    join clusters c using (s_level, s_label) join topmost t using (k))
"""
