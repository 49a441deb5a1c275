"""SQL spelling of the same inputs, as common table expressions for DuckDB.

Written apart from the Spark code: plain windows and joins, no blocks.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "located": ((), """
        select user_id // 2 as pos, cast(user_id % 2 as integer) as dir, event_id, ts, event_type,
               value from events"""),
    "seg": (("located",), "select distinct pos, dir from located"),
    "lattice": (("seg",), """
        select pos, dir, unnest(generate_series(timestamp '2024-01-01 00:00:00',
               timestamp '2024-01-30 23:00:00', interval 1 hour)) as t from seg"""),
    "fact": (("located",), """
        select pos, dir, date_trunc('hour', ts) as t, count(*) as flow,
               cast(sum(cast(value as decimal(18,2))) as double) / count(*) as speed,
               cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as heavy,
               max(case when event_type = 'error' then 1 else 0 end) as label
        from located group by all"""),
    "cells": (("lattice", "fact"), """
        select l.pos, l.dir, l.t, coalesce(f.flow, 0) as flow, coalesce(f.heavy, 0) as heavy,
               f.speed, coalesce(f.label, 0) as label, cast(hour(l.t) as integer) as hour,
               cast(isodow(l.t) - 1 as integer) as dow,
               date_diff('hour', timestamp '2024-01-01 00:00:00', l.t) as hidx
        from lattice l left join fact f on l.pos = f.pos and l.dir = f.dir and l.t = f.t"""),
    "traffic": (("cells",), """
        select *, coalesce(speed, cast(40 + (pos * 37 + hidx * 11) % 97 as double)) as v
        from cells"""),
    "hourly_weather": (("lattice",), """
        select t, cast(i % 17 as double) / 10 as precip,
               10 + cast(i % 24 as double) / 2 - cast(i % 53 as double) / 3 as temp,
               cast(i % 40 as double) as gust, cast(i % 31 as double) as wind,
               cast(i % 101 as double) as cloud, cast(i % 13 as double) / 10 as precip3
        from (select distinct t, date_diff('hour', timestamp '2024-01-01 00:00:00', t) as i
              from lattice)"""),
    "scores": (("located",), """
        select event_id, pos, dir, ts, cast(ts as date) as day, cast(hour(ts) as integer) as hour,
               cast(isodow(ts) - 1 as integer) as dow,
               case when event_type = 'error' then 1 else 0 end as y,
               value / cast(500 as double) as pa,
               cast((event_id * 7919) % 1009 as double) / 1009 as pb,
               cast((event_id * 104729) % 997 as double) / 997 as pc from located"""),
    "long_scores": (("scores",), """
        select event_id, pos, dir, ts, day, hour, y, 'pa' as model, pa as score from scores
        union all select event_id, pos, dir, ts, day, hour, y, 'pb', pb from scores
        union all select event_id, pos, dir, ts, day, hour, y, 'pc', pc from scores"""),
    "detector": ((), """
        select l_orderkey as orderkey, l_linenumber as line, l_partkey as partkey,
               l_suppkey as suppkey, l_quantity + l_discount as x, l_linestatus as dir,
               l_shipdate as t, l_extendedprice / 100 as q, l_extendedprice / 100 * l_tax as qh
        from lineitem"""),
    "section": ((), """
        select distinct k, cast(10 * k as double) as lo, cast(10 * k + 10 as double) as hi
        from (select cast(floor(l_quantity / 10) as integer) as k from lineitem)"""),
    "calendar": ((), """
        select cast(o_orderdate as date) as day,
               max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as special
        from orders group by 1"""),
    "geometry": ((), """
        select p_partkey as partkey, p_brand as brand, p_size as size,
               nullif(p_retailprice - 1000, 0) as radius,
               cast(p_partkey % 21 - 10 as double) as up,
               -cast(p_partkey % 21 - 10 as double) as down,
               cast(p_partkey % 100 as double) / 10 as post from part"""),
    "registry": ((), """
        select b.*, id = min(id) over (partition by contrast) as is_proposed,
               'M' || cast(min(id) over (partition by contrast) as varchar) as proposed_key
        from (select 'M' || cast(s_suppkey as varchar) as key, s_suppkey as id,
                     'C' || cast(s_nationkey % 4 as varchar) as contrast,
                     'arm ' || s_name as label, 'g' || cast(s_suppkey % 7 as varchar) as gnn,
                     cast(s_suppkey % 9 as integer) as arch, s_suppkey % 2 = 0 as active_graph,
                     case s_suppkey % 11 when 3 then 'excluded' when 5 then 'data_quantity' end
                       as role from supplier
              union all select 'N' || cast(n_nationkey as varchar), 1000000000 + n_nationkey,
                     'C' || cast(n_nationkey % 4 as varchar), 'arm ' || n_name, 'g' || cast(n_nationkey % 7 as varchar),
                     cast(n_nationkey % 9 as integer), n_nationkey % 2 = 0, null from nation) b"""),
    "arm_scores": ((), """
        select 'M' || cast(l_suppkey as varchar) as key,
               case when l_returnflag = 'R' then 1 else 0 end as y,
               cast((l_orderkey * 31 + l_partkey * 17) % 1000 as double) / 1000 as score,
               case when l_quantity > 40 then 1 else 0 end as pred,
               cast(l_shipdate as date) as day from lineitem"""),
    "pairs": ((), "select doc_id, toxic as y, 1 - quality as pred from labels"),
    "vectors": ((), """
        select vec_id, embedding, case when label = 0 then 1 else 0 end as y from embeddings"""),
    # distinct scores of every model, best first, with running counts
    "curve": (("long_scores",), """
        select model, score, n, pos,
               sum(n) over w as cum_n, sum(pos) over w as cum_pos,
               sum(n) over (partition by model) as tot_n,
               sum(pos) over (partition by model) as tot_pos
        from (select model, score, count(*) as n, sum(y) as pos from long_scores group by all)
        window w as (partition by model order by score desc)"""),
    "pr": (("curve",), """
        select model, score, cum_pos / cast(cum_n as double) as precision,
               cum_pos / cast(tot_pos as double) as recall, cum_n, cum_pos, tot_n, tot_pos, n, pos
        from curve"""),
}


def sql(views: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named inputs and whatever they build on."""
    done: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in done:
            done.append(name)

    for name in views.split():
        need(name)
    parts = [f"{n} as ({CTES[n][1]})" for n in done] + [f"{n} as ({b})" for n, b in extra.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
