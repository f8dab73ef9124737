"""Canonical relations over the star-schema tables: interactions, items, users, vectors."""

from ..plans.graph import Operator

RELATIONS = {
    "interactions": """
        select o_custkey as user_id, l_partkey * 10 + l_suppkey % 10 + 1 as item_rid,
               case l_returnflag when 'R' then 1 when 'A' then 0 else null end as action_type,
               @epoch(o_orderdate) as ts,
               cast(row_number() over (partition by o_custkey order by o_orderdate, l_orderkey, l_linenumber,
                    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as bigint) as pos,
               cast(rank() over (partition by o_custkey order by o_orderdate) - 1 as bigint) as history_end
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    # without positions: where nothing else needs them, the windows go from the plan
    "events_plain": "select user_id, item_rid, action_type, ts from {interactions}",
    "item_map": Operator(
        "select distinct 20000000000 + item_rid as item_oid, item_rid from {events_plain}",
        beside=(("item_counts", "select 20000000000 + item_rid as item_oid, item_rid from {item_counts}"),),
    ),
    "item_features": """
        select m.item_rid, cast(p.p_size as bigint) as f100, cast(substr(p.p_brand, 7) as bigint) as f101,
               nullif((m.item_rid - 1) % 10, 0) as f102, p.p_partkey as f121
        from {item_map} m join {part} p on p.p_partkey = cast(floor((m.item_rid - 1) / 10) as bigint)""",
    "candidate_parts": """
        select 20000000000 + p_partkey * 10 + r_regionkey + 1 as item_oid, p_size, cast(floor(p_partkey / 1024.0) as bigint) as part_range
        from {part} cross join {region} where p_partkey % 3 <> 0""",
    # numbered within ranges of parts, to which the sizes of the earlier ranges are added
    "candidates": Operator(
        """
        select c.item_oid, cast(r.before + row_number() over (partition by c.part_range order by c.item_oid) - 1 as bigint) as retrieval_id,
               cast(c.p_size as varchar(20)) as f100_value, case when c.p_size > 40 then 1 when c.p_size < 5 then null else 0 end as f100_cold
        from {candidate_parts} c
        join (select part_range, coalesce(sum(n) over (order by part_range rows between unbounded preceding and 1 preceding), 0) as before
              from (select part_range, count(*) as n from {candidate_parts} group by part_range) x) r on c.part_range = r.part_range""",
        """
        select item_oid, cast(row_number() over (order by item_oid) - 1 as bigint) as retrieval_id,
               cast(p_size as varchar(20)) as f100_value, case when p_size > 40 then 1 when p_size < 5 then null else 0 end as f100_cold
        from {candidate_parts}""",
    ),
    "raw_vectors": """
        select 20000000000 + (vec_id * 37) % (select count(*) * 10 from {part}) + 1 as item_oid,
               case when vec_id % 50 = 0 then null else embedding end as emb
        from {embeddings}""",
    "user_raw": """
        select c_custkey as user_id, cast(c_nationkey as bigint) as f103,
               case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 when 'HOUSEHOLD' then 3 else null end as f104, f106
        from {customer} left join (select o_custkey, @sorted_set(cast(substr(o_orderpriority, 1, 1) as bigint)) as f106
                                   from {orders} group by o_custkey) o on c_custkey = o_custkey""",
    "activity": """
        select user_id, cast(@json(props, k) as bigint) + 1 as item_rid,
               case event_type when 'click' then 1 when 'purchase' then 1 when 'view' then 0 when 'signup' then 0 else null end as action_type,
               @epoch(ts) as ts
        from {events}""",
}
