"""Data health, sequence, long-tail, cold-start and vector-coverage profiles."""

from pyspark.sql import DataFrame

from ..functions.quantiles import exact_quantiles
from ..plans.graph import Operator


def first_users(interactions: DataFrame, max_users: int | None = None) -> DataFrame:
    """The events of the users with the smallest ids, for trials: to be given as `interactions`."""
    if max_users is None:
        return interactions
    return interactions.join(interactions.select("user_id").distinct().orderBy("user_id").limit(max_users), "user_id", "left_semi")




def _gap_quantiles(gaps):
    """One row, by histograms that are refined round by round: gaps are as many as events."""
    found = exact_quantiles(gaps, "gap", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return gaps.sparkSession.createDataFrame([tuple(found[c] for c in ("count", "p50", "p90", "p99", "maximum"))], "gap_count long, p50 double, p90 double, p99 double, maximum long")


PROFILE = {
    "first_events": "select user_id, pos, item_rid, action_type, ts from {interactions} order by user_id, pos limit 20",
    # scans and scalar conversions
    "scan_projection": "select user_id, pos, item_rid, action_type, ts from {interactions}",
    "events_exploded": """
        select user_id, cast(x.pos as bigint) as pos, x.item_rid as item_rid from (
            select user_id, @explode(@pack(pos, item_rid)) as x from {interactions} group by user_id) s""",
    "null_fill": "select user_id, pos, cast(coalesce(action_type, -1) as bigint) as action_filled from {interactions}",
    "candidate_seen_count": """
        select count(*) as candidate_count, count(m.item_rid) as seen_count
        from {candidates} c left join {item_map} m on c.item_oid = m.item_oid""",
    "contract_violations": """
        select @count_if(item_rid is null) as null_items, @count_if(ts is null) as null_timestamps, @count_if(item_rid <= 0) as bad_items,
               @count_if(action_type not in (0, 1)) as bad_actions, @count_if(previous > ts) as inversions
        from (select *, lag(ts) over (partition by user_id order by pos) as previous from {interactions}) e""",
    "history_membership": """
        select c.item_oid, c.retrieval_id, m.item_oid is not null as in_history
        from {candidates} c left join {item_map} m on c.item_oid = m.item_oid""",
    "action_tokens": """
        select user_id, pos, cast(case when action_type = 0 then 1 when action_type = 1 then 2 else 3 end as bigint) as action_token from {interactions}""",
    "normalize_ints": """
        select item_oid, try_cast(trim(raw) as bigint) as value, trim(raw) <> '' and try_cast(trim(raw) as bigint) is null as violation
        from (select item_oid, case when retrieval_id % 7 = 0 then ' ' when retrieval_id % 7 = 1 then concat('x', f100_value) else concat(' ', f100_value, ' ') end as raw
              from {candidates}) r""",
    # health
    "pk_profile": """
        select 'part' as table_name, count(*) as row_count, @count_if(p_partkey is null) as null_count, @count_if(p_partkey <= 0) as non_positive,
               count(distinct p_partkey) as unique_count, count(p_partkey) - count(distinct p_partkey) as duplicate_extra from {part}
        union all
        select 'customer', count(*), @count_if(c_custkey is null), @count_if(c_custkey <= 0), count(distinct c_custkey), count(c_custkey) - count(distinct c_custkey) from {customer}
        union all
        select 'orders', count(*), @count_if(o_orderkey is null), @count_if(o_orderkey <= 0), count(distinct o_orderkey), count(o_orderkey) - count(distinct o_orderkey) from {orders}""",
    "sequence_health": """
        select count(distinct e.user_id) as user_count, count(*) as event_count, count(distinct e.item_rid) as unique_items,
               @count_if(e.action_type = 0) as exposures, @count_if(e.action_type = 1) as clicks, @count_if(e.action_type is null) as unknown_actions,
               @count_if(e.previous > e.ts) as inversions, @count_if(f.item_rid is not null) as events_with_features,
               count(distinct case when f.item_rid is not null then e.item_rid end) as items_with_features,
               count(distinct u.user_id) as users_with_features
        from (select *, lag(ts) over (partition by user_id order by pos) as previous from {interactions}) e
        left join {item_features} f on e.item_rid = f.item_rid
        left join {user_raw} u on e.user_id = u.user_id""",
    "null_action_profile": """
        select nulls, count(*) as user_count, @count_if(first_null) as first_is_null, @count_if(last_null) as last_is_null,
               cast(sum(nulls - cast(first_null as int) - case when length > 1 then cast(last_null as int) else 0 end) as bigint) as middle_nulls,
               @count_if(nulls = 1 and last_null) as only_last_null
        from (select user_id, @count_if(action_type is null) as nulls, count(*) as length,
                     @count_if(action_type is null and pos = 0) > 0 as first_null, @count_if(action_type is null and pos = last_pos) > 0 as last_null
              from (select *, max(pos) over (partition by user_id) as last_pos from {interactions}) e group by user_id) u
        group by nulls""",
    "candidate_health": """
        select count(*) as row_count, count(distinct c.item_oid) as unique_items, count(*) - count(distinct c.item_oid) as duplicates,
               count(m.item_rid) as mapped, cast(count(m.item_rid) as double) / nullif(count(*), 0) as mapping_rate,
               min(retrieval_id) = 0 and max(retrieval_id) = count(*) - 1 and count(distinct retrieval_id) = count(*) as contiguous
        from {candidates} c left join {item_map} m on c.item_oid = m.item_oid""",
    "vector_profile": """
        select count(*) as row_count, @count_if(emb is null) as null_vectors, @count_if(@size(emb) <> 64) as wrong_dimension,
               @count_if(@any(emb, @nan(x))) as non_finite, @count_if(@all(emb, x = 0)) as all_zero,
               count(distinct v.item_oid) as unique_items, count(v.item_oid) - count(distinct v.item_oid) as duplicates,
               count(distinct m.item_oid) as history_items, count(distinct c.item_oid) as candidate_items
        from {raw_vectors} v left join {item_map} m on v.item_oid = m.item_oid left join {candidates} c on v.item_oid = c.item_oid""",
    # sequences
    "action_composition": """
        select action_group, n as event_count, cast(n as double) / sum(n) over () as ratio from (
            select case when action_type = 0 then 'exposure' when action_type = 1 then 'click' else 'unknown' end as action_group, count(*) as n
            from {interactions} group by 1) g""",
    "user_action_ratios": """
        select user_id, count(*) as length, @count_if(action_type = 0) as exposures, @count_if(action_type = 1) as clicks, @count_if(action_type is null) as unknowns,
               cast(@count_if(action_type = 1) as double) / nullif(count(action_type), 0) as click_ratio,
               cast(@count_if(action_type is null) as double) / count(*) as unknown_ratio
        from {interactions} group by user_id""",
    "length_bands": """
        select b.band, count(u.user_id) as user_count, cast(count(u.user_id) as double) / nullif((select count(distinct user_id) from {interactions}), 0) as ratio
        from (values ('1-10', 1, 10), ('11-20', 11, 20), ('21-50', 21, 50), ('51-80', 51, 80), ('81-99', 81, 99), ('100+', 100, 1000000000)) b(band, lo, hi)
        left join {user_action_ratios} u on u.length between b.lo and b.hi group by b.band""",
    "click_count_groups": """
        select b.click_group, count(u.user_id) as user_count from (values ('0', 0, 0), ('1', 1, 1), ('2+', 2, 1000000000)) b(click_group, lo, hi)
        left join {user_action_ratios} u on u.clicks between b.lo and b.hi group by b.click_group""",
    "sequence_length_quantiles": """
        select count(*) as user_count, avg(cast(length as double)) as mean, cast(min(length) as double) as minimum, @percentile(length, 0.5) as p50, @percentile(length, 0.9) as p90,
               @percentile(length, 0.95) as p95, @percentile(length, 0.99) as p99, cast(max(length) as double) as maximum
        from {user_action_ratios}""",
    "gaps": """
        select user_id, pos, ts, ts - lag(ts) over (partition by user_id order by pos) as gap from {interactions}""",
    "gap_quantiles": Operator(
        function=_gap_quantiles,
        takes=("gaps",),
        oracle="""
        select count(gap) as gap_count, @percentile(gap, 0.5) as p50, @percentile(gap, 0.9) as p90, @percentile(gap, 0.99) as p99, max(gap) as maximum
        from {gaps} where gap is not null""",
    ),
    "gap_log_histogram": """
        select bin, count(*) as gap_count from (
            select cast(least(119, floor(@log1p(gap) * 120 / top)) as bigint) as bin
            from {gaps} cross join (select greatest(max(@log1p(gap)), 0.000001) as top from {gaps}) t where gap is not null) h
        group by bin""",
    "history_span": """
        select user_id, max(ts) - min(ts) as span_seconds, (max(ts) - min(ts)) / 86400.0e0 as span_days from {interactions} group by user_id""",
    "gap_bands": """
        select b.band, count(g.gap) as gap_count
        from (values ('0s', 0, 0), ('<=1m', 1, 60), ('<=1h', 61, 3600), ('<=1d', 3601, 86400), ('<=7d', 86401, 604800), ('<=30d', 604801, 2592000), ('>30d', 2592001, 100000000000)) b(band, lo, hi)
        left join {gaps} g on g.gap between b.lo and b.hi group by b.band""",
    # long tail
    "item_popularity": """
        select item_rid, count(*) as total, @count_if(action_type = 0) as exposures, @count_if(action_type = 1) as clicks, @count_if(action_type is null) as unknowns
        from {interactions} group by item_rid""",
    "popularity_bands": """
        select b.band, count(p.item_rid) as item_count, cast(coalesce(sum(p.total), 0) as bigint) as event_count
        from (values ('1', 1, 1), ('2-5', 2, 5), ('6-10', 6, 10), ('11-100', 11, 100), ('>100', 101, 1000000000)) b(band, lo, hi)
        left join {item_popularity} p on p.total between b.lo and b.hi group by b.band""",
    # ranks by count come from the histogram of counts, not from a global sort of the items
    "count_histogram": "select total, count(*) as items from {item_popularity} group by total",
    "top_contribution": """
        select fraction, top_items, cast(sum(total * least(items, greatest(top_items - before, 0))) as bigint) as event_count,
               cast(sum(total * least(items, greatest(top_items - before, 0))) as double) / max(all_events) as contribution
        from (select h.*, f.fraction, greatest(1, cast(ceil(all_items * f.fraction) as bigint)) as top_items
              from (select total, items, cast(coalesce(sum(items) over (order by total desc rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
                           sum(items) over () as all_items, sum(total * items) over () as all_events from {count_histogram}) h
              cross join (values (0.01e0), (0.05e0), (0.1e0), (0.2e0)) f(fraction)) x
        group by fraction, top_items""",
    "popularity_thresholds": Operator(row=True, sql="select @percentile(total, 0.5) as p50, @percentile(total, 0.9) as p90 from {item_popularity}"),
    "popularity_labels": """
        select item_rid, total, case when total <= p50 then 'tail' when total <= p90 then 'mid' else 'head' end as popularity_group
        from {item_popularity} cross join {popularity_thresholds}""",
    "popularity_groups": """
        select popularity_group, count(*) as item_count, cast(sum(total) as bigint) as event_count,
               cast(sum(total) as double) / sum(sum(total)) over () as event_share
        from {popularity_labels} group by popularity_group""",
    "popularity_cdf": """
        select total, items, cast(sum(items) over (order by total rows between unbounded preceding and current row) as double) / sum(items) over () as cdf from {count_histogram}""",
    # cold start
    "candidate_fields": """
        select c.item_oid, c.retrieval_id, m.item_rid, m.item_rid is not null as seen, 'f100' as field, c.f100_value as feature_value, cast(c.f100_cold as bigint) as cold_start
        from {candidates} c left join {item_map} m on c.item_oid = m.item_oid
        union all
        select c.item_oid, c.retrieval_id, m.item_rid, m.item_rid is not null, 'f101', case when c.retrieval_id % 5 = 0 then null else cast(c.retrieval_id % 25 as varchar(20)) end,
               cast(case when c.retrieval_id % 3 = 0 then null else c.retrieval_id % 2 end as bigint)
        from {candidates} c left join {item_map} m on c.item_oid = m.item_oid""",
    "cold_start_distribution": """
        select field, case when seen then 'seen' else 'unseen' end as visibility, cold_start, count(*) as row_count from {candidate_fields} group by 1, 2, 3""",
    "feature_availability": """
        select field, case when seen then 'seen' else 'unseen' end as visibility, count(*) as row_count, count(feature_value) as available,
               cast(count(feature_value) as double) / count(*) as available_ratio from {candidate_fields} group by 1, 2""",
    "available_count_dist": """
        select available, count(*) as candidate_count from (select item_oid, count(feature_value) as available from {candidate_fields} group by item_oid) a group by available""",
    "valid_vectors": """
        select item_oid, max(cast(emb is not null and @size(emb) = 64 and @all(emb, not @nan(x)) as int)) = 1 as valid from {raw_vectors} group by item_oid""",
    "seen_mm_matrix": """
        select seen, valid, count(*) as candidate_count, cast(count(*) as double) / sum(count(*)) over (partition by seen) as row_ratio
        from (select m.item_rid is not null as seen, coalesce(v.valid, false) as valid
              from {candidates} c left join {item_map} m on c.item_oid = m.item_oid left join {valid_vectors} v on c.item_oid = v.item_oid) x
        group by seen, valid""",
    "mm_coverage": """
        select group_type, coalesce(group_name, 'all') as group_name, count(*) as item_count, count(vector_oid) as id_count, @count_if(coalesce(valid, false)) as valid_count,
               count(*) - @count_if(coalesce(valid, false)) as missing_count, cast(@count_if(coalesce(valid, false)) as double) / count(*) as valid_ratio
        from (select 'popularity' as group_type, l.popularity_group as group_name, v.item_oid as vector_oid, v.valid
              from {popularity_labels} l left join {valid_vectors} v on l.item_rid + 20000000000 = v.item_oid
              union all
              select 'candidate', case when m.item_rid is not null then 'seen' else 'unseen' end, v.item_oid, v.valid
              from {candidates} c left join {item_map} m on c.item_oid = m.item_oid left join {valid_vectors} v on c.item_oid = v.item_oid) x
        group by grouping sets ((group_type, group_name), (group_type))""",
    "feature_profile": """
        select 'f100' as field, count(*) as row_count, @count_if(f100 is null) as null_count, cast(count(f100) as double) / count(*) as non_null_ratio, count(distinct f100) as distinct_count, cast(null as double) as length_p50 from {item_features}
        union all
        select 'f101', count(*), @count_if(f101 is null), cast(count(f101) as double) / count(*), count(distinct f101), null from {item_features}
        union all
        select 'f102', count(*), @count_if(f102 is null), cast(count(f102) as double) / count(*), count(distinct f102), null from {item_features}
        union all
        select 'f121', count(*), @count_if(f121 is null), cast(count(f121) as double) / count(*), count(distinct f121), null from {item_features}
        union all
        select 'f103', count(*), @count_if(f103 is null), cast(count(f103) as double) / count(*), count(distinct f103), null from {user_raw}
        union all
        select 'f104', count(*), @count_if(f104 is null), cast(count(f104) as double) / count(*), count(distinct f104), null from {user_raw}
        union all
        select 'f106', count(*), @count_if(f106 is null), cast(count(f106) as double) / count(*), (select count(distinct v) from (select @explode(f106) as v from {user_raw}) e), @percentile(@size(f106), 0.5) from {user_raw} where f106 is not null or f106 is null""",
    "candidate_profile": """
        select field, count(*) as row_count, @count_if(feature_value is null) as null_values, count(distinct feature_value) as distinct_values,
               @count_if(cold_start = 0) as cold_0, @count_if(cold_start = 1) as cold_1, @count_if(cold_start is null) as cold_null
        from {candidate_fields} group by field""",
}
