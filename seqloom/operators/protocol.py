"""Evaluation protocol: click targets with strict prefixes, temporal splits, candidates, strength, drift."""

from ..plans.graph import Operator

# Sample ids are consecutive by (user, position).  Offsets are summed over ranges of
# 64 user ids and rows numbered within a range, so no window holds the whole table.

MAPPED_ROWS = """
        select t.user_id, m.item_oid as target_item_oid, t.target_item_rid, t.target_timestamp, t.target_position, cast(0 as bigint) as history_start_position,
               t.history_end_position, t.history_end_position as history_length, cast(floor(t.user_id / 64.0) as bigint) as user_range
        from {click_targets} t join {item_map} m on t.target_item_rid = m.item_rid where t.history_end_position > 0"""
#: Statements of the same results that start from the map of all items.
TRAIN_COUNTS = """
        select e.item_rid, count(*) as train_event_count from {events_plain} e cross join {temporal_cutoffs} c where e.ts < c.validation_start group by e.item_rid"""
STRENGTH = """
        select m.item_rid, coalesce(t.train_event_count, 0) as train_event_count,
               case when coalesce(t.train_event_count, 0) <= 0 then 'Unseen' when t.train_event_count <= h.p50 then 'Tail' when t.train_event_count <= h.p90 then 'Mid' else 'Head' end as strength_group
        from {item_map} m left join {item_train_counts} t on m.item_rid = t.item_rid cross join {strength_thresholds} h"""

PROTOCOL = {
    "click_targets": """
        select user_id, item_rid as target_item_rid, ts as target_timestamp, pos as target_position, history_end as history_end_position
        from {interactions} where action_type = 1""",
    "item_map_uniqueness": """
        select count(*) as row_count, count(distinct item_rid) as unique_rids, count(distinct item_oid) as unique_oids, @count_if(item_rid <= 0) as non_positive
        from {item_map}""",
    # every item of a click is in the map of the events' items, unless one of these is given
    "sample_rows": Operator(
        """
        select user_id, 20000000000 + target_item_rid as target_item_oid, target_item_rid, target_timestamp, target_position, cast(0 as bigint) as history_start_position,
               history_end_position, history_end_position as history_length, cast(floor(user_id / 64.0) as bigint) as user_range
        from {click_targets} where target_item_rid is not null and history_end_position > 0""",
        MAPPED_ROWS,
        instead=(("item_map", MAPPED_ROWS), ("events_plain", MAPPED_ROWS), ("click_targets", MAPPED_ROWS)),
    ),
    "sample_offsets": """
        select user_range, cast(coalesce(sum(n) over (order by user_range rows between unbounded preceding and 1 preceding), 0) as bigint) as first_id
        from (select user_range, count(*) as n from {sample_rows} group by user_range) c""",
    "next_click_samples": Operator(
        """
        select cast(o.first_id + row_number() over (partition by r.user_range order by r.user_id, r.target_position) - 1 as bigint) as sample_id,
               r.user_id, r.target_item_oid, r.target_item_rid, r.target_timestamp, r.target_position, r.history_start_position, r.history_end_position, r.history_length
        from {sample_rows} r join {sample_offsets} o on r.user_range = o.user_range""",
        """
        select cast(row_number() over (order by user_id, target_position) - 1 as bigint) as sample_id,
               user_id, target_item_oid, target_item_rid, target_timestamp, target_position, history_start_position, history_end_position, history_length
        from {sample_rows}""",
    ),
    "target_audit": """
        select count(*) as event_count, @count_if(action_type = 1) as click_targets, count(distinct case when action_type = 1 then user_id end) as users_with_click,
               @count_if(action_type is null) as unknown_actions, @count_if(action_type = 1 and history_end = 0) as empty_history_targets,
               @count_if(action_type = 1 and history_end < pos) as tie_excluded_targets,
               cast(sum(case when action_type = 1 then pos - history_end else 0 end) as bigint) as tie_excluded_events,
               avg(case when action_type = 1 then cast(history_end as double) end) as mean_history
        from {interactions}""",
    # splits
    # seconds of the samples (clicks with an event before them), counted without positions; sums run over days, then within a day
    "timestamp_counts": Operator(
        """
        select e.ts, cast(floor(e.ts / 86400.0) as bigint) as day, count(*) as n
        from {events_plain} e join (select user_id, min(ts) as first_ts from {events_plain} group by user_id) f on e.user_id = f.user_id
        where e.action_type = 1 and e.ts > f.first_ts group by e.ts""",
        instead=(("next_click_samples", "select target_timestamp as ts, cast(floor(target_timestamp / 86400.0) as bigint) as day, count(*) as n from {next_click_samples} group by target_timestamp"),),
    ),
    "boundaries": """
        select t.ts, cast(d.before + coalesce(sum(t.n) over (partition by t.day order by t.ts rows between unbounded preceding and 1 preceding), 0) as double) as before,
               a.total, t.ts > a.least and t.ts < a.most as inside
        from {timestamp_counts} t
        join (select day, coalesce(sum(n) over (order by day rows between unbounded preceding and 1 preceding), 0) as before
              from (select day, sum(n) as n from {timestamp_counts} group by day) x) d on t.day = d.day
        cross join (select cast(sum(n) as double) as total, min(ts) as least, max(ts) as most from {timestamp_counts}) a""",
    "first_cutoff": Operator(row=True, sql="select @arg_min(ts, abs(before - total * 0.8e0), ts) as validation_start from {boundaries} where inside"),
    "temporal_cutoffs": Operator(row=True, sql="""
        select max(c.validation_start) as validation_start, @arg_min(ts, abs(before - total * (0.8e0 + 0.1e0)), ts) as test_start
        from {boundaries} cross join {first_cutoff} c where ts > c.validation_start"""),
    "split_samples": """
        select s.*, case when s.target_timestamp < c.validation_start then 'train' when s.target_timestamp < c.test_start then 'validation' else 'test' end as split
        from {next_click_samples} s cross join {temporal_cutoffs} c""",
    "split_counts": "select split, count(*) as sample_count, min(target_timestamp) as min_ts, max(target_timestamp) as max_ts from {split_samples} group by split",
    "ordered_targets": """
        select *, row_number() over (partition by split, user_id order by target_timestamp, sample_id) as place from {split_samples}""",
    "val_primary": "select sample_id, user_id, target_item_rid, target_timestamp from {ordered_targets} where place <= 1 and split = 'validation'",
    "test_primary": "select sample_id, user_id, target_item_rid, target_timestamp from {ordered_targets} where place <= 1 and split = 'test'",
    "train_capped": "select sample_id, user_id, target_item_rid, target_timestamp from {ordered_targets} where place <= 5 and split = 'train'",
    # candidates
    "additions": """
        select a.item_oid, min(a.phase) as phase
        from (select target_item_oid as item_oid, 1 as phase from {split_samples} where split = 'validation'
              union all select target_item_oid, 2 from {split_samples} where split = 'test') a
        left join {candidates} c on a.item_oid = c.item_oid where c.item_oid is null group by a.item_oid""",
    "eval_candidates": Operator(
        """
        select x.item_oid, m.item_rid, x.retrieval_id, x.source from (
            select item_oid, retrieval_id, 'official' as source from {candidates}
            union all
            select a.item_oid, cast(t.top + o.first_id + row_number() over (partition by a.phase, cast(floor(a.item_oid / 1024.0) as bigint) order by a.item_oid) as bigint),
                   case when a.phase = 1 then 'validation_added' else 'test_added' end
            from {additions} a
            join (select phase, item_range, cast(coalesce(sum(n) over (order by phase, item_range rows between unbounded preceding and 1 preceding), 0) as bigint) as first_id
                  from (select phase, cast(floor(item_oid / 1024.0) as bigint) as item_range, count(*) as n from {additions} group by 1, 2) c) o
              on a.phase = o.phase and cast(floor(a.item_oid / 1024.0) as bigint) = o.item_range
            cross join (select max(retrieval_id) as top from {candidates}) t) x
        left join {item_map} m on x.item_oid = m.item_oid""",
        """
        select x.item_oid, m.item_rid, x.retrieval_id, x.source from (
            select item_oid, retrieval_id, 'official' as source from {candidates}
            union all
            select item_oid, cast((select max(retrieval_id) from {candidates}) + row_number() over (order by phase, item_oid) as bigint),
                   case when phase = 1 then 'validation_added' else 'test_added' end from {additions}) x
        left join {item_map} m on x.item_oid = m.item_oid""",
    ),
    "candidate_coverage": """
        select s.split, count(*) as target_count, count(c.item_oid) as covered, cast(count(c.item_oid) as double) / count(*) as coverage
        from {split_samples} s left join {candidates} c on s.target_item_oid = c.item_oid group by s.split""",
    # strength
    # one pass over the events counts all items, and of each its training events
    "item_counts": """
        select e.item_rid, @count_if(e.ts < c.validation_start) as n from {events_plain} e cross join {temporal_cutoffs} c group by e.item_rid""",
    "item_train_counts": Operator("select item_rid, n as train_event_count from {item_counts} where n > 0", TRAIN_COUNTS),
    "strength_thresholds": Operator(row=True, sql="""
        select @percentile(train_event_count, 0.5) as p50, @percentile(train_event_count, 0.9) as p90, count(*) as seen_items, cast(sum(train_event_count) as bigint) as counted_events
        from {item_train_counts}"""),
    "item_strength": Operator(
        """
        select item_rid, n as train_event_count,
               case when n <= 0 then 'Unseen' when n <= h.p50 then 'Tail' when n <= h.p90 then 'Mid' else 'Head' end as strength_group
        from (select item_rid, case when item_rid is null then 0 else n end as n from {item_counts}) c cross join {strength_thresholds} h""",
        STRENGTH,
        instead=(("item_map", STRENGTH), ("item_train_counts", STRENGTH)),
    ),
    "strength_groups": "select * from (values ('Head'), ('Mid'), ('Tail'), ('Unseen')) g(strength_group)",
    "target_strength_dist": """
        select x.split, x.strength_group, count(t.sample_id) as target_count, cast(count(t.sample_id) as double) / nullif(sum(count(t.sample_id)) over (partition by x.split), 0) as ratio
        from (select s.split, g.strength_group from {strength_groups} g cross join (values ('validation'), ('test')) s(split)) x
        left join (select s.split, s.sample_id, i.strength_group from {split_samples} s join {item_strength} i on s.target_item_rid = i.item_rid) t
          on x.split = t.split and x.strength_group = t.strength_group
        group by x.split, x.strength_group""",
    # drift
    "drift_targets": """
        select s.split, s.target_timestamp, c.validation_start, cast(floor((s.target_timestamp - c.validation_start) / 86400.0e0) as bigint) as day_index, i.strength_group
        from {ordered_targets} s join {item_strength} i on s.target_item_rid = i.item_rid cross join {temporal_cutoffs} c
        where s.split in ('validation', 'test') and s.place <= 1""",
    "drift_daily": """
        select split, day_index, @date(max(validation_start) + day_index * 86400) as bucket_start_date, count(*) as target_count,
               @count_if(strength_group = 'Head') as head_count, @count_if(strength_group = 'Mid') as mid_count,
               @count_if(strength_group = 'Tail') as tail_count, @count_if(strength_group = 'Unseen') as unseen_count,
               cast(@count_if(strength_group = 'Unseen') as double) / count(*) as unseen_ratio,
               sum(count(*)) over (partition by day_index) >= 5 as used_for_trend
        from {drift_targets} group by split, day_index""",
    "drift_split_summary": """
        select split, cast(sum(target_count) as bigint) as target_count, cast(sum(unseen_count) as bigint) as unseen_count,
               cast(sum(unseen_count) as double) / sum(target_count) as unseen_ratio, count(*) as day_count
        from {drift_daily} group by split""",
    "drift_days": """
        select day_index, cast(sum(target_count) as bigint) as target_count, cast(sum(unseen_count) as double) / sum(target_count) as unseen_ratio, min(cast(used_for_trend as int)) = 1 as used_for_trend
        from {drift_daily} group by day_index""",
    "drift_trend": """
        select min(day_index) as first_day, max(day_index) as last_day, round(min(unseen_ratio), 9) as min_unseen, round(max(unseen_ratio), 9) as max_unseen,
               round(sum(unseen_ratio * target_count) / sum(target_count), 9) as weighted_unseen, @count_if(used_for_trend) as eligible_days,
               @arg_min(round(unseen_ratio, 9), day_index) as first_unseen, @arg_max(round(unseen_ratio, 9), day_index) as last_unseen,
               case when @count_if(used_for_trend) >= 2 then round(regr_slope(unseen_ratio, day_index) filter (where used_for_trend), 9) end as slope_per_day
        from {drift_days}""",
    "repeated_targets": """
        select s.split, count(*) as sample_count, @count_if(f.first_pos < s.history_end_position) as repeated,
               cast(@count_if(f.first_pos < s.history_end_position) as double) / count(*) as repeated_ratio,
               @count_if(i.train_event_count > 0) as train_seen, @count_if(i.train_event_count > 0 and f.first_pos < s.history_end_position) as train_seen_repeated
        from {split_samples} s
        join (select user_id, item_rid, min(pos) as first_pos from {interactions} group by user_id, item_rid) f on s.user_id = f.user_id and s.target_item_rid = f.item_rid
        join {item_strength} i on s.target_item_rid = i.item_rid
        group by s.split""",
    "sampled_queries": """
        select sample_id, user_id, target_item_rid from {next_click_samples} order by @md5(sample_id * 7919 + 13), sample_id limit 200""",
}
