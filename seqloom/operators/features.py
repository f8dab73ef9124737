"""Leakage-safe features: tokens, vocabularies, side features, vectors, sequences, sessions."""

from ..plans.graph import Operator



def _numbered(values: str, entity: str) -> Operator:
    """Tokens from 2 on of each field's values, in order: within ranges of values, to which the sizes of the field's earlier ranges are added."""
    return Operator(
        f"""
        select v.entity, v.field, v.value, cast(2 + r.before + row_number() over (partition by v.entity, v.field, r.value_range order by v.value) as bigint) as token
        from {{{values}}} v
        join (select entity, field, value_range, coalesce(sum(n) over (partition by entity, field order by value_range rows between unbounded preceding and 1 preceding), 0) as before
              from (select entity, field, cast(floor(value / 4096.0) as bigint) as value_range, count(*) as n from {{{values}}} group by 1, 2, 3) c) r
          on v.entity = r.entity and v.field = r.field and cast(floor(v.value / 4096.0) as bigint) = r.value_range""",
        f"select entity, field, value, cast(2 + row_number() over (partition by entity, field order by value) as bigint) as token from {{{values}}}",
        instead=(("feature_vocab", f"select * from {{feature_vocab}} where entity = '{entity}'"),),
    )


RELEVANT = "select u.user_id, t.user_id is not null as in_train from (select distinct user_id from {split_samples}) u left join {train_users} t on u.user_id = t.user_id"
USER_VALUES = """
        select 'user' as entity, 'f103' as field, f103 as value from {user_raw} where f103 is not null and user_id in (select user_id from {train_users})
        union select 'user', 'f104', f104 from {user_raw} where f104 is not null and user_id in (select user_id from {train_users})
        union select 'user', 'f106', v from (select @explode(f106) as v from {user_raw} where user_id in (select user_id from {train_users})) x where v is not null"""
ITEM_VALUES = """
        select 'item' as entity, 'f100' as field, f.f100 as value from {item_features} f join {item_train_counts} t on f.item_rid = t.item_rid where f.f100 is not null
        union select 'item', 'f101', f.f101 from {item_features} f join {item_train_counts} t on f.item_rid = t.item_rid where f.f101 is not null
        union select 'item', 'f102', f.f102 from {item_features} f join {item_train_counts} t on f.item_rid = t.item_rid where f.f102 is not null
        union select 'item', 'f121', f.f121 from {item_features} f join {item_train_counts} t on f.item_rid = t.item_rid where f.f121 is not null"""

FEATURES = {
    "item_tokens": """
        select item_rid, cast(case when train_event_count > 0 and item_rid > 0 then item_rid + 1 else 1 end as bigint) as item_token from {item_strength}""",
    "item_strength_features": """
        select item_rid, train_event_count, round(@log1p(train_event_count), 6) as log_count, strength_group from {item_strength}""",
    "mm_validity": """
        select vec_id, emb is not null and @size(emb) = 64 and @all(emb, not @nan(x) and abs(x) < 1e300) as valid, emb is null as missing
        from (select vec_id, case when vec_id % 50 = 0 then null else embedding end as emb from {embeddings}) v""",
    "side_values": """
        select e.item_oid, e.item_rid, e.retrieval_id, e.source, case when e.source = 'official' then try_cast(trim(c.f100_value) as bigint) else f.f100 end as f100_value
        from {eval_candidates} e left join {candidates} c on e.retrieval_id = c.retrieval_id and e.item_oid = c.item_oid left join {item_features} f on e.item_rid = f.item_rid""",
    "train_users": "select distinct user_id from {split_samples} where split = 'train'",
    "relevant_users": Operator(
        "select user_id, user_id is not null and max(coalesce(split = 'train', false)) as in_train from {split_samples} group by user_id",
        RELEVANT,
        instead=(("train_users", RELEVANT),),
    ),
    # a user's or item's values as one array, so that what they are joined with is read once
    "user_vocab_values": Operator(
        """
        select distinct 'user' as entity, x.field, x.value from (
            select explode(concat(array(struct('f103' as field, cast(f103 as bigint) as value), struct('f104' as field, cast(f104 as bigint) as value)),
                                  coalesce(transform(f106, v -> struct('f106' as field, cast(v as bigint) as value)), array()))) as x
            from {user_raw} where user_id in (select user_id from {train_users})) e
        where x.value is not null""",
        USER_VALUES,
    ),
    "item_vocab_values": Operator(
        """
        select distinct 'item' as entity, x.field, x.value from (
            select explode(array(struct('f100' as field, f.f100 as value), struct('f101' as field, f.f101 as value), struct('f102' as field, f.f102 as value), struct('f121' as field, cast(f.f121 as bigint) as value))) as x
            from {item_features} f join {item_train_counts} t on f.item_rid = t.item_rid) e
        where x.value is not null""",
        ITEM_VALUES,
    ),
    "user_vocab": _numbered("user_vocab_values", "user"),
    "item_vocab": _numbered("item_vocab_values", "item"),
    "feature_vocab": "select * from {user_vocab} union all select * from {item_vocab}",
    "user_lists": """
        select x.user_id, x.place, coalesce(v.token, 2) as token from (
            select user_id, cast(row_number() over (partition by user_id order by v) - 1 as bigint) as place, v from (select user_id, @explode(f106) as v from {user_raw}) e) x
        left join (select * from {user_vocab} where field = 'f106') v on x.v = v.value""",
    "user_features": """
        select u.user_id, case when r.f103 is null then 1 else coalesce(a.token, 2) end as f103_token, r.f103 is null as f103_missing, r.f103 is not null and a.token is null as f103_oov,
               case when r.f104 is null then 1 else coalesce(b.token, 2) end as f104_token, r.f104 is null as f104_missing, r.f104 is not null and b.token is null as f104_oov,
               coalesce(l.tokens, case when r.f106 is null then '1' else '' end) as f106_tokens
        from {relevant_users} u left join {user_raw} r on u.user_id = r.user_id
        left join (select value, token from {user_vocab} where field = 'f103') a on r.f103 = a.value
        left join (select value, token from {user_vocab} where field = 'f104') b on r.f104 = b.value
        left join (select user_id, @join(@strings(@map(@pack(place, token), x.token))) as tokens from {user_lists} group by user_id) l on u.user_id = l.user_id""",
    "candidate_side": """
        select s.item_oid, s.retrieval_id, s.source, case when s.f100_value is null then 1 else coalesce(v.token, 2) end as f100_token, s.f100_value is null as f100_missing,
               s.f100_value is not null and v.token is null as f100_oov, coalesce(i.train_event_count, 0) as train_event_count, coalesce(i.strength_group, 'Unseen') as strength_group
        from {side_values} s left join (select value, token from {item_vocab} where field = 'f100') v on s.f100_value = v.value
        left join {item_strength} i on s.item_rid = i.item_rid""",
    # every field that has a vocabulary: of users, of all items and of candidates; a list is missing as a whole, its elements are out of vocabulary
    "item_coverage": """
        select field, count(*) as row_count, @count_if(value is null) as missing, @count_if(value is not null and token is null) as oov from (
            select x.field, x.value, v.token
            from (select g.field, case g.field when 'f100' then f.f100 when 'f101' then f.f101 when 'f102' then f.f102 else f.f121 end as value
                  from {item_features} f cross join (values ('f100'), ('f101'), ('f102'), ('f121')) g(field)) x
            left join {item_vocab} v on x.field = v.field and x.value = v.value) y group by field""",
    "vocab_coverage": """
        select c.entity, c.field, c.row_count, c.missing, c.oov, c.value_count, coalesce(k.known, 0) as known,
               coalesce(cast(c.missing as double) / nullif(c.row_count, 0), 0.0e0) as missing_rate, coalesce(cast(c.oov as double) / nullif(c.value_count, 0), 0.0e0) as oov_rate
        from (select 'user' as entity, 'f103' as field, count(*) as row_count, @count_if(f103_missing) as missing, @count_if(f103_oov) as oov, count(*) as value_count from {user_features}
              union all select 'user', 'f104', count(*), @count_if(f104_missing), @count_if(f104_oov), count(*) from {user_features}
              union all select 'user', 'f106', u.row_count, u.missing, l.oov, l.value_count
                        from (select count(*) as row_count, @count_if(f106_tokens = '1') as missing from {user_features}) u
                        cross join (select @count_if(x.token = 2) as oov, count(*) as value_count from {user_lists} x where x.user_id in (select user_id from {relevant_users})) l
              union all select 'item', g.field, coalesce(i.row_count, 0), coalesce(i.missing, 0), coalesce(i.oov, 0), coalesce(i.row_count, 0)
                        from (values ('f100'), ('f101'), ('f102'), ('f121')) g(field) left join {item_coverage} i on g.field = i.field
              union all select 'candidate', 'f100', count(*), @count_if(f100_missing), @count_if(f100_oov), count(*) from {candidate_side}) c
        left join (select entity, field, count(*) as known from {feature_vocab} group by entity, field) k
          on k.entity = case c.entity when 'candidate' then 'item' else c.entity end and k.field = c.field""",
    "candidate_item_consistency": """
        select 'f100' as field, count(*) as compared, @count_if(a is not null and b is not null) as both_present, @count_if(a = b) as equal_count, @count_if(a <> b) as mismatches,
               @count_if(a is null and b is not null) as candidate_missing, @count_if(a is not null and b is null) as item_missing,
               cast(@count_if(a = b) as double) / nullif(@count_if(a is not null and b is not null), 0) as match_ratio
        from (select try_cast(trim(c.f100_value) as bigint) as a, f.f100 as b
              from {candidates} c join {item_map} m on c.item_oid = m.item_oid join {item_features} f on m.item_rid = f.item_rid) x""",
    "mm_alignment": """
        select e.item_oid, e.item_rid, e.retrieval_id, v.item_oid is not null as has_vector, coalesce(v.valid, false) as valid
        from {eval_candidates} e left join {valid_vectors} v on e.item_oid = v.item_oid""",
    # histories: a prefix is a join on the user with a bound on the position, never stored
    "history_prefix": """
        select s.sample_id, count(e.pos) as history_length, max(e.ts) as last_ts, cast(sum(e.item_rid) as bigint) as item_checksum, @count_if(e.ts >= s.target_timestamp) as leaks
        from {split_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position
        where s.split = 'validation' group by s.sample_id""",
    "recent_history": """
        select s.sample_id, e.pos, e.item_rid, e.action_type from {val_samples} s join {interactions} e on s.user_id = e.user_id
        where e.pos < s.history_end_position and s.history_end_position - e.pos <= 20""",
    "val_samples": """
        select o.sample_id, o.user_id, o.target_item_rid, o.target_timestamp, o.history_end_position from {ordered_targets} o where o.split = 'validation' and o.place <= 1""",
    "recency_features": """
        select s.sample_id, e.pos, s.target_timestamp - e.ts as recency_seconds, round(@log1p(s.target_timestamp - e.ts), 6) as log_recency
        from {val_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position""",
    "gap_features": """
        select user_id, pos, coalesce(gap, 0) as gap_seconds, round(@log1p(coalesce(gap, 0)), 6) as log_gap, gap is null as first_event from {gaps}""",
    "time_buckets": """
        select user_id, pos, cast(cast(g >= 60 as int) + cast(g >= 3600 as int) + cast(g >= 86400 as int) + cast(g >= 604800 as int) + cast(g >= 2592000 as int) as bigint) as bucket
        from (select user_id, pos, coalesce(gap, 0) as g from {gaps}) x""",
    "sequence_offsets": Operator(
        """
        select u.user_id, u.length, cast(o.first_event + coalesce(sum(u.length) over (partition by u.user_range order by u.user_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_event
        from (select user_id, count(*) as length, cast(floor(user_id / 64.0) as bigint) as user_range from {interactions} group by user_id) u
        join (select user_range, cast(coalesce(sum(n) over (order by user_range rows between unbounded preceding and 1 preceding), 0) as bigint) as first_event
              from (select cast(floor(user_id / 64.0) as bigint) as user_range, count(*) as n from {interactions} group by 1) c) o on u.user_range = o.user_range""",
        """
        select user_id, length, cast(coalesce(sum(length) over (order by user_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_event
        from (select user_id, count(*) as length from {interactions} group by user_id) u""",
    ),
    "next_click_features": """
        select s.sample_id, s.user_id, t.item_token as target_token, i.train_event_count as target_count, round(@log1p(i.train_event_count), 6) as target_log_count, i.strength_group,
               coalesce(v.valid, false) as target_vector_valid, s.history_end_position as history_length, h.last_action_token, u.f103_token, u.f104_token
        from {split_samples} s join {item_tokens} t on s.target_item_rid = t.item_rid join {item_strength} i on s.target_item_rid = i.item_rid
        left join {valid_vectors} v on s.target_item_oid = v.item_oid
        left join (select user_id, pos, cast(case when action_type = 0 then 1 when action_type = 1 then 2 else 3 end as bigint) as last_action_token from {interactions}) h
          on s.user_id = h.user_id and h.pos = s.history_end_position - 1
        left join {user_features} u on s.user_id = u.user_id
        where s.split in ('validation', 'test')""",
    # time statistics over all training prefixes: gaps and first flags from running sums per user, recency from the prefixes
    "train_prefix_sums": """
        select s.sample_id, s.history_end_position as n, p.sum_gap, p.sum_gap_sq
        from {split_samples} s
        join (select user_id, pos, sum(@log1p(coalesce(gap, 0))) over (partition by user_id order by pos) as sum_gap,
                     sum(@log1p(coalesce(gap, 0)) * @log1p(coalesce(gap, 0))) over (partition by user_id order by pos) as sum_gap_sq from {gaps}) p
          on s.user_id = p.user_id and p.pos = s.history_end_position - 1
        where s.split = 'train'""",
    "time_norm_stats": """
        select cast(g.events as bigint) as event_count, round(r.mean_recency, 6) as mean_log_recency, round(sqrt(greatest(r.square - r.mean_recency * r.mean_recency, 1e-12)), 6) as std_log_recency,
               round(g.gap / g.events, 6) as mean_log_gap, round(sqrt(greatest(g.gap_sq / g.events - (g.gap / g.events) * (g.gap / g.events), 1e-12)), 6) as std_log_gap,
               round(g.firsts / g.events, 6) as mean_first, round(sqrt(greatest(g.firsts / g.events - (g.firsts / g.events) * (g.firsts / g.events), 1e-12)), 6) as std_first
        from (select cast(sum(n) as double) as events, sum(sum_gap) as gap, sum(sum_gap_sq) as gap_sq, cast(count(*) as double) as firsts from {train_prefix_sums}) g
        cross join (select avg(x) as mean_recency, avg(x * x) as square from (
            select @log1p(s.target_timestamp - e.ts) as x from {split_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position where s.split = 'train') p) r""",
    # sessions over the activity stream
    "activity_events": """
        select user_id, item_rid, action_type, ts, cast(row_number() over (partition by user_id order by ts, item_rid, coalesce(action_type, -1)) - 1 as bigint) as pos,
               cast(rank() over (partition by user_id order by ts) - 1 as bigint) as history_end from {activity}""",
    "activity_samples": """
        select user_id, ts as target_ts, item_rid as target_item, pos as target_pos, history_end, user_id * 1000000 + pos as sample_id
        from {activity_events} where action_type = 1 and history_end > 0""",
    "session_candidates": "select * from (values (1800), (3600), (21600), (86400), (604800)) g(gap_seconds)",
    # the last split before a sample's end is a running maximum over the user's events
    "session_starts": """
        select user_id, pos, gap_seconds, max(case when gap > gap_seconds then pos end) over (partition by user_id, gap_seconds order by pos rows between unbounded preceding and current row) as boundary
        from (select user_id, pos, ts - lag(ts) over (partition by user_id order by pos) as gap from {activity_events}) e cross join {session_candidates}""",
    "session_split": """
        select s.sample_id, cast(b.gap_seconds as bigint) as gap_seconds, s.history_end - coalesce(b.boundary, 0) as short_length, coalesce(b.boundary, 0) as long_length
        from {activity_samples} s join {session_starts} b on s.user_id = b.user_id and b.pos = s.history_end - 1""",
    # no limits unless given: the most events of a history, of a short session and of what comes before it
    "batch_limits": Operator(row=True, sql="select cast(null as bigint) as max_history, cast(null as bigint) as short_events, cast(null as bigint) as long_events"),
    "session_batches": """
        select s.sample_id, s.gap_seconds, least(s.short_length, coalesce(l.short_events, s.short_length)) as short_kept, least(s.long_length, coalesce(l.long_events, s.long_length)) as long_kept,
               coalesce(s.short_length > l.short_events, false) as short_truncated, coalesce(s.long_length > l.long_events, false) as long_truncated
        from {session_split} s cross join {batch_limits} l""",
    # quantiles from the histogram of lengths: its rows are the distinct lengths of a gap, not the samples
    "length_counts": """
        select gap_seconds, short_length, sum(n) over (partition by gap_seconds order by short_length) as upto, sum(n) over (partition by gap_seconds) as n
        from (select gap_seconds, short_length, count(*) as n from {session_split} group by gap_seconds, short_length) x""",
    "session_gap_stats": """
        select l.gap_seconds, cast(max(l.n) as bigint) as sample_count,
               min(case when l.upto >= ceil(0.5e0 * (l.n - 1)) + 1 then l.short_length end) as p50, min(case when l.upto >= ceil(0.9e0 * (l.n - 1)) + 1 then l.short_length end) as p90,
               min(case when l.upto >= ceil(0.95e0 * (l.n - 1)) + 1 then l.short_length end) as p95, min(case when l.upto >= ceil(0.99e0 * (l.n - 1)) + 1 then l.short_length end) as p99,
               max(r.empty_long) as empty_long, max(r.single_short) as single_short, max(r.truncated) as truncated
        from {length_counts} l
        join (select gap_seconds, cast(@count_if(long_length = 0) as double) / count(*) as empty_long, cast(@count_if(short_length = 1) as double) / count(*) as single_short,
                     cast(@count_if(short_length > 20) as double) / count(*) as truncated from {session_split} group by gap_seconds) r on l.gap_seconds = r.gap_seconds
        group by l.gap_seconds""",
    "select_session_gap": """
        select @arg_max(gap_seconds, hit_ratio, 0 - gap_seconds) as selected_gap, max(hit_ratio) as hit_ratio from (
            select x.gap_seconds, cast(@count_if(hit) as double) / count(*) as hit_ratio from (
                select p.gap_seconds, s.sample_id, max(cast(e.item_rid = s.target_item as int)) = 1 as hit
                from {activity_samples} s join {session_split} p on s.sample_id = p.sample_id
                join {activity_events} e on s.user_id = e.user_id and e.pos < s.history_end and e.pos >= p.long_length group by p.gap_seconds, s.sample_id) x group by x.gap_seconds) y""",
}
