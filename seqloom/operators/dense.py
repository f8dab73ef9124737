"""Dense retrieval over given vectors: pooling, exact and hashed top-k, losses, sampling, gates."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.dense import VectorIndex, exact_top_k, lsh_top_k
from ..plans.graph import Operator

TOP_SQL = """
    select query_id, item_id, score, cast(place as bigint) as rank from (
        select *, row_number() over (partition by query_id order by score desc, item_id) as place from (
            select q.query_id, i.item_id, round(@dot(q.vector, i.vector), 6) as score from {query_vectors} q cross join {index_vectors} i {filter}) s) r
    where place <= 500"""


#: Dense lists hold so many items, the largest K that is evaluated.
TOP = 500


def _top(query_vectors, index_vectors):
    return exact_top_k(query_vectors, index_vectors, TOP)


def _top_lsh(query_vectors, index_vectors, packed=False):
    return lsh_top_k(query_vectors, index_vectors, TOP, packed=packed)


def _top_index(query_vectors, index_vectors, packed=False):
    """The inverted file's lists, with as many probes as a sample of the queries needs."""
    index = VectorIndex.build(index_vectors)
    return index.top_k(query_vectors, TOP, index.probes_for(query_vectors, TOP) if index.n_items else 1, packed=packed)


def _audited_lists(query_vectors, index_vectors):
    """A row per query with its exact, hashed and probed list."""
    exact = _pooled_lists(query_vectors, index_vectors).select("query_id", F.col("items").alias("exact"))
    hashed = _top_lsh(query_vectors, index_vectors, packed=True).select("query_id", F.col("items").alias("hashed"))
    probed = _top_index(query_vectors, index_vectors, packed=True).select("query_id", F.col("items").alias("probed"))
    return exact.join(hashed, "query_id", "left").join(probed, "query_id", "left")


def _top_unseen(query_vectors, index_vectors, history_items):
    """The best without the query's own history, which the kernel leaves out per query."""
    skip = history_items.groupBy("query_id").agg(F.collect_set("item_id").alias("skip"))
    return exact_top_k(query_vectors.join(skip, "query_id", "left"), index_vectors, TOP)


def _channel_top(channel_vectors, index_vectors):
    return exact_top_k(channel_vectors, index_vectors, TOP)


def _channel_target_ranks(channel_vectors, index_vectors, query_samples):
    """Where each query's own target stands, without the lists around it."""
    targets = query_samples.select("sample_id", F.col("target_item_rid").alias("wanted"))
    own = channel_vectors.withColumn("sample_id", F.expr("query_id div 4")).join(targets, "sample_id").drop("sample_id")
    return exact_top_k(own, index_vectors, TOP).select("query_id", "rank")


def _target_ranks(vectors, index_vectors, query_samples):
    """(sample_id, rank) where each sample's own target stands, of queries that are samples."""
    own = vectors.join(query_samples.select(F.col("sample_id").alias("query_id"), F.col("target_item_rid").alias("wanted")), "query_id")
    return exact_top_k(own, index_vectors, TOP).select(F.col("query_id").alias("sample_id"), "rank")


def _hit_lists(vectors, index_vectors, hits):
    return _pooled_lists(vectors.join(hits.select(F.col("sample_id").alias("query_id")), "query_id", "left_semi"), index_vectors)


def _pooled(pooled_events):
    """The mean of each query's vectors at length 1, rounded; none where the mean is zero.  Vectors are summed
    whole, so a history's dimensions are not rows."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("emb").cast("array<double>"))))
    norm = F.sqrt(F.aggregate(F.transform("mean", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    means = pooled_events.groupBy("query_id").agg(mean.alias("mean")).withColumn("norm", norm)
    return means.select("query_id", F.when(F.col("norm") > 0, F.transform("mean", lambda x: F.round(x / F.col("norm"), 6))).alias("vector"))


def _pooled_lists(vectors, index_vectors):
    """The lists as one array of items per query, in order."""
    return exact_top_k(vectors, index_vectors, TOP, packed=True)


def _split_lists(split: str) -> dict[str, Operator]:
    """The lists of dense_all for one split; the query is the sample."""
    events, vectors = f"{split}_dense_events", f"{split}_dense_vectors"
    return {
        events: f"""
        select q.sample_id as query_id, e.emb from {{query_samples}} q join {{vector_events}} e on q.user_id = e.user_id and e.pos < q.history_end_position where q.split = '{split}'""",
        vectors: Operator(function=lambda **x: _pooled(x[events]), takes=(events,)),
        f"{split}_dense_lists": Operator(function=lambda **x: _pooled_lists(x[vectors], x["index_vectors"]), takes=(vectors, "index_vectors")),
        f"{split}_dense_target_ranks": Operator(function=lambda **x: _target_ranks(x[vectors], x["index_vectors"], x["query_samples"]), takes=(vectors, "index_vectors", "query_samples")),
        f"{split}_hit_dense_lists": Operator(function=lambda **x: _hit_lists(x[vectors], x["index_vectors"], x[f"{split}_hits"]), takes=(vectors, "index_vectors", f"{split}_hits")),
    }


DENSE = {
    "vector_rows": """
        select item_oid, item_oid - 20000000000 as item_rid, emb from (
            select v.item_oid, v.emb, row_number() over (partition by v.item_oid order by v.vec_id) as place
            from (select vec_id, 20000000000 + (vec_id * 37) % (select count(*) * 10 from {part}) + 1 as item_oid, case when vec_id % 50 = 0 then null else embedding end as emb from {embeddings}) v
            where v.emb is not null) r where place = 1""",
    "item_vectors": """
        select item_oid, cast(d as bigint) as dim, round(cast(@at(emb, d) as double) / norm, 6) as value
        from (select item_oid, emb, sqrt(@dot(emb, emb)) as norm, @explode(@range(1, 64)) as d from {vector_rows}) x""",
    "history_dims": """
        select s.sample_id, cast(x.d as bigint) as dim, avg(cast(@at(x.emb, x.d) as double)) as value
        from {val_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position
        join (select item_rid, emb, @explode(@range(1, 64)) as d from {vector_rows}) x on e.item_rid = x.item_rid
        group by s.sample_id, x.d""",
    # events with a vector, which are few where vectors are
    "vector_events": """
        select e.user_id, e.pos, e.action_type, v.emb from {interactions} e join {vector_rows} v on e.item_rid = v.item_rid""",
    "query_events": """
        select s.sample_id as query_id, e.emb from {val_samples} s join {vector_events} e on s.user_id = e.user_id and e.pos < s.history_end_position""",
    "user_vectors": """
        select h.sample_id, h.dim, round(h.value / nullif(n.norm, 0), 6) as value
        from {history_dims} h join (select sample_id, sqrt(sum(value * value)) as norm from {history_dims} group by sample_id) n on h.sample_id = n.sample_id""",
    "query_vectors": Operator(
        function=lambda query_events: _pooled(query_events),
        takes=("query_events",),
        oracle="""
        select sample_id as query_id, @map(@pack(dim, value), x.value) as vector from {user_vectors} group by sample_id""",
        instead=tuple((name, """
        select sample_id as query_id, @map(@pack(dim, value), x.value) as vector from {user_vectors} group by sample_id""") for name in ("user_vectors", "history_dims")),
    ),
    "train_candidates": """
        select c.item_oid, c.item_rid, c.retrieval_id, cast(floor(c.retrieval_id / 4096.0) as bigint) as id_range
        from {eval_candidates} c join {item_train_counts} t on c.item_rid = t.item_rid""",
    "indexed_candidates": Operator(
        """
        select c.item_oid, c.item_rid, c.retrieval_id, cast(r.before + row_number() over (partition by c.id_range order by c.retrieval_id) - 1 as bigint) as row_number
        from {train_candidates} c
        join (select id_range, cast(coalesce(sum(n) over (order by id_range rows between unbounded preceding and 1 preceding), 0) as bigint) as before
              from (select id_range, count(*) as n from {train_candidates} group by id_range) x) r on c.id_range = r.id_range""",
        "select item_oid, item_rid, retrieval_id, cast(row_number() over (order by retrieval_id) - 1 as bigint) as row_number from {train_candidates}",
    ),
    "index_vectors": """
        select v.item_rid as item_id, @map(v.emb, cast(x as double)) as vector from {vector_rows} v
        where v.item_rid in (select item_rid from {item_train_counts})""",
    "dense_topk_exact": Operator(function=_top, takes=("query_vectors", "index_vectors"), oracle=TOP_SQL.replace("{filter}", "")),
    "dense_topk_lsh": Operator(function=_top_lsh, takes=("query_vectors", "index_vectors")),
    "dense_topk_index": Operator(function=_top_index, takes=("query_vectors", "index_vectors")),
    # the dense channel: pooled histories of the evaluation's samples in three variants, the query's number being 4 * sample + variant
    "pooling": """
        select * from (values ('dense_all', 0, 1000000000, true), ('dense_recent20', 1, 20, true), ('dense_clicks', 2, 1000000000, false)) x(variant, place, history_limit, exposures)""",
    "channel_dims": """
        select q.sample_id * 4 + p.place as query_id, cast(x.d as bigint) as dim, avg(cast(@at(x.emb, x.d) as double)) as value
        from {query_samples} q join {interactions} e on q.user_id = e.user_id and e.pos < q.history_end_position
        cross join {pooling} p
        join (select item_rid, emb, @explode(@range(1, 64)) as d from {vector_rows}) x on e.item_rid = x.item_rid
        where q.history_end_position - e.pos <= p.history_limit and (p.exposures or e.action_type = 1) group by q.sample_id * 4 + p.place, x.d""",
    "channel_events": """
        select q.sample_id * 4 + p.place as query_id, e.emb
        from {query_samples} q join {vector_events} e on q.user_id = e.user_id and e.pos < q.history_end_position cross join {pooling} p
        where q.history_end_position - e.pos <= p.history_limit and (p.exposures or e.action_type = 1)""",
    **_split_lists("test"),
    **_split_lists("validation"),
    "channel_vectors": Operator(
        function=lambda channel_events: _pooled(channel_events),
        takes=("channel_events",),
        oracle="""
        select h.query_id, @map(@pack(dim, unit), x.unit) as vector
        from (select d.query_id, d.dim, round(d.value / nullif(n.norm, 0), 6) as unit
              from {channel_dims} d join (select query_id, sqrt(sum(value * value)) as norm from {channel_dims} group by query_id) n on d.query_id = n.query_id) h
        group by h.query_id""",
        instead=(("channel_dims", """
        select h.query_id, @map(@pack(dim, unit), x.unit) as vector
        from (select d.query_id, d.dim, round(d.value / nullif(n.norm, 0), 6) as unit
              from {channel_dims} d join (select query_id, sqrt(sum(value * value)) as norm from {channel_dims} group by query_id) n on d.query_id = n.query_id) h
        group by h.query_id"""),),
    ),
    "channel_top": Operator(function=_channel_top, takes=("channel_vectors", "index_vectors"), oracle=TOP_SQL.replace("{filter}", "").replace("{query_vectors}", "{channel_vectors}")),
    "dense_retrieve": """
        select p.variant, q.split, q.sample_id, t.item_id as item_rid, t.score, t.rank
        from {query_samples} q cross join {pooling} p join {channel_top} t on t.query_id = q.sample_id * 4 + p.place""",
    "channel_target_ranks": Operator(function=_channel_target_ranks, takes=("channel_vectors", "index_vectors", "query_samples")),
    "dense_ranks": Operator(
        """
        select p.variant, q.split, q.sample_id, q.target_item_rid, i.strength_group, r.rank as target_rank
        from {query_samples} q cross join {pooling} p join {item_strength} i on q.target_item_rid = i.item_rid
        left join {channel_target_ranks} r on r.query_id = q.sample_id * 4 + p.place""",
        """
        select p.variant, q.split, q.sample_id, q.target_item_rid, i.strength_group, r.rank as target_rank
        from {query_samples} q cross join {pooling} p join {item_strength} i on q.target_item_rid = i.item_rid
        left join {dense_retrieve} r on r.variant = p.variant and r.split = q.split and r.sample_id = q.sample_id and r.item_rid = q.target_item_rid""",
        instead=tuple((name, """
        select p.variant, q.split, q.sample_id, q.target_item_rid, i.strength_group, r.rank as target_rank
        from {query_samples} q cross join {pooling} p join {item_strength} i on q.target_item_rid = i.item_rid
        left join {dense_retrieve} r on r.variant = p.variant and r.split = q.split and r.sample_id = q.sample_id and r.item_rid = q.target_item_rid""") for name in ("dense_retrieve", "channel_top")),
    ),
    "history_items": """
        select distinct s.sample_id as query_id, e.item_rid as item_id from {val_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position""",
    "dense_topk_no_history": Operator(
        function=_top_unseen,
        takes=("query_vectors", "index_vectors", "history_items"),
        oracle=TOP_SQL.replace("{filter}", "where not exists (select 1 from {history_items} h where h.query_id = q.query_id and h.item_id = i.item_id)"),
    ),
    # all queries' lists by hashing and by the inverted file against their exact ones, cut at the same k
    "ann_lists": """
        select 'hashing' as method, query_id, item_id, rank from {dense_topk_lsh} union all select 'inverted_file', query_id, item_id, rank from {dense_topk_index}""",
    "audited_lists": Operator(function=_audited_lists, takes=("query_vectors", "index_vectors")),
    "ann_recall_audit": Operator(
        """
        select method, k, avg(overlap) as mean_overlap, percentile(overlap, 0.05) as p05_overlap, percentile(overlap, 0.5) as p50_overlap, min(overlap) as min_overlap, count(*) as query_count
        from (select m.method, cast(v.k as bigint) as k, coalesce(cast(size(array_intersect(slice(a.exact, 1, v.k), slice(case m.method when 'hashing' then a.hashed else a.probed end, 1, v.k))) as double), 0.0e0) / size(slice(a.exact, 1, v.k)) as overlap
              from (select query_id, exact, coalesce(hashed, array()) as hashed, coalesce(probed, array()) as probed from {audited_lists}) a
              cross join (select cast(k as int) as k from (values (10), (50), (100), (500)) v(k)) v cross join (values ('hashing'), ('inverted_file')) m(method)) o
        group by method, k""",
        instead=tuple((name, """
        select method, k, avg(overlap) as mean_overlap, @percentile(overlap, 0.05) as p05_overlap, @percentile(overlap, 0.5) as p50_overlap, min(overlap) as min_overlap, count(*) as query_count
        from (select k.method, k.k, e.query_id, cast(count(a.item_id) as double) / count(*) as overlap
              from {dense_topk_exact} e join (select m.method, cast(k as bigint) as k from (values (10), (50), (100), (500)) v(k) cross join (values ('hashing'), ('inverted_file')) m(method)) k on e.rank <= k.k
              left join {ann_lists} a on a.method = k.method and e.query_id = a.query_id and e.item_id = a.item_id and a.rank <= k.k group by k.method, k.k, e.query_id) o
        group by method, k""") for name in ("dense_topk_exact", "dense_topk_lsh", "dense_topk_index", "ann_lists")),
    ),
    "two_tower_metrics": """
        select k.k as k, count(*) as sample_count, cast(@count_if(rank <= k.k) as double) / count(*) as recall,
               round(sum(case when rank <= k.k then 1.0e0 / @ilog2(rank + 1.0e0) else 0.0e0 end) / count(*), 6) as ndcg
        from (select s.sample_id, case when i.strength_group = 'Unseen' then null else r.rank end as rank
              from {val_samples} s join {item_strength} i on s.target_item_rid = i.item_rid
              left join {dense_topk_exact} r on s.sample_id = r.query_id and s.target_item_rid = r.item_id) x
        cross join (select cast(k as bigint) as k from (values (10), (50), (100), (500)) v(k)) k group by k.k""",
    "strength_gate": """
        select item_rid, train_event_count, case when train_event_count = 0 then 0.0e0
               else round(1.0e0 / (1.0e0 + exp(0 - (ln(1 + exp(0.5e0)) * @log1p(train_event_count) - 1.0e0))), 6) end as gate
        from {item_strength}""",
    "strength_gate_audit": """
        select s.strength_group, count(*) as item_count, round(avg(g.gate), 6) as mean_gate, round(@percentile(g.gate, 0.1), 6) as p10, round(@percentile(g.gate, 0.5), 6) as p50, round(@percentile(g.gate, 0.9), 6) as p90
        from {strength_gate} g join {item_strength} s on g.item_rid = s.item_rid group by s.strength_group""",
    "embedding_audit": """
        select count(*) as row_count, @count_if(@all(emb, x = 0)) as zero_vectors, @count_if(@any(emb, @nan(x))) as non_finite,
               count(*) - count(distinct @join(@strings(@map(emb, cast(round(cast(x as double) * 10000000) as bigint))))) as duplicates
        from {vector_rows}""",
    # negatives: 40 hashed draws a sample from all train-seen items, numbered by ranges; target and history are excluded.
    # Samples that keep fewer than 20 draw again, from all that is left; fewer than 20 then is an error.
    "loss_samples": "select sample_id, user_id, target_item_rid, history_end_position from {split_samples} where split in ('train', 'validation')",
    "pool_ranges": """
        select pool_range, cast(coalesce(sum(n) over (order by pool_range rows between unbounded preceding and 1 preceding), 0) as bigint) as before
        from (select cast(floor(item_rid / 4096.0) as bigint) as pool_range, count(*) as n from {item_train_counts} group by 1) c""",
    "negative_pool": """
        select t.item_rid, cast(r.before + row_number() over (partition by r.pool_range order by t.item_rid) - 1 as bigint) as number
        from {item_train_counts} t join {pool_ranges} r on cast(floor(t.item_rid / 4096.0) as bigint) = r.pool_range""",
    "pool_size": Operator(row=True, sql="select count(*) as items from {item_train_counts}"),
    "draw_numbers": """
        select sample_id, user_id, target_item_rid, history_end_position, draw, h2 * h2 % 2147483647 % items as number from (
            select *, (h1 * h1 % 2147483647 * 16807 + draw) % 2147483647 as h2 from (
                select *, (sample_id % 2147483647 * 48271 + draw * 69621 + 5) % 2147483647 as h1 from (
                    select *, @explode(@range(1, 40)) as draw from {loss_samples}) a) b) c cross join {pool_size}""",
    "negative_draws": """
        select d.sample_id, d.item_rid, d.draw
        from (select x.sample_id, x.user_id, x.history_end_position, p.item_rid, cast(min(x.draw) as bigint) as draw from {draw_numbers} x join {negative_pool} p on x.number = p.number
              where p.item_rid <> x.target_item_rid group by x.sample_id, x.user_id, x.history_end_position, p.item_rid) d
        where not exists (select 1 from {interactions} e where e.user_id = d.user_id and e.item_rid = d.item_rid and e.pos < d.history_end_position)""",
    "negative_redraws": """
        select d.sample_id, d.item_rid, cast(41 as bigint) as draw
        from (select s.*, p.item_rid from {loss_samples} s left join (select sample_id, count(*) as n from {negative_draws} group by sample_id) c on s.sample_id = c.sample_id
              cross join {negative_pool} p where coalesce(c.n, 0) < 20 and p.item_rid <> s.target_item_rid) d
        where not exists (select 1 from {interactions} e where e.user_id = d.user_id and e.item_rid = d.item_rid and e.pos < d.history_end_position)
          and not exists (select 1 from {negative_draws} k where k.sample_id = d.sample_id and k.item_rid = d.item_rid)""",
    # the same in two shuffles: draws meet the pool by number, then their user's history by user, where the rest is made
    "drawn_items": """
        select x.user_id, x.sample_id, x.history_end_position, p.item_rid, x.draw from {draw_numbers} x join {negative_pool} p on x.number = p.number where p.item_rid <> x.target_item_rid""",
    "negative_top": """
        select user_id, sample_id, item_rid, draw, n, place from (
            select *, count(*) over (partition by user_id, sample_id) as n, row_number() over (partition by user_id, sample_id order by draw) as place from (
                select user_id, sample_id, item_rid, cast(min(draw) as bigint) as draw from (
                    select *, min(pos) over (partition by user_id, item_rid) as first_pos from (
                        select /*+ repartition(user_id) */ * from (
                            select user_id, item_rid, sample_id, history_end_position, draw, cast(null as bigint) as pos from {drawn_items}
                            union all select user_id, item_rid, null, null, null, pos from {interactions}) u) h) k
                where sample_id is not null and (first_pos is null or first_pos >= history_end_position) group by user_id, sample_id, item_rid) d) r
        where place <= 20""",
    "short_samples": """
        select s.* from {loss_samples} s left join (select sample_id, n from {negative_top} where place = 1) c on s.sample_id = c.sample_id where coalesce(c.n, 0) < 20""",
    "short_redraws": """
        select d.sample_id, d.item_rid, cast(41 as bigint) as draw
        from (select s.*, p.item_rid from {short_samples} s cross join {negative_pool} p where p.item_rid <> s.target_item_rid) d
        where not exists (select 1 from {interactions} e where e.user_id = d.user_id and e.item_rid = d.item_rid and e.pos < d.history_end_position)
          and not exists (select 1 from {negative_top} k where k.n < 20 and k.sample_id = d.sample_id and k.item_rid = d.item_rid)""",
    "negative_samples": Operator(
        """
        select sample_id, item_rid as negative_item_rid, cast(place as bigint) as place from {negative_top} where n >= 20
        union all
        select sample_id, negative_item_rid, case when n >= 20 then place else cast(raise_error(concat('not enough eligible negatives: sample ', sample_id)) as bigint) end as place from (
            select s.sample_id, x.item_rid as negative_item_rid, count(x.item_rid) over (partition by s.sample_id) as n,
                   cast(row_number() over (partition by s.sample_id order by x.draw, @md5(s.sample_id * 1000003 + x.item_rid), x.item_rid) as bigint) as place
            from {short_samples} s left join (select sample_id, item_rid, draw from {negative_top} where n < 20 union all select * from {short_redraws}) x on s.sample_id = x.sample_id) y
        where place <= 20""",
        """
        select sample_id, negative_item_rid, case when n >= 20 then place else cast(@raise(concat('not enough eligible negatives: sample ', sample_id)) as bigint) end as place from (
            select s.sample_id, x.item_rid as negative_item_rid, count(x.item_rid) over (partition by s.sample_id) as n,
                   cast(row_number() over (partition by s.sample_id order by x.draw, @md5(s.sample_id * 1000003 + x.item_rid), x.item_rid) as bigint) as place
            from {loss_samples} s left join (select * from {negative_draws} union all select * from {negative_redraws}) x on s.sample_id = x.sample_id) y where place <= 20""",
        instead=tuple((name, """
        select sample_id, negative_item_rid, case when n >= 20 then place else cast(@raise(concat('not enough eligible negatives: sample ', sample_id)) as bigint) end as place from (
            select s.sample_id, x.item_rid as negative_item_rid, count(x.item_rid) over (partition by s.sample_id) as n,
                   cast(row_number() over (partition by s.sample_id order by x.draw, @md5(s.sample_id * 1000003 + x.item_rid), x.item_rid) as bigint) as place
            from {loss_samples} s left join (select * from {negative_draws} union all select * from {negative_redraws}) x on s.sample_id = x.sample_id) y where place <= 20""") for name in ("negative_draws", "negative_redraws")),
    ),
    # histories pooled as in history_dims, for all samples; who has no vector has a zero one, as padding has
    "loss_dims": """
        select s.sample_id, cast(x.d as bigint) as dim, avg(cast(@at(x.emb, x.d) as double)) as value
        from {loss_samples} s join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position
        join (select item_rid, emb, @explode(@range(1, 64)) as d from {vector_rows}) x on e.item_rid = x.item_rid
        group by s.sample_id, x.d""",
    "loss_events": """
        select s.sample_id as query_id, e.emb from {loss_samples} s join {vector_events} e on s.user_id = e.user_id and e.pos < s.history_end_position""",
    "loss_vectors": Operator(
        function=lambda loss_events: _pooled(loss_events).withColumnRenamed("query_id", "sample_id"),
        takes=("loss_events",),
        oracle="""
        select h.sample_id, @map(@pack(dim, unit), x.unit) as vector
        from (select d.sample_id, d.dim, round(d.value / nullif(n.norm, 0), 6) as unit
              from {loss_dims} d join (select sample_id, sqrt(sum(value * value)) as norm from {loss_dims} group by sample_id) n on d.sample_id = n.sample_id) h
        group by h.sample_id""",
        instead=(("loss_dims", """
        select h.sample_id, @map(@pack(dim, unit), x.unit) as vector
        from (select d.sample_id, d.dim, round(d.value / nullif(n.norm, 0), 6) as unit
              from {loss_dims} d join (select sample_id, sqrt(sum(value * value)) as norm from {loss_dims} group by sample_id) n on d.sample_id = n.sample_id) h
        group by h.sample_id"""),),
    ),
    "softmax_scores": """
        select x.query_id, x.item_id, x.positive, coalesce(@dot(q.vector, i.vector), 0.0e0) as score
        from (select s.sample_id as query_id, s.target_item_rid as item_id, true as positive from {loss_samples} s join {item_train_counts} t on s.target_item_rid = t.item_rid
              union all select sample_id, negative_item_rid, false from {negative_samples}) x
        left join {loss_vectors} q on x.query_id = q.sample_id left join {index_vectors} i on x.item_id = i.item_id""",
    # items first, few of which have vectors; then all of a sample is in one place
    "sample_losses": """
        select x.query_id, max(case when x.positive then x.item_id end) as item_id, max(case when x.positive then x.score end) as score, sum(case when not x.positive then exp(x.score) end) as negatives
        from (select v.query_id, v.item_id, v.positive, coalesce(@dot(q.vector, v.vector), 0.0e0) as score
              from (select p.*, i.vector from (select s.sample_id as query_id, s.target_item_rid as item_id, true as positive from {loss_samples} s join {item_train_counts} t on s.target_item_rid = t.item_rid
                    union all select sample_id, negative_item_rid, false from {negative_samples}) p left join {index_vectors} i on p.item_id = i.item_id) v
              left join {loss_vectors} q on v.query_id = q.sample_id) x
        group by x.query_id""",
    "softmax_loss": Operator(
        """
        select query_id, item_id, round(ln(exp(score) + negatives) - score, 6) as loss from {sample_losses} where item_id is not null and negatives is not null""",
        """
        select s.query_id, s.item_id, round(ln(exp(s.score) + n.negatives) - s.score, 6) as loss
        from {softmax_scores} s join (select query_id, sum(exp(score)) as negatives from {softmax_scores} where not positive group by query_id) n on s.query_id = n.query_id where s.positive""",
        instead=(("softmax_scores", """
        select s.query_id, s.item_id, round(ln(exp(s.score) + n.negatives) - s.score, 6) as loss
        from {softmax_scores} s join (select query_id, sum(exp(score)) as negatives from {softmax_scores} where not positive group by query_id) n on s.query_id = n.query_id where s.positive"""),),
    ),
    "two_tower_batches": """
        select s.sample_id, s.target_item_rid, t.item_token as target_token, count(h.item_token) as token_count, cast(coalesce(sum(h.item_token), 0) as bigint) as token_checksum
        from {val_samples} s join {item_tokens} t on s.target_item_rid = t.item_rid cross join {batch_limits} l
        left join {interactions} e on s.user_id = e.user_id and e.pos < s.history_end_position and (l.max_history is null or s.history_end_position - e.pos <= l.max_history)
        left join (select item_rid, item_token from {item_tokens} where item_token > 1) h on e.item_rid = h.item_rid
        group by s.sample_id, s.target_item_rid, t.item_token""",
    # early stopping replayed over a loss per day: stop after 3 adjacent improvements below min_delta in a row
    "epoch_losses": "select cast(row_number() over (order by day_index) as bigint) as epoch, round(1 - unseen_ratio, 6) as loss from {drift_days}",
    "early_stopping_replay": """
        select epoch, loss, improvement, cast(fails as bigint) as fails, epoch <= stop_epoch as executed from (
            select *, coalesce(min(case when fails >= 3 then epoch end) over (), max(epoch) over ()) as stop_epoch from (
                select *, sum(bad) over (partition by streak order by epoch) as fails from (
                    select *, cast(coalesce(sum(1 - bad) over (order by epoch), 0) as bigint) as streak from (
                        select epoch, loss, round(previous - loss, 6) as improvement, cast(case when previous - loss < 0.0001e0 then 1 else 0 end as bigint) as bad
                        from (select *, lag(loss) over (order by epoch) as previous from {epoch_losses}) a) b) c) d) e""",
}
