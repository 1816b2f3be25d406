"""Filters, joins, aggregates, dedup, order, sampling and windows over rollouts, records and analysed videos."""

from __future__ import annotations

from cinderloom.plans.catalog import oracle_text, r9, sql_query

#: Rewards that count: null and NaN are missing.
OK = "ok as (select * from rollouts where reward is not null and not isnan(reward) and uid is not null)"
GROUPS = f"{OK}, grp as (select uid, problem_type, count(*) as n, avg(reward) as mean_reward, min(reward) as lo, max(reward) as hi, stddev_pop(reward) as sd from ok group by uid, problem_type)"
LIVE_E = "ev as (select * from (select *, row_number() over (partition by video_id, lower(trim(id)) order by loaded_at desc, row_id desc) as rn from hier_events where not coalesce(is_deleted, false)) t where rn = 1)"
LIVE_P = "ph as (select * from (select *, row_number() over (partition by video_id, lower(trim(id)) order by loaded_at desc, row_id desc) as rn from phases where not coalesce(is_deleted, false)) t where rn = 1)"
SPANS = "start_time >= 0 and start_time < end_time and not isnan(start_time) and not isnan(end_time)"
#: The same over rows with sound times only; sifted at the scan.
SOUND_E = LIVE_E.replace("ev as", "evs as").replace("where not coalesce(is_deleted, false)", f"where not coalesce(is_deleted, false) and {SPANS}")
SOUND_P = LIVE_P.replace("ph as", "phs as").replace("where not coalesce(is_deleted, false)", f"where not coalesce(is_deleted, false) and {SPANS}")
ORDER_KEY = "md5(concat('s1:', cast(pos as string)))"

TEXT = {
    # filters
    "filter_reason": "select reason, count(*) as n from (select case when text is null or text = '' then 'empty' when length(text) < 80 then 'short' when length(text) > 2000 then 'long' when lang is null then 'no_lang' when clip_key is null then 'no_clip' else 'pass' end as reason from documents) t group by reason",
    "score_rules": "select decision, count(*) as n from (select case when l1 >= 4 and l2 >= 3 then 'keep' when l1 <= 2 or l2 <= 1 then 'reject' else 'review' end as decision from (select cast(regexp_extract(text, 'L1_SCORE: ([0-9])', 1) as int) as l1, cast(regexp_extract(text, 'L2_SCORE: ([0-9])', 1) as int) as l2 from documents where regexp_extract(text, 'L1_SCORE: ([0-9])', 1) <> '' and regexp_extract(text, 'L2_SCORE: ([0-9])', 1) <> '') a) b group by decision",
    "group_having_mean": f"with {GROUPS} select uid, problem_type, n, {r9('mean_reward')} as mean_reward from grp where mean_reward > 0.1e0 and mean_reward < 0.9e0",
    "diversity_range": f"with {OK} select uid, count(distinct {r9('reward')}) as n_distinct, {r9('avg(reward)')} as mean_reward from ok group by uid having count(distinct {r9('reward')}) > 1 and avg(reward) > 0.05e0 and avg(reward) < 0.95e0",
    "hard_cases": f"with {OK} select uid, count(*) as n, cast(sum(case when reward >= 0.5e0 then 1 else 0 end) as bigint) as n_success, {r9('avg(reward)')} as mean_reward from ok group by uid having avg(reward) between 0.2e0 and 0.8e0 and sum(case when reward >= 0.5e0 then 1 else 0 end) >= 1",
    "text_search": "select doc_id, source from documents where lower(concat(coalesce(source, ''), ' ', coalesce(clip_key, ''), ' ', coalesce(text, ''))) like '%garlic%'",
    "timestamp_sanity": "select reason, count(*) as n from (select case when start_time is null or end_time is null then 'null' when isnan(start_time) or isnan(end_time) then 'nan' when start_time < 0 then 'negative' when start_time > end_time then 'swapped' when start_time = end_time then 'zero' else 'ok' end as reason from actions) t group by reason",
    "format_errors": "select error, count(*) as n from (select case when answer is null then 'null_answer' end as error from records union all select case when prompt not like '<video>%' then 'no_video_mark' end from records union all select case when problem_type is null then 'no_type' end from records union all select case when data_type is null then 'no_data_type' end from records) t where error is not null group by error",
    "task_substring": "select problem_type, phase, count(*) as n from rollouts where problem_type like '%logic%' and step >= 1 group by problem_type, phase",
    # joins
    "lookup_left": f"with {LIVE_E} select a.row_id, e.label as event_label, case when e.id is null then 1 else 0 end as is_missing from actions a left join ev e on a.video_id = e.video_id and lower(trim(a.parent_event_id)) = lower(trim(e.id))",
    "lookup_inner": f"with {LIVE_E}, {LIVE_P} select e.row_id, e.label as event_label, p.label as phase_label from ev e join ph p on e.video_id = p.video_id and lower(trim(e.parent_phase_id)) = lower(trim(p.id))",
    # Input minus processed by content: the records, with their place, that no rollout answers.
    "resume_remaining": "select pos from records r where not exists (select 1 from rollouts o where o.prompt is not distinct from r.prompt and o.ground_truth is not distinct from r.answer)",
    "content_semi": "select pos from records r where exists (select 1 from rollouts o where o.prompt = r.prompt and o.ground_truth = r.answer)",
    "blocklist_or_anti": "select doc_id from documents d where not exists (select 1 from annotations a where a.clip_key = d.clip_key) and not exists (select 1 from mix_targets m where m.source = d.source)",
    "containment_check": f"with {SOUND_E}, {LIVE_P} select e.row_id, case when p.id is null then 'missing_parent' when e.start_time < p.start_time or e.end_time > p.end_time then 'outside' else 'inside' end as state from evs e left join ph p on e.video_id = p.video_id and lower(trim(e.parent_phase_id)) = lower(trim(p.id))",
    "taxonomy_lookup": "select d.doc_id, coalesce(a.domain_l2, 'uncategorized') as domain_l2 from documents d left join (select clip_key, max(domain_l2) as domain_l2 from annotations group by clip_key) a on d.clip_key = a.clip_key",
    "conflict_check": "select clip_key, count(*) as n, count(distinct clip_duration_sec) as n_durations, max(case when clip_duration_sec is null then 1 else 0 end) as has_null from annotations group by clip_key having count(*) > 1",
    "id_resolve": "select row_id, regexp_extract(lower(trim(from_id)), '^([a-z]+)[0-9]+$', 1) as kind, cast(nullif(regexp_extract(lower(trim(from_id)), '^[a-z]+([0-9]+)$', 1), '') as bigint) as num from causal_links",
    # aggregates
    "count_by_key": "select problem_type, count(*) as n from rollouts group by problem_type",
    "kept_dropped_rollup": f"with {GROUPS} select problem_type, count(*) as n_groups, cast(sum(case when mean_reward > 0.1e0 and mean_reward < 0.9e0 then 1 else 0 end) as bigint) as n_kept from grp where problem_type is not null group by rollup(problem_type)",
    "ratio_of_total": f"select problem_type, n, {r9('n * 1e0 / sum(n) over ()')} as ratio from (select problem_type, count(*) as n from records group by problem_type) t",
    "group_stats": f"with {GROUPS} select uid, problem_type, n, {r9('mean_reward')} as mean_reward, {r9('lo')} as lo, {r9('hi')} as hi, {r9('sd')} as sd from grp",
    "two_level_mean": f"with {GROUPS} select problem_type, count(*) as n_groups, {r9('avg(mean_reward)')} as mean_of_means, {r9('sum(mean_reward * n) / sum(n)')} as pooled from grp group by problem_type",
    "group_summary": f"with {OK} select problem_type, count(*) as n, count(distinct uid) as n_groups, {r9('avg(reward)')} as mean_reward, {r9('percentile(reward, 0.25)')} as q1, {r9('percentile(reward, 0.75)')} as q3 from ok group by problem_type",
    "threshold_sweep": f"with {GROUPS} select problem_type, cast(floor(least(mean_reward, 0.999999e0) / 0.05e0) as bigint) as k, count(*) as n, cast(sum(count(*)) over (partition by problem_type order by floor(least(mean_reward, 0.999999e0) / 0.05e0) desc) as bigint) as n_at_least from grp group by problem_type, floor(least(mean_reward, 0.999999e0) / 0.05e0)",
    "score_bins_2d": f"with {OK} select problem_type, cast(floor(least(reward, 0.999999e0) / 0.1e0) as bigint) as bin, count(*) as n from ok where reward >= 0 group by problem_type, floor(least(reward, 0.999999e0) / 0.1e0)",
    "buckets": "select case when clip_duration_sec is null then 'none' when clip_duration_sec < 60 then '[0,60)' when clip_duration_sec < 120 then '[60,120)' when clip_duration_sec < 240 then '[120,240)' else '240+' end as bucket, count(*) as n from annotations group by 1",
    "group_quality": f"with {OK} select uid, {r9('avg(reward)')} as mean_reward, {r9('avg(case when reward >= 0.99e0 then 1e0 else 0e0 end)')} as ones, {r9('avg(case when reward <= 0.01e0 then 1e0 else 0e0 end)')} as zeros, {r9('stddev_pop(reward) * (1e0 - 2e0 * abs(avg(reward) - 0.5e0))')} as random_index from ok group by uid",
    "categorise": f"with {GROUPS} select category, count(*) as n from (select case when n < 2 then 'few' when lo >= 0.99e0 then 'solved' when hi <= 0.01e0 then 'failed' when sd >= 0.3e0 then 'mixed' else 'narrow' end as category from grp) t group by category",
    "step_stats": f"with {OK} select step, phase, count(*) as n, {r9('avg(reward)')} as mean_reward from ok group by step, phase",
    "diversity": "select problem_type, count(*) as n_groups, cast(sum(case when u = 1 then 1 else 0 end) as bigint) as n_all_same from (select uid, problem_type, count(distinct lower(trim(response))) as u from rollouts where uid is not null group by uid, problem_type) t group by problem_type",
    "step_purity": f"select step, problem_type, n, {r9('n * 1e0 / total')} as purity from (select step, problem_type, n, sum(n) over (partition by step) as total, row_number() over (partition by step order by n desc, problem_type) as rk from (select step, problem_type, count(*) as n from rollouts where problem_type is not null group by step, problem_type) a) b where rk = 1",
    "reward_curve": f"with {OK} select step, phase, count(*) as n_groups, {r9('avg(m)')} as mean_reward from (select uid, step, phase, avg(reward) as m from ok group by uid, step, phase) t group by step, phase",
    "setting_pivot": f"with {OK} select step, {r9('''avg(case when phase = 'train' then reward end)''')} as train_mean, {r9('''avg(case when phase = 'val' then reward end)''')} as val_mean, cast(sum(case when phase = 'train' then 1 else 0 end) as bigint) as n_train, cast(sum(case when phase = 'val' then 1 else 0 end) as bigint) as n_val from ok group by step",
    "dataset_summary_sets": "select problem_type, data_type, cast(grouping(problem_type) as bigint) as g1, cast(grouping(data_type) as bigint) as g2, count(*) as n from records where problem_type is not null and data_type is not null group by grouping sets ((problem_type), (data_type), ())",
    "field_profile": f"select 'lang' as field, {r9('count(lang) * 1e0 / count(*)')} as present from documents union all select 'clip_key', {r9('count(clip_key) * 1e0 / count(*)')} from documents union all select 'domain_l1', {r9('count(domain_l1) * 1e0 / count(*)')} from documents",
    "best_of_n": f"with {OK} select uid, row_id, {r9('reward')} as reward from (select uid, row_id, reward, row_number() over (partition by uid order by reward desc, row_id) as rk from ok) t where rk = 1",
    "level_rollup": f"with {OK} select problem_type, count(*) as n, {r9('avg(reward)')} as mean_reward, {r9('stddev_pop(reward)')} as sd from ok where problem_type is not null group by rollup(problem_type)",
    "task_means": f"with {OK} select problem_type, phase, {r9('avg(reward)')} as mean_reward, count(*) as n from ok group by problem_type, phase",
    "store_summary": "select count(distinct uid) as n_groups, count(*) as n_samples, count(distinct step) as n_steps from rollouts",
    "domain_cube": "select domain_l1, source, count(*) as n from documents where domain_l1 is not null and source is not null group by cube(domain_l1, source)",
    "planned_vs_actual": f"select coalesce(a.problem_type, b.problem_type) as problem_type, {r9('coalesce(a.share, 0e0)')} as planned, {r9('coalesce(b.share, 0e0)')} as actual from (select problem_type, count(*) * 1e0 / sum(count(*)) over () as share from records where problem_type is not null group by problem_type) a full join (select problem_type, count(*) * 1e0 / sum(count(*)) over () as share from rollouts where problem_type is not null group by problem_type) b on a.problem_type = b.problem_type",
    "length_metrics": f"select problem_type, {r9('avg(response_length)')} as mean_len, max(response_length) as max_len, min(response_length) as min_len, {r9('avg(case when response_length >= 200 then 1e0 else 0e0 end)')} as clip_ratio from rollouts group by problem_type",
    # dedup and sets
    "dedup_first": "select pos from (select pos, row_number() over (partition by prompt, answer, videos order by pos) as rn from records) t where rn = 1",
    "dedup_best": "select doc_id, clip_key from (select doc_id, clip_key, row_number() over (partition by clip_key order by n_chars desc, doc_id) as rn from documents where clip_key is not null) t where rn = 1",
    "dedup_last": "select row_id from (select row_id, row_number() over (partition by video_id, id order by loaded_at desc, row_id desc) as rn from actions) t where rn = 1",
    "dedup_conflicts": "select md5(prompt) as key, count(*) as n, count(distinct answer) as n_answers from records group by md5(prompt) having count(distinct answer) > 1",
    "priority_union": "select problem_type, prompt, answer from (select *, row_number() over (partition by prompt, answer order by prio, k) as rn from (select problem_type, prompt, answer, 0 as prio, pos as k from records union all select problem_type, prompt, ground_truth, 1, row_id from rollouts) u) t where rn = 1",
    "set_difference": "select distinct clip_key from annotations where clip_key is not null except select distinct clip_key from documents where clip_key is not null",
    "set_overlap": "select clip_key from annotations where clip_key is not null intersect select clip_key from documents where clip_key is not null",
    # order
    "page": "select row_id, uid, step from rollouts order by step desc, row_id limit 25 offset 50",
    "best_per_pair": f"with {OK} select problem_id, phase, row_id, {r9('reward')} as reward from (select problem_id, phase, row_id, reward, row_number() over (partition by problem_id, phase order by reward desc, step desc, row_id) as rk from ok where problem_id is not null) t where rk = 1",
    "round_robin_shard": "select pos from records where pos % 8 = 3",
    "stride_steps": "select distinct step from rollouts where step % 10 = 0 or step = (select max(step) from rollouts)",
    # sampling
    "sample_n": f"select pos from records order by {ORDER_KEY}, pos limit 100",
    "cell_cap": "select pos from (select pos, row_number() over (partition by problem_type, data_file order by " + ORDER_KEY + ", pos) as rn from records) t where rn <= 5",
    "batch_plan": "select problem_type, n, cast(greatest(1, least(floor(n / 16e0), floor(total / 16e0 * n / total))) as bigint) as n_batches from (select problem_type, n, sum(n) over () as total from (select problem_type, count(*) as n from records where problem_type is not null group by problem_type) a) b",
    "balance_report": "select shard, count(*) as n, cast(sum(response_length) as bigint) as total_len, max(response_length) as max_len from (select response_length, cast(row_id % 8 as bigint) as shard from rollouts) t group by shard",
    # windows
    "grpo": f"with {OK} select row_id, {r9('(reward - m) / (sd + 1e-6)')} as advantage from (select row_id, reward, avg(reward) over (partition by uid) as m, stddev_samp(reward) over (partition by uid) as sd, count(*) over (partition by uid) as n from ok) t where n > 1",
    "rloo": f"with {OK} select row_id, {r9('reward - (s - reward) / (n - 1)')} as advantage from (select row_id, reward, sum(reward) over (partition by uid) as s, count(*) over (partition by uid) as n from ok) t where n > 1",
    "gap_overlap": f"select video_id, row_id, case when prev is null then 'first' when start_time < prev then 'overlap' when start_time > prev then 'gap' else 'adjacent' end as state from (select video_id, row_id, start_time, lag(end_time) over (partition by video_id order by start_time, end_time, row_id) as prev from actions where not coalesce(is_deleted, false) and {SPANS}) t",
    "rolling_share": f"select step, {r9('''avg(share) over (order by step rows between 4 preceding and current row)''')} as rolling from (select step, avg(case when problem_type = 'llava_mcq' then 1e0 else 0e0 end) as share from rollouts group by step) t",
    "tail_slope": f"with {OK} select problem_type, {r9('max(case when rk_last = 1 then m end) - max(case when rk_first = 1 then m end)')} as delta, {r9('min(m)')} as lo, {r9('max(m)')} as hi from (select problem_type, step, m, row_number() over (partition by problem_type order by step) as rk_first, row_number() over (partition by problem_type order by step desc) as rk_last from (select problem_type, step, avg(reward) as m from ok group by problem_type, step) a) b group by problem_type",
    "renumber": f"select row_id, cast(row_number() over (partition by video_id order by start_time, end_time, row_id) as bigint) as new_id from hier_events where not coalesce(is_deleted, false) and {SPANS}",
    "phase_span": f"select video_id, lower(trim(parent_phase_id)) as phase_id, {r9('min(start_time)')} as s, {r9('max(end_time)')} as e, count(*) as n from hier_events where not coalesce(is_deleted, false) and {SPANS} group by video_id, lower(trim(parent_phase_id))",
    # parsing and scores
    "mmss": "select doc_id, cast(regexp_extract(text, '^.([0-9]+):([0-9]+).', 1) as bigint) * 60 + cast(regexp_extract(text, '^.([0-9]+):([0-9]+).', 2) as bigint) as sec from documents where source = 'stream_chat' and regexp_extract(text, '^.([0-9]+):([0-9]+).', 2) <> ''",
    "path_stem": "select ann_id, regexp_extract(video_path, '([^/]+)[.][a-z0-9]+$', 1) as stem from annotations where video_path is not null",
    "content_hash": "select pos, substring(md5(concat(coalesce(prompt, ''), '|', coalesce(answer, ''))), 1, 12) as h from records",
    "think_split": "select problem_type, cast(sum(case when response like '%<think>%</think>%' then 1 else 0 end) as bigint) as n_thought, count(*) as n from rollouts where response is not null group by problem_type",
}

QUERIES = {name: sql_query(text) for name, text in TEXT.items()}
SQL = {name: oracle_text(text) for name, text in TEXT.items()}
