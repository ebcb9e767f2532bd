"""DuckDB SQL of the registered queries: one chain of common table expressions, recursions for the folds, and a select for each key."""

CHAIN = r"""
with recursive e as (
  select user_id as match_id, epoch_us(ts) - 1704067200000000 as us, event_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events),
n as (select *, sum(case when event_type <> 'view' then 1 else 0 end) over (partition by match_id order by us, event_id rows between unbounded preceding and current row) as n from e),
i as (select *, case when n > 30 then 2 else 1 end as innings, case when n > 30 then n - 30 else n end as m from n where n > 0),
c as (select match_id, innings, us, event_id, k, event_type, value, m, cast(floor((m - 1) / 6) as int) as over_number, cast((m - 1) % 6 as int) as ball_in_over,
    cast(sum(case event_type when 'click' then 1 when 'signup' then 4 when 'purchase' then 6 else 0 end) over w as int) as runs,
    cast(sum(case event_type when 'error' then 1 else 0 end) over w as int) as wickets
  from i window w as (partition by match_id, innings order by us, event_id rows between unbounded preceding and current row)),
readings as (select match_id, innings, (us + s * 500) / 1e6::double as timestamp_seconds, event_id * 10 + s as reading_id, over_number, ball_in_over,
    runs + case when k % 9 = 4 and s = 3 then 1000 when k = 41 then 400 else 0 end as runs, wickets, 'P' || cast(m % 11 as int) as batter,
    k::double / 100 as ocr_confidence, case when k % 10 = s then 0.0::double else 1.0::double end as parse_confidence, k
  from c, (select unnest(range(7)) as s) g where not (match_id % 4 = 1 and over_number = 2)),
gaps as (select * replace (case when k % 11 <> 0 then runs end as runs) from readings),
neighbours as (select *, (ocr_confidence = 0 or parse_confidence = 0) as unus, row(over_number, ball_in_over, runs, wickets) as core from gaps),
lagged as (select *, lag(core, 1) over w as b1, lag(core, 2) over w as b2, lead(core, 1) over w as a1, lead(core, 2) over w as a2,
    lag(1, 2) over w as hb, lead(1, 2) over w as ha
  from neighbours window w as (partition by match_id, unus order by timestamp_seconds, reading_id)),
resolved as (select *, case when unus then 'unusable'
    when hb = 1 and ha = 1 and b1 is not distinct from b2 and b1 is not distinct from a1 and b1 is not distinct from a2 and core is distinct from b1 then 'outlier' else 'passed' end as resolution from lagged),
held as (select *, last_value(case when resolution = 'passed' and runs is not null then reading_id end ignore nulls) over
    (partition by match_id order by timestamp_seconds, reading_id rows between unbounded preceding and current row) as held_id from resolved),
cleaned as (select h.match_id, h.innings, h.timestamp_seconds, h.reading_id, h.resolution,
    case when h.resolution = 'passed' then h.over_number else g.over_number end as over_number, case when h.resolution = 'passed' then h.ball_in_over else g.ball_in_over end as ball_in_over,
    case when h.resolution = 'passed' then h.runs else g.runs end as runs, case when h.resolution = 'passed' then h.wickets else g.wickets end as wickets,
    case when h.resolution = 'passed' then h.batter else g.batter end as batter
  from held h left join gaps g on h.match_id = g.match_id and h.held_id = g.reading_id),
whole as (select * from cleaned where over_number is not null and ball_in_over is not null and runs is not null and wickets is not null),
marked as (select *, case when lag(row(over_number, ball_in_over, runs, wickets)) over w is distinct from row(over_number, ball_in_over, runs, wickets) then 1 else 0 end as changed
  from whole window w as (partition by match_id order by timestamp_seconds, reading_id)),
numbered as (select *, sum(changed) over (partition by match_id order by timestamp_seconds, reading_id rows between unbounded preceding and current row) - 1 as state_id from marked),
runs_t as (select n.match_id, cast(n.state_id as bigint) as state_id, arg_min(n.innings, n.reading_id) as innings, arg_min(n.over_number, n.reading_id) as over_number,
    arg_min(n.ball_in_over, n.reading_id) as ball_in_over, arg_min(n.runs, n.reading_id) as runs, arg_min(n.wickets, n.reading_id) as wickets, arg_min(n.batter, n.reading_id) as batter,
    min(n.timestamp_seconds) as start_seconds, max(n.timestamp_seconds) as end_seconds, count(*) as n_samples, coalesce(avg(g.ocr_confidence), 0.0) as mean_confidence
  from numbered n left join gaps g on n.reading_id = g.reading_id and n.match_id = g.match_id group by n.match_id, n.state_id),
before as (select *, lag(runs) over w as prev_runs, lag(wickets) over w as prev_wickets, lag(over_number) over w as prev_over_number, lag(ball_in_over) over w as prev_ball_in_over,
    lag(batter) over w as prev_batter, lag(start_seconds) over w as prev_start_seconds, lag(state_id) over w as prev_state_id
  from runs_t window w as (partition by match_id, innings order by state_id)),
delta as (select *, runs - prev_runs as runs_delta, wickets - prev_wickets as wickets_delta,
    case when over_number >= prev_over_number and (over_number - prev_over_number) * 6 + ball_in_over - prev_ball_in_over >= 0 then (over_number - prev_over_number) * 6 + ball_in_over - prev_ball_in_over end as balls
  from before where prev_state_id is not null),
pairs as (select *, wickets_delta > (case when balls > 0 then balls else 3 end) or runs_delta > (case when balls > 0 then balls * 11 else 11 end) as anomaly,
    case when wickets_delta = 1 then 'WICKET'
      when ((over_number = prev_over_number and ball_in_over = prev_ball_in_over + 1) or (over_number = prev_over_number + 1 and prev_ball_in_over = 5 and ball_in_over = 0)) and wickets_delta = 0
      then case runs_delta when 4 then 'FOUR' when 6 then 'SIX' end end as event_type from delta),
happened as (select *, cast(null as int) as milestone_value, event_type as kind from pairs where event_type is not null and not anomaly
  union all select *, cast(unnest(range(cast(floor(prev_runs / 50) as int) + 1, cast(floor(runs / 50) as int) + 1)) * 50 as int), 'TEAM_MILESTONE' from pairs where not anomaly),
conf as (select match_id, timestamp_seconds, least(arg_max(ocr_confidence, reading_id), arg_max(parse_confidence, reading_id)) as c from gaps group by all),
found as (select h.match_id, innings, start_seconds as timestamp_seconds, over_number, ball_in_over, kind as event_type, milestone_value,
    innings || ':' || over_number || '.' || ball_in_over || ':' || kind || coalesce(':' || milestone_value, '') as event_key,
    case when kind = 'WICKET' then prev_batter end as player, least(a.c, b.c) as confidence,
    case kind when 'FOUR' then 60 when 'SIX' then 80 when 'WICKET' then 95 else 65 end as importance
  from happened h left join conf a on h.match_id = a.match_id and h.start_seconds = a.timestamp_seconds left join conf b on h.match_id = b.match_id and h.prev_start_seconds = b.timestamp_seconds),
rv as (select match_id, us / 1e6::double as s, us / 1e6::double + value as t, event_id from e where event_type = 'view' and value > 100),
rf as (select *, max(t) over (partition by match_id order by s, t, event_id rows between unbounded preceding and 1 preceding) as f from rv),
ri as (select *, sum(case when f is null or s - f > 0 then 1 else 0 end) over (partition by match_id order by s, t, event_id rows between unbounded preceding and current row) as island from rf),
replays as (select match_id, min(s) as start_seconds, max(t) as end_seconds from ri group by match_id, island),
tagged as (select f.*, coalesce(f.timestamp_seconds <= r.end_seconds, false) as is_replay from found f asof left join replays r on f.match_id = r.match_id and f.timestamp_seconds >= r.start_seconds),
spans as (select match_id, max(timestamp_seconds) + 60.0::double as duration_seconds from tagged group by match_id),
windows as (select t.*, greatest(0.0::double, least(duration_seconds, t.timestamp_seconds - 8.0::double)) as clip_start, greatest(0.0::double, least(duration_seconds, t.timestamp_seconds + 12.0::double)) as clip_end
  from tagged t join spans using (match_id) where not is_replay),
cuts as (select match_id, us / 1e6::double as timestamp_seconds, case when k % 2 = 0 then 'REPLAY_TRANSITION' else 'ORDINARY_CUT' end as boundary_type, k / 100.0::double as confidence, event_id from e where k % 5 = 0),
frontier as (select *, max(clip_end) over (partition by match_id order by clip_start, clip_end, timestamp_seconds, event_key rows between unbounded preceding and 1 preceding) as frontier from windows),
islands as (select *, sum(case when frontier is null or clip_start - frontier > 20000 then 1 else 0 end) over (partition by match_id order by clip_start, clip_end, timestamp_seconds, event_key rows between unbounded preceding and current row) - 1 as island from frontier),
anchored as (select *, first_value(clip_end) over w as anchor_end, row_number() over w as place from islands window w as (partition by match_id, island order by clip_start, clip_end, timestamp_seconds, event_key)),
merged as (select *, case when place = 1 then null when clip_start <= anchor_end then 'OVERLAP' when clip_start - anchor_end <= 20000 then 'GAP_THRESHOLD' else 'CHAIN_MERGE' end as merge_reason from anchored),
clips as (select match_id, cast(island as bigint) as island, string_agg(event_key, '+' order by event_key) as clip_id, min(clip_start) as start_seconds, max(clip_end) as end_seconds, count(*) as n_events, count(*) > 1 as merged, bool_or(is_replay) as is_replay
  from merged group by match_id, island),
frames as (select match_id, row_number() over (partition by match_id order by us, event_id) - 1 as frame_index, us / 1e6::double as timestamp_seconds, k * 0.5::double as score from e),
fw as (select *, (sum(score) over w - score) / 4 as near, count(*) over w as whole from frames window w as (partition by match_id order by frame_index rows between 2 preceding and 2 following)),
found_cuts as (select match_id, frame_index, timestamp_seconds, score from fw where whole = 5 and score >= 8.0 and score >= 1.5::double * near),
after_cut as (select match_id, frame_index, array_agg(score) over (partition by match_id order by frame_index rows between 1 following and 3 following) as after from frames),
points as (select match_id, timestamp_seconds as start_seconds, max(confidence) as boundary_confidence, max_by(boundary_type, (confidence, boundary_type)) filter (confidence is not null) as boundary_type
  from (select match_id, timestamp_seconds, confidence, boundary_type from cuts
    union all select match_id, unnest([0.0::double, d]), null, null from (select match_id, max(us) / 1e6::double + 1.0::double as d from e group by match_id)) group by all),
segs as (select *, lead(start_seconds) over (partition by match_id order by start_seconds) as end_seconds from points),
segments as (select match_id, start_seconds, end_seconds, boundary_confidence, boundary_type, row_number() over (partition by match_id order by start_seconds) - 1 as segment_id from segs where end_seconds > start_seconds),
named as (select *, ['Smith', 'Mary Ann Evans', 'O''Neil', 'van der Berg', 'Al-Amin', 'Q. Idris'] as names from c),
commentary as (select match_id, innings, over_number, ball_in_over, event_id as truth_id, case event_type when 'click' then '1 run to mid off' when 'signup' then 'FOUR, ' || one || ' through covers' when 'purchase' then two || ' hits a SIX over long on'
    else case k % 6 when 0 then 'OUT c ' || one || ' b ' || two when 1 then 'that is OUT! st ' || one || ' b ' || two when 2 then 'OUT, Run Out (' || two || ') by a mile' when 3 then 'OUT LBW b ' || one when 4 then 'OUT hit wicket b ' || two
      else case when k % 4 = 1 then 'OUT, retired' else 'OUT b ' || one end end end as description
  from (select *, names[((k + match_id) % 6 + 1)::int] as one, names[((k + match_id * 3) % 6 + 1)::int] as two from named)
  where event_type in ('signup', 'purchase', 'error', 'click') and k % 7 <> 0),
truth as (select *, case when contains(description, 'SIX') then 'SIX' when contains(description, 'FOUR') then 'FOUR' when regexp_matches(description, '\bOUT\b') then 'WICKET' end as event_type from commentary),
cand as (select t.match_id, t.truth_id, r.reading_id, r.timestamp_seconds, r.ball_in_over - t.ball_in_over as delta,
    case when r.ball_in_over = t.ball_in_over then 0 else 2 end + case when r.parse_confidence = 1.0 then 0 else 1 end as bucket
  from truth t join readings r on t.match_id = r.match_id and t.innings = r.innings and t.over_number = r.over_number where t.event_type is not null and abs(r.ball_in_over - t.ball_in_over) < 8),
ranked as (select *, row_number() over (partition by match_id, truth_id order by bucket, abs(delta), delta, timestamp_seconds, reading_id) - 1 as rank from cand),
seeds as (select match_id, list(row(state_id, runs, wickets, over_number, ball_in_over) order by state_id) as l from runs_t group by match_id),
scan as (select match_id, l, 1 as pos, l[1][1] as state_id, false as anomaly, cast(null as bigint) as prev_state_id, l[1] as base from seeds
  union all
  select match_id, l, pos + 1, x[1], bad, base[1], case when bad then base else x end from (
    select *, x[3] - base[3] > (case when b > 0 then b else 3 end) or x[2] - base[2] > (case when b > 0 then b * 11 else 11 end) as bad from (
      select match_id, l, pos, base, l[pos + 1] as x, case when l[pos + 1][4] >= base[4] and (l[pos + 1][4] - base[4]) * 6 + l[pos + 1][5] - base[5] >= 0 then (l[pos + 1][4] - base[4]) * 6 + l[pos + 1][5] - base[5] end as b
      from scan where pos < len(l)))),
scores as (select match_id, list(score order by frame_index) as l from frames group by match_id),
reuse as (select match_id, l, 1 as pos, 0::bigint as source_frame, l[1] as read from scores
  union all
  select match_id, l, pos + 1, case when same then source_frame else pos end, case when same then read else l[pos + 1] end from (select *, abs(l[pos + 1] - read) <= 10 as same from reuse where pos < len(l))),
videos as (select match_id, count(*) as frame_count from e group by match_id),
log as (select match_id, arg_max(case event_type when 'purchase' then 'COMPLETE' when 'error' then 'NOT_ANALYZED' else 'IN_PROGRESS' end, us) as status from e where event_type in ('purchase', 'error', 'click') group by match_id)
"""

SELECTS = {
    "timeline": "select match_id, innings, timestamp_seconds, reading_id, over_number, ball_in_over, runs, wickets, batter, ocr_confidence, parse_confidence from readings",
    "smooth_outliers": "select match_id, reading_id, resolution from resolved",
    "smooth_hold_forward": "select match_id, reading_id, over_number, ball_in_over, runs, wickets, batter from cleaned",
    "smoothing_stats": "select match_id, resolution, count(*) as n from resolved group by all",
    "state_runs": "select match_id, state_id, innings, over_number, ball_in_over, runs, wickets, batter, start_seconds, end_seconds, n_samples, round(mean_confidence, 6) as mean_confidence from runs_t",
    "ball_delta_rules": "select match_id, state_id, balls, runs_delta, wickets_delta, anomaly, event_type from pairs",
    "anomaly_scan": "select match_id, state_id, anomaly, prev_state_id from scan",
    "milestones": "select match_id, state_id, milestone_value from happened where kind = 'TEAM_MILESTONE'",
    "events_found": "select match_id, innings, timestamp_seconds, event_type, event_key, player, confidence, importance, is_replay from tagged",
    "filter_events": "select match_id, event_key, player, importance from tagged where event_type in ('SIX', 'WICKET') and importance >= 80 and over_number >= 1 and over_number <= 3",
    "events_in_order": "select match_id, event_key, row_number() over (partition by match_id order by timestamp_seconds, event_key) as event_id from tagged",
    "replay_exclusion": "select match_id, event_key from tagged where not is_replay",
    "count_by_type": "select match_id, event_type, count(*) as n, round(avg(confidence), 6) as mean_confidence from tagged group by all",
    "match_summary": "select * from (select match_id, 'readings' as metric, count(*)::double as value from readings group by match_id union all select match_id, 'events', count(*)::double from tagged group by match_id union all select match_id, 'replays', count(*)::double from replays group by match_id union all select match_id, 'events_' || event_type, count(*)::double from tagged group by match_id, event_type union all select match_id, 'confidence_' || event_type, round(avg(confidence), 6) from tagged group by match_id, event_type)",
    "replay_tag": "select match_id, event_key, is_replay from tagged",
    "replay_intervals": "select match_id, start_seconds, end_seconds from replays",
    "scene_cut_snap": "select w.match_id, w.event_key, coalesce(case when w.timestamp_seconds - x.timestamp_seconds <= 10000 then x.timestamp_seconds end, clip_start) as clip_start from windows w asof left join cuts x on w.match_id = x.match_id and w.timestamp_seconds >= x.timestamp_seconds",
    "clip_windows": "select match_id, event_key, clip_start, clip_end from windows",
    "clip_merge": "select match_id, island, clip_id, start_seconds, end_seconds, n_events, merged, is_replay from clips",
    "merge_reasons": "select match_id, event_key, merge_reason from merged",
    "clip_plan_totals": "select match_id, count(*) as n_clips, round(sum(end_seconds - start_seconds), 6) as total_seconds, round(avg(end_seconds - start_seconds), 6) as mean_seconds from clips group by match_id",
    "distinct_sorted_ids": "select match_id, string_agg(distinct event_key, ',' order by event_key) as event_ids from merged group by match_id",
    "adaptive_cuts": "select match_id, frame_index, score from found_cuts",
    "post_cut_class": "select match_id, frame_index, case when hot >= 2 then 'REPLAY_TRANSITION' else 'ORDINARY_CUT' end as boundary_type, case when n = 0 or score <= 0 then 0.5 when hot >= 2 then least(1.0, 0.5 + 0.5 * hot / n) else 0.5 + 0.5 * (1 - hot / n) end as confidence from (select f.match_id, f.frame_index, f.score, coalesce(len(after), 0)::double as n, len(list_filter(coalesce(after, []), lambda x: x >= f.score * 0.25))::double as hot from found_cuts f join after_cut a using (match_id, frame_index))",
    "boundary_numbers": "select match_id, frame_index, row_number() over (partition by match_id order by timestamp_seconds, frame_index) - 1 as boundary_id from found_cuts",
    "candidate_segments": "select match_id, segment_id, start_seconds, end_seconds, boundary_confidence from segments",
    "frame_to_segment": "select f.match_id, f.frame_index, case when f.timestamp_seconds < s.end_seconds then s.segment_id end as segment_id from frames f asof left join segments s on f.match_id = s.match_id and f.timestamp_seconds >= s.start_seconds",
    "classify_delivery": "select match_id, truth_id, event_type from truth where event_type is not null",
    "dismissal": r"select match_id, truth_id, case when regexp_matches(description, '\bc [A-Za-z].* b [A-Za-z]') then 'CAUGHT' when regexp_matches(description, '\bst [A-Za-z].* b [A-Za-z]') then 'STUMPED' when description ilike '%run out (%' then 'RUN_OUT' when regexp_matches(description, '(?i)\blbw\b') then 'LBW' when description ilike '%hit wicket%' then 'HIT_WICKET' when regexp_matches(description, '\bb [A-Za-z]') then 'BOWLED' end as dismissal_type, nullif(coalesce(nullif(regexp_extract(description, '\b(?:c|st) ([A-Za-z].*) b [A-Za-z]', 1), ''), nullif(regexp_extract(description, '(?i)run out \(([^)]*)\)', 1), '')), '') as fielder from truth where event_type = 'WICKET'",
    "candidate_rank": "select match_id, truth_id, reading_id, bucket, rank from ranked",
    "over_range_gate": "select t.match_id, t.truth_id from truth t join (select match_id, innings, max(over_number) as m from readings where ocr_confidence >= 0.5 group by all) r using (match_id, innings) where t.event_type is not null and over_number > m",
    "parsed_tokens": "select match_id, event_id, ['generic', 'club', 'separate'][(match_id % 3 + 1)::int] as layout, runs, wickets, over_number, ball_in_over, ['Khan', 'Brown', 'Iyer', 'Mills'][(k % 4 + 1)::int] as bowler, round((80 + k % 20) / 100.0::double, 6) as token_confidence from c",
    "anomaly_examples": "select match_id, state_id, row_number() over (partition by match_id order by state_id) as place from scan where anomaly qualify place <= 10",
    "state_reduction": "select match_id, n_readings, n_states, round(100.0::double * (1 - n_states / n_readings::double), 6) as reduction from (select match_id, count(*) as n_readings from readings group by 1) join (select match_id, count(*) as n_states from runs_t group by 1) using (match_id)",
    "replay_totals": "select match_id, count(*) as n, round(sum(end_seconds - start_seconds), 6) as total_seconds, round(max(end_seconds - start_seconds), 6) as longest_seconds, 0.9::double as confidence from replays group by match_id",
    "vector_distance": "select a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as distance from (select vec_id, embedding::double[] as v from embeddings) a, (select embedding::double[] as v from embeddings where vec_id = 0) b",
    "frames_at_rate": "select distinct match_id, frame_index from (select match_id, round_even(s * 25, 0)::bigint as frame_index, n from (select match_id, count(*) as n from e group by match_id), (select unnest(range(2000)) / 3.0::double as s) where s < n / 25.0::double) where frame_index < n",
    "frames_at_times": "select distinct match_id, greatest(0, least(round_even((k - 5) / 8.0::double * 25.0::double, 0)::bigint, frame_count - 1)) as frame_index from e join videos using (match_id) where k >= 5 and (k - 5) / 8.0::double <= frame_count / 25.0::double",
    "frames_listed": "select distinct match_id, k - 5 as frame_index, k - 5 between 0 and frame_count - 1 as exists from e join videos using (match_id)",
    "effective_fps": "select match_id, case when max(us) > min(us) then round((count(*) - 1) / (max(us / 1e6::double) - min(us / 1e6::double)), 9) else 25.0::double end as fps from e group by match_id",
    "frame_axis": "select match_id, frame_index, case when score > 10 then score end as score, case when score > 10 then score / 50 else 0.0::double end as ocr_confidence, case when score > 10 then 1.0::double else 0.0::double end as parse_confidence from frames",
    "unchanged_reuse": "select match_id, pos::bigint - 1 as frame_index, source_frame from reuse",
    "input_checks": "select match_id, metric, value from (select match_id, count(*)::double as readings, count(*) filter (timestamp_seconds is null)::double as without_time, count(*) filter (timestamp_seconds <= b)::double as out_of_order, count(*) filter (runs is null)::double as incomplete, count(*) filter (ocr_confidence not between 0 and 1)::double as bad_confidence from (select *, lag(timestamp_seconds) over (partition by match_id order by reading_id) as b from gaps) group by match_id) unpivot (value for metric in (readings, without_time, out_of_order, incomplete, bad_confidence))",
    "boundary_checks": "select match_id, event_id from cuts where confidence * 2 > 1",
    "reading_stats": "select match_id, count(*) as n_readings, 0::bigint as undetectable, count(*) filter (ocr_confidence < 0.5) as low_confidence, count(*) filter (parse_confidence = 0) as rejected, count(*) filter (ocr_confidence = 0 or parse_confidence = 0) as unusable, round(avg(ocr_confidence), 6) as mean_ocr_confidence, round(avg(parse_confidence), 6) as mean_parse_confidence from gaps group by match_id",
    "event_stats": "select match_id, count(*) filter (event_type = 'FOUR') as n_four, count(*) filter (event_type = 'SIX') as n_six, count(*) filter (event_type = 'WICKET') as n_wicket, count(*) filter (event_type = 'TEAM_MILESTONE') as n_team_milestone, count(*) filter (is_replay) as n_replays, round(avg(confidence), 6) as mean_confidence from tagged group by match_id",
    "ocr_quality": "select match_id, case when ocr_confidence >= 0.6 then 'HIGH' when ocr_confidence >= 0.35 then 'MEDIUM' when ocr_confidence >= 0.15 then 'LOW' else 'INSUFFICIENT' end as level, count(*) as n from readings group by all",
    "parse_over_ball": "select match_id, truth_id as delivery_id, over_number, ball_in_over from commentary",
    "analysis_status": "select match_id, status from log",
    "analysis_todo": "select match_id from videos where match_id not in (select match_id from log where status = 'COMPLETE')",
    "clip_of_event": "select t.match_id, t.event_key, w.clip_start from (select distinct match_id, event_key from tagged) t left join (select match_id, event_key, min(clip_start) as clip_start from windows group by all) w using (match_id, event_key)",
    "events_without_clip": "select distinct match_id, event_key from tagged t where not exists (select 1 from windows w where w.match_id = t.match_id and w.event_key = t.event_key)",
    "json_props": "select user_id as match_id, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as total from events group by all",
}

#: Folds, each a recursion over the rows of a match in their order, and the select on it.
TAGS = r"""
, tag_rows as (select match_id, list({'id': reading_id, 'r': runs, 'w': wickets, 'o': over_number, 'c': ocr_confidence} order by timestamp_seconds, reading_id) as l from gaps group by match_id),
tag as (select match_id, l, 0 as pos, null::bigint as reading_id, null::varchar as d, 1 as segment, 0 as confirmed, null::int as br, null::int as bw from tag_rows
  union all
  select match_id, l, pos + 1, x.id, d, case when d = 'ACCEPTED' then segment + 1 else segment end,
    case when x.r is null or x.w is null then confirmed when d in ('REJECTED_INSUFFICIENT_PERSISTENCE', 'REJECTED_MAX_SEGMENTS_REACHED') then confirmed + 1 else 0 end,
    case when d in ('ACCEPTED', 'NOT_A_CANDIDATE') and x.r is not null and x.w is not null then x.r else br end,
    case when d in ('ACCEPTED', 'NOT_A_CANDIDATE') and x.r is not null and x.w is not null then x.w else bw end
  from (select *, case when x.r is null or x.w is null or br is null or not (x.r < br and x.w < bw) then 'NOT_A_CANDIDATE'
        when x.r >= 20 or x.w > 2 then 'REJECTED_IMPLAUSIBLE_RESET' when x.o is null or x.o > 1 then 'REJECTED_NO_OVER_BALL_RESET'
        when confirmed + 1 < case when x.c < 0.5 then 4 else 2 end then 'REJECTED_INSUFFICIENT_PERSISTENCE'
        when segment >= 2 then 'REJECTED_MAX_SEGMENTS_REACHED' else 'ACCEPTED' end as d
    from (select * exclude (d), l[pos + 1] as x from tag where pos < len(l))))
"""

VALID = r"""
, valid_rows as (select match_id, list({'id': reading_id, 'r': runs, 'w': wickets, 'o': over_number, 'b': ball_in_over, 'p': batter} order by timestamp_seconds, reading_id) as l from gaps group by match_id),
valid as (select match_id, l, 0 as pos, null::bigint as reading_id, null::varchar as reason, null::int as ar, null::int as aw, null::int as ao, null::int as ab, 1 as segment, null::int as br, null::int as bw from valid_rows
  union all
  select match_id, l, pos + 1, x.id, reason, case when reason is null then coalesce(x.r, ar) else ar end, case when reason is null then coalesce(x.w, aw) else aw end,
    case when reason is null and x.r is not null and x.w is not null then coalesce(x.o, ao) else ao end, case when reason is null and x.r is not null and x.w is not null then coalesce(x.b, ab) else ab end,
    case when seen and d = 'ACCEPTED' then segment + 1 else segment end,
    case when seen and x.r is not null and x.w is not null and d in ('ACCEPTED', 'NOT_A_CANDIDATE') then x.r else br end, case when seen and x.r is not null and x.w is not null and d in ('ACCEPTED', 'NOT_A_CANDIDATE') then x.w else bw end
  from (select *, case branch when 0 then null when 5 then case when d = 'ACCEPTED' then null else 'RUNS_DECREASED' end when 1 then 'PLAYER_PARSE_FAILED' when 2 then 'INVALID_BALL_NUMBER' when 3 then 'WICKETS_DECREASED'
        when 4 then 'INVALID_OVER_SEQUENCE' else 'RUNS_DECREASED' end as reason, branch in (0, 5) as seen
    from (select *, case when x.p is null and x.r is null and x.w is null and x.o is null and x.b is null then 1 when x.b < 0 or x.b > 6 then 2 when x.w < 0 or x.w > 10 then 3 when x.o < 0 or x.o > 50 then 4
          when x.o = ao and x.b = ab and x.r <> ar then 6 when x.r < ar and x.w < aw then 5 when x.r < ar then 6 when x.w < aw then 3 when x.o < ao or (x.o = ao and x.b < ab) then 4 else 0 end as branch,
        case when x.r is null or x.w is null or br is null or not (x.r < br and x.w < bw) then 'NOT_A_CANDIDATE' when x.r >= 20 or x.w > 2 then 'IMPLAUSIBLE' when x.o is null or x.o > 1 then 'NO_OVER_BALL'
          when segment >= 2 then 'TOO_MANY' else 'ACCEPTED' end as d
      from (select * exclude (reason), l[pos + 1] as x from valid where pos < len(l)))))
"""

ACCEPTED = r"""
, acc_rows as (select match_id, list({'id': state_id, 'r': runs, 'w': wickets, 'o': over_number, 'b': ball_in_over, 'p': batter, 's': start_seconds} order by state_id) as l from runs_t group by match_id),
acc as (select match_id, l, 0 as pos, 1 as segment, l[1] as x, null::int as br, null::int as bw, l[1] as base, false as known, false as compared, l[1] as prev from acc_rows
  union all
  select match_id, l, pos + 1, case when d = 'ACCEPTED' then segment + 1 else segment end, x, case when d in ('ACCEPTED', 'NOT_A_CANDIDATE') then x.r else br end, case when d in ('ACCEPTED', 'NOT_A_CANDIDATE') then x.w else bw end,
    case when d in ('ACCEPTED', 'NOT_A_CANDIDATE') then x else base end, true, known and d = 'NOT_A_CANDIDATE', base
  from (select *, case when bad then 'ANOMALY' when br is null or not (x.r < br and x.w < bw) then 'NOT_A_CANDIDATE' when x.r >= 20 or x.w > 2 then 'IMPLAUSIBLE' when x.o > 1 then 'NO_OVER_BALL' when segment >= 2 then 'TOO_MANY' else 'ACCEPTED' end as d
    from (select *, known and (x.w - base.w > (case when balls > 0 then balls else 3 end) or x.r - base.r > (case when balls > 0 then balls * 11 else 11 end)) as bad
      from (select * exclude (x), l[pos + 1] as x, case when l[pos + 1].o >= base.o and (l[pos + 1].o - base.o) * 6 + l[pos + 1].b - base.b >= 0 then (l[pos + 1].o - base.o) * 6 + l[pos + 1].b - base.b end as balls
        from acc where pos < len(l))))),
acc_kind as (select *, case when x.w - prev.w = 1 then 'WICKET' when ((x.o = prev.o and x.b = prev.b + 1) or (x.o = prev.o + 1 and prev.b = 5 and x.b = 0)) and x.w = prev.w then case x.r - prev.r when 4 then 'FOUR' when 6 then 'SIX' end end as own
  from acc where compared),
acc_all as (select *, own as kind, null::int as milestone_value from acc_kind where own is not null
  union all select *, 'TEAM_MILESTONE', cast(unnest(range(cast(floor(prev.r / 50) as int) + 1, cast(floor(x.r / 50) as int) + 1)) * 50 as int) from acc_kind),
acc_found as (select h.match_id, segment as innings, x.s as timestamp_seconds, x.o as over_number, x.b as ball_in_over, kind as event_type, milestone_value,
    segment || ':' || x.o || '.' || x.b || ':' || kind || coalesce(':' || milestone_value, '') as event_key, case when kind = 'WICKET' then prev.p end as player, null::varchar as team, least(a.c, b.c) as confidence,
    case kind when 'FOUR' then 60 when 'SIX' then 80 when 'WICKET' then 95 else 65 end as importance
  from acc_all h left join conf a on h.match_id = a.match_id and h.x.s = a.timestamp_seconds left join conf b on h.match_id = b.match_id and h.prev.s = b.timestamp_seconds)
"""

SUPPRESSED = r"""
, sup_rows as (select match_id, list({'f': frame_index, 't': timestamp_seconds, 's': score} order by frame_index) as l from found_cuts group by match_id),
sup as (select match_id, l, 0 as pos, null::bigint as last, false as keep from sup_rows
  union all select match_id, l, pos + 1, case when k then l[pos + 1].f else last end, k from (select *, last is null or l[pos + 1].f > last + 3 as k from sup where pos < len(l)))
"""

REPLAYS = r"""
, seen as (select f.match_id, s.segment_id, count(*) as n, avg(f.score / 50) as logo, avg((f.frame_index * 7) % 10 + 1.0::double) as board, avg(f.score) as motion, avg(f.score * 3 + f.frame_index % 50) as intensity, avg(f.score % 20 + 1.0::double) as contrast
  from frames f asof join segments s on f.match_id = s.match_id and f.timestamp_seconds >= s.start_seconds where f.timestamp_seconds < s.end_seconds group by all),
evidence as (select s.*, coalesce(n, 0) as n, logo, board, motion, intensity, contrast, coalesce(max(case when n > 0 then s.segment_id end) over (partition by s.match_id), 0) as last from segments s left join seen using (match_id, segment_id)),
score_rows as (select match_id, list({'id': segment_id, 's': start_seconds, 't': end_seconds, 'bc': boundary_confidence, 'bt': boundary_type, 'n': n, 'logo': logo, 'board': board, 'motion': motion, 'i': intensity, 'c': contrast} order by segment_id) as l
  from evidence where segment_id <= last group by match_id),
scored as (select match_id, l, 0 as pos, 0 as n, 0.0::double as sb, 0.0::double as sm, 0.0::double as si, 0.0::double as sc, 0.0::double as logo, 0.0::double as board, 0.0::double as motion, 0.0::double as transition, 0.0::double as camera, 0.0::double as total from score_rows
  union all
  select match_id, l, pos + 1, n + feed, sb + case when feed = 1 then x.board else 0 end, sm + case when feed = 1 then x.motion else 0 end, si + case when feed = 1 then x.i else 0 end, sc + case when feed = 1 then x.c else 0 end, logo, board, motion, transition, camera, total
  from (select *, case when total < 0.5 and x.n > 0 then 1 else 0 end as feed from (select *, greatest(0.0::double, least(1.0::double, 0.15 * logo + 0.25 * board + 0.25 * motion + 0.2 * transition + 0.15 * camera)) as total
    from (select match_id, l, pos, n, sb, sm, si, sc, x, case when x.n > 0 then x.logo else 0.0::double end as logo, case when x.bt = 'REPLAY_TRANSITION' then x.bc else 0.0::double end as transition,
        case when x.n = 0 or n < 3 then 0.5::double when sb <= 0 then 0.0::double else greatest(0.0::double, least(1.0::double, (sb / n - x.board) / (sb / n))) end as board,
        case when x.n = 0 or n < 3 then 0.5::double when sm <= 0 then 0.0::double else greatest(0.0::double, least(1.0::double, (sm / n - x.motion) / (sm / n))) end as motion,
        case when x.n = 0 or n < 3 then 0.5::double else least(1.0::double, sqrt((x.i - si / n) ** 2 + (x.c - sc / n) ** 2) / 40) end as camera
      from (select *, l[pos + 1] as x from scored where pos < len(l)))))),
replay_found as (select match_id, l[pos].id as segment_id, l[pos].s as start_seconds, l[pos].t as end_seconds, logo, board, motion, transition, camera, total, total >= 0.5 and l[pos].t - l[pos].s >= 3 as is_replay from scored where pos > 0)
"""

ANCHORS = r"""
, lots as (select match_id, truth_id, list({'rank': rank, 'exact': bucket = 0, 's': k.timestamp_seconds, 'r': r.runs, 'w': r.wickets, 'c': r.ocr_confidence, 'id': reading_id} order by rank) as cands from ranked k join readings r using (match_id, reading_id) group by all),
walk_rows as (select t.match_id, t.innings, list({'t': t.truth_id, 'o': t.over_number, 'b': t.ball_in_over, 'cands': coalesce(cands, [])} order by t.over_number, t.ball_in_over, t.truth_id) as l from truth t left join lots using (match_id, truth_id) where t.event_type is not null group by all),
walk as (select match_id, innings, l, 0 as pos, false as known, 0 as o, 0 as b, 0.0::double as s, 0 as r, 0 as w, null::double as pace, null::bigint as truth_id, [{'rank': 0::bigint, 'exact': true, 's': 0.0::double, 'r': 0, 'w': 0, 'c': 0.0::double, 'id': 0::bigint, 'ocr': '', 'score': '', 'ord': '', 'pac': '', 'ok': true}][2:] as tried, 0::bigint as hit, null::varchar as tier from walk_rows
  union all
  select match_id, innings, l, pos + 1, known or trust, case when trust then x.o else o end, case when trust then x.b else b end, case when trust then a.s else s end, case when trust then a.r else r end, case when trust then a.w else w end,
    case when trust and known and balls > 0 and a.s > s then (a.s - s) / balls else pace end, x.t, tried, hit, tier
  from (select *, hit > 0 and tier <> 'LOW' as trust from (select *, case when hit = 0 then 'UNRESOLVED' when a.pac = 'SUSPICIOUS' then 'LOW' when a.exact and a.ocr = 'HIGH' then 'HIGH' when a.exact or known then 'MEDIUM' else 'LOW' end as tier
    from (select *, tried[hit] as a from (select *, coalesce(list_position(list_transform(tried, lambda c: c.ok), true), 0)::bigint as hit
      from (select *, list_transform(judged, lambda c: struct_insert(c, ok := c.ocr <> 'INSUFFICIENT' and c.score <> 'INCONSISTENT' and c.ord <> 'VIOLATION')) as tried
        from (select *, list_transform(x.cands, lambda c: struct_insert(c,
            ocr := case when c.c is null then 'UNKNOWN' when c.c >= 0.6 then 'HIGH' when c.c >= 0.35 then 'MEDIUM' when c.c >= 0.15 then 'LOW' else 'INSUFFICIENT' end,
            score := case when not known or c.r is null or c.w is null or r is null or w is null then 'UNKNOWN'
              when c.r - r between 0 and (case when balls > 0 then balls * 11 else 11 end) and c.w - w between 0 and (case when balls > 0 then balls else 3 end) then 'CONSISTENT' else 'INCONSISTENT' end,
            ord := case when known and c.s < s then 'VIOLATION' else 'PRESERVED' end,
            pac := case when known and pace <> 0 and balls > 0 and c.s <> s then case when (c.s - s) / balls / pace between 0.2 and 5 then 'WITHIN_EXPECTED' else 'SUSPICIOUS' end else 'UNKNOWN' end)) as judged
          from (select match_id, innings, l, pos, known, o, b, s, r, w, pace, l[pos + 1] as x, case when (l[pos + 1].o - o) * 6 + l[pos + 1].b - b >= 0 then (l[pos + 1].o - o) * 6 + l[pos + 1].b - b end as balls
            from walk where pos < len(l))))))))),
anchors as (select match_id, innings, truth_id, case when hit > 0 then tried[hit].rank end as rank, case when hit > 0 then tried[hit].id end as reading_id, case when hit > 0 then tried[hit].s end as anchor_seconds, len(tried) as n_candidates, tier,
    tried[greatest(hit, 1)].ocr as ocr_quality, tried[greatest(hit, 1)].score as score_state, tried[greatest(hit, 1)].ord as ordering, tried[greatest(hit, 1)].pac as pacing,
    case when hit > 0 then hit - 1 else len(tried) end as n_rejected, len(list_filter(case when hit > 0 then tried[:hit - 1] else tried end, lambda c: c.ord = 'VIOLATION')) as n_violations,
    case when hit <> 1 and tried[1].ord = 'VIOLATION' then 1 else 0 end as n_prevented, tried[greatest(hit, 1)].c as ocr_value
  from walk where pos > 0)
"""

MATCHES = ANCHORS + r"""
, free_rows as (select match_id, innings, event_type, list({'t': truth_id, 's': anchor_seconds} order by truth_id) as free from anchors join truth using (match_id, innings, truth_id) where anchor_seconds is not null group by all),
take_rows as (select match_id, innings, event_type, list({'k': event_key, 's': timestamp_seconds} order by timestamp_seconds, event_key) as l from tagged where event_type <> 'TEAM_MILESTONE' group by all),
take as (select match_id, innings, event_type, l, free, 0 as pos, null::bigint as truth_id, null::varchar as event_key from free_rows join take_rows using (match_id, innings, event_type)
  union all
  select match_id, innings, event_type, l, case when hit then list_filter(free, lambda f: f.t <> near.t) else free end, pos, case when hit then near.t end, case when hit then l[pos].k end
  from (select * replace (pos + 1 as pos), coalesce(abs(near.s - l[pos + 1].s) <= 120, false) as hit from (select *, free[list_position(far, list_min(far))] as near
    from (select *, list_transform(free, lambda f: abs(f.s - l[pos + 1].s)) as far from take where pos < len(l))))),
aligned as (select t.match_id, t.innings, t.over_number, t.ball_in_over, t.event_type, t.description, t.truth_id, a.* exclude (match_id, innings, truth_id), m.event_key,
    case when m.event_key is not null then 'TRUE_POSITIVE' when n_candidates > 0 then 'RECOVERABLE_MISS' else 'UNRECOVERABLE_MISS' end as outcome,
    m.event_key is null and reading_id is not null and tier in ('HIGH', 'MEDIUM') as recovery_eligible
  from truth t join anchors a using (match_id, truth_id) left join (select match_id, truth_id, event_key from take where truth_id is not null) m using (match_id, truth_id))
"""

ACCURACY = "select match_id, metric, value from (select match_id, total::double as total, tp::double as true_positives, no_signal::double as missed_no_signal, signal::double as missed_with_signal, recall_four, recall_six, recall_wicket, coalesce(n, 0)::double as n_detected, (coalesce(n, 0) - tp)::double as false_positives, coalesce(tp::double / nullif(n, 0), 0.0::double) as precision, (tp + signal)::double / total as success_rate from (select match_id, count(*) as total, count(*) filter (outcome = 'TRUE_POSITIVE') as tp, count(*) filter (outcome = 'UNRECOVERABLE_MISS') as no_signal, count(*) filter (outcome = 'RECOVERABLE_MISS') as signal, " + ", ".join(f"count(*) filter (event_type = '{k}' and outcome = 'TRUE_POSITIVE')::double / nullif(count(*) filter (event_type = '{k}'), 0) as recall_{k.lower()}" for k in ("FOUR", "SIX", "WICKET")) + " from aligned group by match_id) left join (select match_id, count(*) as n from tagged where event_type <> 'TEAM_MILESTONE' group by match_id) using (match_id)) unpivot (value for metric in (total, true_positives, missed_no_signal, missed_with_signal, recall_four, recall_six, recall_wicket, n_detected, false_positives, precision, success_rate))"

MISSES = "select match_id, truth_id, event_type, outcome = 'RECOVERABLE_MISS' as has_signal, row_number() over (partition by match_id order by outcome = 'RECOVERABLE_MISS', innings, over_number, ball_in_over, truth_id) as place from aligned where outcome <> 'TRUE_POSITIVE'"

DOCUMENT = """
select f.match_id, '{"match_id":' || f.match_id || ',"figures":{' || figures || '},"missed_events":[' || coalesce(listed, '') || ']}' as report
from (select match_id, string_agg('"' || metric || '":' || round(value, 6), ',' order by metric) as figures from figures group by match_id) f
left join (select match_id, string_agg('{"place":' || place || ',"truth_id":' || truth_id || ',"event_type":"' || event_type || '","has_signal":' || has_signal || '}', ',' order by place) as listed from misses group by match_id) m using (match_id)
"""

#: Wickets of rows with event_key, each with kind and fielder, and those of each key.
WICKETS = r"""(select *, case when regexp_matches(description, '\bc [A-Za-z].* b [A-Za-z]') then 'CAUGHT' when regexp_matches(description, '\bst [A-Za-z].* b [A-Za-z]') then 'STUMPED' when description ilike '%run out (%' then 'RUN_OUT' when regexp_matches(description, '(?i)\blbw\b') then 'LBW' when description ilike '%hit wicket%' then 'HIT_WICKET' when regexp_matches(description, '\bb [A-Za-z]') then 'BOWLED' end as kind, nullif(coalesce(nullif(regexp_extract(description, '\b(?:c|st) ([A-Za-z].*) b [A-Za-z]', 1), ''), nullif(regexp_extract(description, '(?i)run out \(([^)]*)\)', 1), '')), '') as fielder from {} where event_type = 'WICKET' and event_key is not null)"""
DISMISSALS = "select match_id, event_key, min_by(kind, truth_id) as kind, arg_min_null(fielder, truth_id) as fielder from " + WICKETS + " where kind is not null group by all"

FOLDS = {
    "innings_tags": (TAGS, "select match_id, reading_id, d as decision, segment from tag where pos > 0"),
    "reading_validation": (VALID, "select match_id, reading_id, reason, case when reason is null then 1.0::double else 0.0::double end as parse_confidence from valid where pos > 0"),
    "validation_reasons": (VALID, "select match_id, reason, count(*) as n from valid where pos > 0 group by all"),
    "events_last_accepted": (ACCEPTED, "select f.*, coalesce(f.timestamp_seconds <= r.end_seconds, false) as is_replay from acc_found f asof left join replays r on f.match_id = r.match_id and f.timestamp_seconds >= r.start_seconds"),
    "cut_suppression": (SUPPRESSED, "select match_id, l[pos].f as frame_index, l[pos].t as timestamp_seconds, l[pos].s as score from sup where pos > 0 and keep"),
    "replay_scoring": (REPLAYS, "select match_id, segment_id, start_seconds, end_seconds, is_replay, case when is_replay then row_number() over (partition by match_id, is_replay order by start_seconds, end_seconds) - 1 end as replay_id, round(logo, 9) as logo_score, round(board, 9) as scoreboard_score, round(motion, 9) as motion_score, round(transition, 9) as transition_score, round(camera, 9) as camera_score, round(total, 9) as score from replay_found"),
    "anchor_walk": (ANCHORS, "select * exclude (ocr_value) from anchors"),
    "tier_summary": (ANCHORS, "select match_id, count(*) filter (tier = 'HIGH') as high, count(*) filter (tier = 'MEDIUM') as medium, count(*) filter (tier = 'LOW') as low, count(*) filter (tier = 'UNRESOLVED') as unresolved, sum(n_violations)::bigint as violations, sum(n_prevented)::bigint as prevented from anchors group by match_id"),
    "greedy_match": (MATCHES, "select match_id, truth_id, event_key, outcome, recovery_eligible from aligned"),
    "accuracy_report": (MATCHES, ACCURACY),
    "accuracy_document": (MATCHES + ", figures as (" + ACCURACY + "), misses as (" + MISSES + ")", DOCUMENT),
    "missed_events": (MATCHES, MISSES),
    "recovery_append": (MATCHES, "select match_id, innings, anchor_seconds as timestamp_seconds, over_number, ball_in_over, event_type, innings || ':' || over_number || '.' || ball_in_over || ':' || event_type as event_key, 0.75::double as confidence, null::int as importance, false as is_replay, 'METADATA' as source, innings || ':' || over_number || '.' || ball_in_over || ':' || event_type || ':' || truth_id as metadata_id from aligned where recovery_eligible"),
    "enrichment_update": (MATCHES, "select t.match_id, t.event_key, k.kind as dismissal_type, k.fielder from tagged t join (" + DISMISSALS.format("aligned") + ") k using (match_id, event_key)"),
    "false_positives": (MATCHES, "select match_id, event_key from tagged t where event_type <> 'TEAM_MILESTONE' and not exists (select 1 from aligned a where a.match_id = t.match_id and a.event_key = t.event_key)"),
    "readings_with_innings": (TAGS, "select match_id, reading_id, segment as innings from tag where pos > 0"),
    "replay_outcomes": (REPLAYS, "select match_id, count(*) filter (is_replay) as n_accepted, count(*) filter (not is_replay) as n_rejected, round(avg(total) filter (is_replay), 9) as mean_score, round(max(total) filter (is_replay), 9) as max_score, round(max(end_seconds - start_seconds) filter (is_replay), 9) as longest_seconds, round(coalesce(sum(end_seconds - start_seconds) filter (is_replay), 0.0::double), 9) as total_seconds from replay_found group by match_id"),
    "run_counts": (VALID, "select match_id, 'reason_' || reason as metric, count(*) as n from valid where pos > 0 and reason is not null group by all union all select match_id, 'parser_' || ['generic', 'club', 'separate'][(match_id % 3 + 1)::int], count(*) from c group by all"),
}


LOCK = r"""
, shown as (select match_id, frame_index, case when match_id % 4 = 0 and k % 10 = 9 then 'club' when k % 10 < 6 then case when k % 2 = 0 then 'generic' end else 'generic' end as d, k % 10 >= 6 as scored,
    case when match_id % 4 = 1 and k % 5 = 4 then 'separate' when k % 3 = 0 then 'generic' end as o from (select *, cast(score * 2 as int) as k from frames) where k % 13 <> 0),
lock_rows as (select match_id, list({'f': frame_index, 'd': d, 's': scored, 'o': o} order by frame_index) as l from shown group by match_id),
lock as (select match_id, l, 0 as pos, null::varchar as held, 0 as missed, false as locked, null::varchar as way, null::varchar as layout from lock_rows
  union all
  select match_id, l, pos + 1, case when held is not null then held when own then case seen when 'generic' then 'global' else 'local' end when missed + 1 >= 5 then 'global' end, missed + case when own then 0 else 1 end,
    held is not null, case when held is not null then held when turned then 'local' else 'global' end,
    case when held is not null then case held when 'global' then x.d else x.o end else seen end
  from (select *, coalesce(seen <> 'generic', false) as own from (select *, case when turned then x.o else x.d end as seen
    from (select *, (x.d is null or (x.d = 'generic' and not x.s)) and coalesce(x.o <> 'generic', false) as turned from (select *, l[pos + 1] as x from lock where pos < len(l))))))
"""

REPAIRED = MATCHES + """
, keyed as (select * replace (coalesce(event_key, case when recovery_eligible then innings || ':' || over_number || '.' || ball_in_over || ':' || event_type end) as event_key) from aligned),
kept as (select match_id, event_key, event_type, timestamp_seconds, 'OCR' as source from tagged
  union all select match_id, event_key, event_type, anchor_seconds, 'METADATA' from keyed where recovery_eligible),
details as (""" + DISMISSALS.format("keyed") + ")"

FOLDS |= {
    "stored_events_after_repair": (REPAIRED, "select k.match_id, k.event_key, event_type, timestamp_seconds, source, d.kind as dismissal_type, d.fielder from kept k left join details d on k.match_id = d.match_id and k.event_key = d.event_key"),
    "stored_operations_after_repair": (REPAIRED, "select match_id, event_key || ':' || truth_id as metadata_id, 'RECOVERY' as operation, event_key from keyed where recovery_eligible union all select match_id, innings || ':' || over_number || '.' || ball_in_over || ':' || event_type || ':' || truth_id, 'ENRICHMENT', event_key from " + WICKETS.format("keyed") + " where kind is not null"),
    "constraint_violations": ("", """
select match_id, event_id, unnest(list_filter([
    case when value > 100 then 'confidence is out of range' end, case when k % 6 = 5 then 'event_type is unknown' end, case when k % 13 = 0 then 'event_key is null' end,
    case when k % 17 = 0 then 'timestamp_seconds is null' end, case when k % 19 = 0 then 'is_replay is null' end, case when k % 23 = 0 then 'clip ends before it starts' end,
    case when k % 29 = 0 and k % 17 <> 0 then 'timestamp_seconds is not finite' end, case when k % 7 = 0 then 'source is unknown' end, case when k % 11 = 0 then 'dismissal_type is unknown' end,
    case when count(*) over (partition by match_id, event_id) > 1 then 'match_id, event_id not unique' end], lambda x: x is not null)) as constraint
from (select match_id, value, k, case when k % 5 = 0 then event_id // 16 else event_id + 1000000000 end as event_id from e)"""),
    "anchor_reasons": (ANCHORS, "select match_id, truth_id, tier, 'ocr_quality=' || ocr_quality || coalesce('(' || printf('%.2f', ocr_value) || ')', '') || ' score_state=' || score_state || ' ordering=' || ordering || ' neighbor_pacing=' || pacing as reason from anchors"),
    "innings_reasons": (TAGS, "select match_id, reading_id, 'is_decrease=True reset_plausible=' || case when d = 'REJECTED_IMPLAUSIBLE_RESET' then 'False' else 'True' end || ' over_ball_reset=' || case when d in ('REJECTED_IMPLAUSIBLE_RESET', 'REJECTED_NO_OVER_BALL_RESET') then 'False' else 'True' end || ' confirmations=' || case when d in ('REJECTED_IMPLAUSIBLE_RESET', 'REJECTED_NO_OVER_BALL_RESET') then 0 else held + 1 end || '/' || case when c < 0.5 then 4 else 2 end as reason from (select t.*, lag(confirmed) over (partition by t.match_id order by pos) as held, g.ocr_confidence as c from tag t left join gaps g on t.match_id = g.match_id and t.reading_id = g.reading_id) where pos > 0 and d <> 'NOT_A_CANDIDATE'"),
    "strategy_lock": (LOCK, "select match_id, l[pos].f as frame_index, locked, way as strategy, layout from lock where pos > 0"),
    "stream_late_cuts": (SUPPRESSED, "select match_id, frame_index, l[pos].t as timestamp_seconds, boundary_type, confidence from (select *, l[pos].f as frame_index from sup where pos > 0 and keep) join (" + SELECTS["post_cut_class"] + ") using (match_id, frame_index)"),
    "stream_innings_tags": FOLDS["innings_tags"],
    "stream_reading_validation": FOLDS["reading_validation"],
}
SELECTS |= {
    "stream_smooth_outliers": SELECTS["smooth_outliers"],
    "stream_clip_merge": SELECTS["clip_merge"],
    "summary_texts": "select match_id, 'match: ' || match_id || chr(10) || string_agg(replace(metric, '_', ' ') || ': ' || value::bigint, chr(10) order by metric) as summary from (" + SELECTS["match_summary"] + ") where metric not like 'confidence%' group by match_id",
    "concat_lists": r"select match_id, string_agg('file ''it''\''''s/' || match_id || '-' || island || '.mp4''', chr(10) order by start_seconds) as list from clips group by match_id",
}


def oracle_sql() -> dict[str, str]:
    return {key: CHAIN + select for key, select in SELECTS.items()} | {key: CHAIN + fold + select for key, (fold, select) in FOLDS.items()}
