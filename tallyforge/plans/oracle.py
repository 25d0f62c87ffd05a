"""The same queries as SQL for DuckDB, over the same whole tables.

Nothing here comes from the library: patterns, tables and rules are written out again, from what the records are to mean.
"""

from __future__ import annotations

#: Fixed values, stated anew: markers of a final number, hedging words, and the rewrites of LaTeX in order.
FINAL_NUMBER = r"####\s*([\-\d,\.]+)"
FINAL_NUMBER_LENIENT = r"####\s*\$?(?:\\boxed\{)?\s*\$?(-?\d[\d,\.]*)"
HEDGES = ["maybe", "perhaps", "possibly", "uncertain", "unsure", "might", "could"]
UNWRAPPED = ["text", "mathrm", "textbf", "mathbf", "displaystyle"]
#: White space of any kind.
_SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEACHER = "(SELECT * REPLACE (lower(trim(benchmark)) AS benchmark) FROM teacher_outputs)"
_BOX = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, {_quoted(f'^{_SPACE}+|{_SPACE}+$')}, '', 'g')"


def _last(text: str, pattern: str) -> str:
    return _strip(f"regexp_extract_all({text}, {_quoted(pattern)}, 1)[-1]")


def _stats(value: str, keep: str, prefix: str) -> str:
    f = f"FILTER (WHERE ({keep}) AND {value} IS NOT NULL AND NOT isnan({value}))"
    at = ", ".join(f"round(quantile_cont({value}, {p}) {f}, 6) AS {prefix}_p{round(p * 100)}" for p in (0.5, 0.95, 0.99))
    return f"count({value}) {f} AS {prefix}_count, round(avg({value}) {f}, 6) AS {prefix}_mean, round(min({value}) {f}, 6) AS {prefix}_min, round(max({value}) {f}, 6) AS {prefix}_max, {at}"


def _sweep(by: str, ok: str) -> str:
    latency = "CASE WHEN NOT isnan(latency_ms) THEN latency_ms END"
    tokens = f"coalesce(sum(output_tokens) FILTER (WHERE {ok}), 0)"
    wall = f"(max(epoch_us(sent_at) / 1e6 + coalesce({latency}, 0) / 1000) - min(epoch_us(sent_at) / 1e6))"
    by_rate = "round(request_rate, 6) AS request_rate"
    return f"""
SELECT {by.replace('request_rate', by_rate)}, count(*) AS total_requests, count(*) FILTER (WHERE {ok}) AS successful_requests, count(*) FILTER (WHERE NOT ({ok})) AS failed_requests,
  {tokens}::BIGINT AS total_output_tokens, round(coalesce({tokens} / nullif(max({latency}) / 1000, 0), 0), 6) AS effective_throughput_tps,
  round(coalesce({tokens} / nullif({wall}, 0), 0), 6) AS wall_throughput_tps, {_stats('latency_ms', ok, 'latency')}, {_stats('ttfb_ms', ok, 'ttfb')}
FROM request_measurement GROUP BY ALL"""


def _parsed(text: str) -> str:
    bare = _strip(f"replace(replace({text}, ',', ''), ' ', '')")
    body = _strip(f"regexp_replace({bare}, '%$', '')")
    number = rf"CASE WHEN regexp_full_match({body}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST({body} AS DOUBLE) END"
    return f"({number} / CASE WHEN {bare} LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END)"


def _close(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {b} = 0 THEN abs({a}) < 1e-6 ELSE abs({a} - {b}) <= 1e-4 * greatest(abs({a}), abs({b})) END, false)"


def _normal_form(text: str) -> str:
    def swap(x: str, old: str, new: str) -> str:
        return f"replace({x}, {_quoted(old)}, {_quoted(new)})"

    def change(x: str, pattern: str, new: str) -> str:
        return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(new)}, 'g')"

    out = _strip(text)
    for name in UNWRAPPED:
        out = change(out, rf"\\{name}\{{([^}}]*)\}}", r"\1")
    for old in ("$", r"\left", r"\right"):
        out = swap(out, old, "")
    out = change(out, r"\\frac\{([^}]*)\}\{([^}]*)\}", r"(\1)/(\2)")
    out = change(out, r"\\sqrt\{([^}]*)\}", r"sqrt(\1)")
    out = change(out, r"\\sqrt\[([^\]]*)\]\{([^}]*)\}", r"(\2)**(1/(\1))")
    out = change(change(out, r"\^\{([^}]*)\}", r"**(\1)"), r"\^(\w)", r"**\1")
    for old, new in ((r"\pi", "pi"), (r"\infty", "oo"), (r"\cdot", "*"), (r"\times", "*")):
        out = swap(out, old, new)
    out = change(change(out, r"\\[a-zA-Z]+", ""), r"\\[,;!: ]", "")
    return _strip(change(out, r"[\s\p{Z}]+", " "))


def _accuracy(source: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""
SELECT {group}count(*) AS total_examples, count(*) FILTER (WHERE scorable) AS scorable_examples, count(*) FILTER (WHERE NOT scorable) AS unscorable_examples,
  count(*) FILTER (WHERE scorable AND correct) AS correct, count(*) FILTER (WHERE scorable AND NOT correct) AS incorrect,
  round(coalesce(count(*) FILTER (WHERE scorable AND correct) / nullif(count(*) FILTER (WHERE scorable), 0), 0), 6) AS accuracy,
  round(coalesce(count(*) FILTER (WHERE scorable AND correct) / nullif(count(*) FILTER (WHERE scorable), 0), 0) * 100, 2) AS accuracy_pct,
  round(count(*) FILTER (WHERE scorable AND correct) / count(*), 6) AS accuracy_all
FROM {source} {f'GROUP BY {by}' if by else ''}"""


_FIRST = r"(?im)(?:(?:the\s+)?answer\s+is\s*[:\-]?\s*\(?([A-D])\)?|\b([A-D])\)\s|^([A-D])$)"
_SHARES = """count(*) AS total, count(*) FILTER (WHERE selected = 'teacher') AS teacher, count(*) FILTER (WHERE selected <> 'teacher') AS student, round(avg(took), 6) AS latency_mean,
  round(quantile_cont(took, 0.5), 6) AS latency_p50, round(quantile_cont(took, 0.95), 6) AS latency_p95, round(quantile_cont(took, 0.99), 6) AS latency_p99"""


def _wording(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array({text}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
    hedges = ", ".join(_quoted(h) for h in HEDGES)
    n = f"len({words})"
    return f"""CASE WHEN coalesce(length({text}), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.85::DOUBLE - 0.5::DOUBLE * len(list_filter({words}, lambda w: lower(w) IN ({hedges}))) / greatest({n}, 1)
      - CASE WHEN {n} < 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)) END"""


_PAIRS = f"""(SELECT t.row_id, s.latency_ms AS s_ms, CASE WHEN s.row_id IS NULL THEN 'no response' ELSE s.error END AS s_error, CASE WHEN s.row_id IS NOT NULL THEN {_wording('s.model_response')} END AS conf,
  CASE WHEN NOT isnan(t.latency_ms) THEN t.latency_ms END AS t_ms FROM teacher_outputs t LEFT JOIN gsm8k_unscorable s USING (row_id))"""
_PER_RUN = """(SELECT r.run_id, r.request_rate, m.model_role, r.latency, r.tokens FROM (SELECT run_id, request_rate, avg(latency_ms) AS latency, sum(output_tokens)::BIGINT AS tokens FROM request_measurement
  WHERE error IS NULL GROUP BY ALL) r JOIN run_meta m USING (run_id))"""
_PLAIN = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _grams(table: str, key: str, text: str, n: int) -> str:
    words = f"list_filter(string_split({_PLAIN.format(text)}, ' '), lambda w: w <> '')"
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= {n})"


def _alone(letters: str) -> str:
    """The last letter that stands alone, upper case; word boundaries are Unicode's, which RE2's ``\\b`` are not."""
    spaced = r"regexp_replace(teacher_completion, '[^\p{L}\p{N}_]', '  ', 'g')"
    return f"upper(regexp_extract_all({spaced}, '(?:^| )([{letters}])(?:$| )', 1)[-1])"


def oracle_sql() -> dict[str, str]:
    boxed = _strip(f"regexp_extract_all(teacher_completion, {_quoted(_BOX)}, 1)[-1]")
    first = "upper(coalesce(" + ", ".join(f"nullif(regexp_extract(teacher_completion, {_quoted(_FIRST)}, {k}), '')" for k in (1, 2, 3)) + "))"
    printed = {
        "completed_requests": ("Successful requests:", "BIGINT"), "total_time_s": ("Benchmark duration (s):", "DOUBLE"), "request_throughput_rps": ("Request throughput (req/s):", "DOUBLE"),
        "input_throughput_tps": ("Input token throughput (tok/s):", "DOUBLE"), "output_throughput_tps": ("Output token throughput (tok/s):", "DOUBLE"),
        "mean_ttft_ms": ("Mean TTFT (ms):", "DOUBLE"), "p99_ttft_ms": ("P99 TTFT (ms):", "DOUBLE"), "mean_tpot_ms": ("Mean TPOT (ms):", "DOUBLE"), "p99_tpot_ms": ("P99 TPOT (ms):", "DOUBLE"),
        "mean_itl_ms": ("Mean ITL (ms):", "DOUBLE"), "p99_itl_ms": ("P99 ITL (ms):", "DOUBLE"), "failed_requests": ("Failed requests:", "BIGINT"), "total_input_tokens": ("Total input tokens:", "BIGINT"),
        "total_generated_tokens": ("Total generated tokens:", "BIGINT"), "peak_output_throughput_tps": ("Peak output token throughput (tok/s):", "DOUBLE"), "peak_concurrent_requests": ("Peak concurrent requests:", "DOUBLE"),
        "total_throughput_tps": ("Total Token throughput (tok/s):", "DOUBLE"), "median_ttft_ms": ("Median TTFT (ms):", "DOUBLE"), "median_tpot_ms": ("Median TPOT (ms):", "DOUBLE"), "median_itl_ms": ("Median ITL (ms):", "DOUBLE"),
    }
    # the n-th line of the built text holds n + the part's size, whole or with a half
    read = {k: f"(p_size + {n}){'' if kind == 'BIGINT' else ' + 0.5::DOUBLE'} AS {k}" for n, (k, (_, kind)) in enumerate(printed.items())}
    logits = ["list_transform(embedding[1:4], lambda x: x::DOUBLE)", "list_transform(embedding[5:8], lambda x: x::DOUBLE)"]
    probs = [f"list_transform({x}, lambda y: exp(y) / list_sum(list_transform({x}, lambda z: exp(z))))" for x in logits]
    entropies = [f"(1 - (-list_sum(list_transform({p}, lambda q: q * ln(q + 1e-12)))) / (ln(4) + 1e-12))" for p in probs]
    scored_run = f"(SELECT run_id, p IS NOT NULL AS scorable, p IS NOT NULL AND {_close(_parsed('p'), _parsed('reference_answer'))} AS correct FROM (SELECT run_id, reference_answer, CASE WHEN error IS NULL THEN {_last('model_response', FINAL_NUMBER_LENIENT)} END AS p FROM gsm8k_unscorable))"
    run_part = [f"nullif(regexp_extract('/results/' || run_id || '/run_meta.json', '/([a-z_]+(?:-gen)?)-(?:([a-z_]+)-)?(\\d{{8}}T\\d{{6}}Z)/', {k}), '')" for k in (1, 2, 3)]
    loss = {k: f"TRY_CAST(regexp_extract(v, '''{k}'': ([-0-9.e+]+)', 1) AS DOUBLE) AS {k}" for k in ("loss", "grad_norm", "learning_rate", "epoch", "train_runtime", "train_samples_per_second", "train_steps_per_second", "train_loss")}
    return {
        "latency_summary": f"SELECT user_id % 5 AS request_rate, count(*) AS total_requests, count(*) FILTER (WHERE event_type <> 'error') AS successful_requests, count(*) FILTER (WHERE event_type = 'error') AS failed_requests, {_stats('value', chr(39).join(['event_type <> ', 'error', '']), 'latency')} FROM events GROUP BY ALL",
        "rate_sweep": _sweep("run_id, request_rate", "error IS NULL"),
        "rate_sweep_strict": _sweep("request_rate", "error IS NULL AND coalesce(status, 0) = 200"),
        "warm_up": "SELECT count(*) FILTER (WHERE request_rate <= 1) AS warm_up, count(*) FILTER (WHERE request_rate <= 1 AND error IS NULL) AS warm_up_ok, count(*) FILTER (WHERE NOT coalesce(request_rate <= 1, false)) AS measured FROM request_measurement",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total_requests, count(*) FILTER (WHERE event_type = 'error') AS failed_requests, round(min(value) FILTER (WHERE event_type <> 'error'), 6) AS latency_min, round(max(value) FILTER (WHERE event_type <> 'error'), 6) AS latency_max, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS latency_mean FROM events GROUP BY 1",
        "event_sessions": "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
        "numeric_last_match": f"SELECT row_id, {_last('teacher_completion', FINAL_NUMBER)} AS answer FROM teacher_outputs",
        "numeric_reference": f"SELECT question, {_strip(f'CASE WHEN regexp_matches(solution, {_quoted(FINAL_NUMBER)}) THEN regexp_extract(solution, {_quoted(FINAL_NUMBER)}, 1) ELSE solution END')} AS reference_answer FROM eval_items",
        "numeric_parse": f"SELECT row_id, round({_parsed(_last('model_response', FINAL_NUMBER_LENIENT))}, 6) AS value, round({_parsed('reference_answer')}, 6) AS reference FROM gsm8k_unscorable",
        "numeric_match": f"SELECT l_linenumber, count(*) FILTER (WHERE {_close('(l_extendedprice * (1 + l_linenumber * 4e-5))', 'l_extendedprice')}) AS matched, count(*) AS total FROM lineitem GROUP BY 1",
        "boxed_answer": f"SELECT row_id, {boxed} AS answer FROM teacher_outputs",
        "latex_normal_form": f"SELECT row_id, {_normal_form('teacher_completion')} AS plain FROM teacher_outputs",
        "math_match": "SELECT p_partkey, p_partkey % 3 = 0 AS matches FROM part",
        "choice_first": f"SELECT row_id, coalesce({first}, {_alone('A-Da-d')}) AS letter FROM teacher_outputs",
        "choice_last": "SELECT row_id, coalesce(upper(regexp_extract_all(teacher_completion, '(?i)(?:answer|option|choice)\\s*(?:is)?\\s*[:(]?\\s*([A-E])', 1)[-1]), " + _alone("A-Ea-e") + ") AS letter FROM teacher_outputs",
        "score_first_choice": f"SELECT benchmark, count(*) AS total, count(letter) AS scorable, count(*) FILTER (WHERE letter = 'B') AS correct FROM (SELECT benchmark, CASE WHEN error IS NULL THEN coalesce({first}, {_alone('A-Da-d')}) END AS letter FROM {TEACHER}) GROUP BY 1",
        "answer_types": "SELECT count(*) FILTER (WHERE regexp_full_match(answer, '[A-Ea-e]')) AS multiple_choice, count(*) FILTER (WHERE NOT regexp_full_match(answer, '[A-Ea-e]')) AS free_text FROM eval_items",
        "score_mixed": f"SELECT CASE WHEN regexp_full_match({_strip('answer')}, '[A-Ea-e]') THEN 'multiple_choice' ELSE 'free_text' END AS answer_type, 'unknown' AS source_dataset, count(*) AS total, count(*) AS scorable, count(*) FILTER (WHERE NOT regexp_full_match({_strip('answer')}, '[A-Ea-e]') OR upper({_strip('answer')}) = 'B') AS correct FROM eval_items WHERE prompt <> '' GROUP BY 1",
        "score_boxed": f"SELECT benchmark, count(*) AS total, count(*) FILTER (WHERE error IS NULL AND b IS NOT NULL) AS scorable, count(*) FILTER (WHERE error IS NULL AND coalesce(CASE WHEN n IS NULL THEN f = '15' ELSE abs(n - 15) <= 1e-4 * greatest(abs(n), 15) END, false)) AS correct, count(*) FILTER (WHERE error IS NULL AND b IS NULL) AS unboxed FROM (SELECT *, {_parsed('f')} AS n FROM (SELECT *, {_normal_form('b')} AS f FROM (SELECT benchmark, error, {boxed} AS b FROM {TEACHER}))) GROUP BY 1",
        "accuracy_by_run": _accuracy(scored_run, "run_id"),
        "accuracy_overall": _accuracy("gsm8k_unscorable"),
        "accuracy_by_category": f"SELECT coalesce(nullif(benchmark, ''), 'arc-challenge') AS category, count(*) FILTER (WHERE finish_reason = 'stop') AS correct, count(*) AS total, round(100 * count(*) FILTER (WHERE finish_reason = 'stop') / count(*), 2) AS accuracy_pct FROM {TEACHER} GROUP BY 1",
        "accuracy_by_source": "SELECT run_id, count(*) FILTER (WHERE teacher_completion IS NOT NULL AND finish_reason = 'stop') AS correct, count(teacher_completion) AS scorable, count(*) AS total, round(coalesce(100 * count(*) FILTER (WHERE teacher_completion IS NOT NULL AND finish_reason = 'stop') / nullif(count(teacher_completion), 0), 0), 2) AS accuracy_pct FROM teacher_outputs GROUP BY 1",
        "runs_rollup": "SELECT kind, model_role, count(*) AS n_runs, sum(gpu_count)::BIGINT AS gpus FROM run_meta GROUP BY ROLLUP (kind, model_role)",
        "prompt_template": "SELECT item_id, 'Solve. Use \\boxed{{}}.' || chr(10) || chr(10) || 'Problem: ' || question || chr(10) AS prompt FROM eval_items",
        "prompt_format": "SELECT item_id, 'Solve. Use \\boxed{}.' || chr(10) || chr(10) || 'Problem: ' || question || chr(10) AS prompt FROM eval_items",
        "prompt_preview": "SELECT row_id, substring(teacher_completion, 1, 120) AS preview FROM teacher_outputs",
        "options_block": "SELECT p_partkey, array_to_string(list_transform(range(1, least(3, len(w)) + 1), lambda i: ['A', 'B', 'C'][i] || ') ' || w[i]), chr(10)) AS options FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)",
        "prompt_union": f"SELECT 'item-' || (row_number() OVER (ORDER BY item_id) - 1) AS id, benchmark, prompt FROM eval_items UNION ALL SELECT 'extra-' || (row_number() OVER (ORDER BY row_id) - 1), benchmark, prompt FROM {TEACHER} WHERE benchmark = 'extra'",
        "mixed_examples": f"SELECT prompt, CASE WHEN regexp_full_match({_strip('answer')}, '[A-Ea-e]') THEN upper({_strip('answer')}) ELSE {_strip('answer')} END AS reference_answer, CASE WHEN regexp_full_match({_strip('answer')}, '[A-Ea-e]') THEN 'multiple_choice' ELSE 'free_text' END AS answer_type, benchmark AS source_dataset FROM eval_items WHERE prompt <> ''",
        "head_examples": "SELECT item_id, benchmark FROM eval_items ORDER BY item_id LIMIT 50",
        "cyclic_prompts": "SELECT i.item_id, count(*) AS n_requests FROM request_measurement r JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM eval_items) i ON r.meas_id % i.n = i.k GROUP BY 1",
        "generation_summary": f"SELECT benchmark, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS ok FROM {TEACHER} GROUP BY 1",
        "trainable_rows": f"SELECT coalesce(benchmark, '?') AS benchmark, count(*) AS valid FROM {TEACHER} WHERE error IS NULL AND teacher_completion <> '' GROUP BY 1",
        "schema_gate": f"SELECT count(*) AS total, count(*) FILTER (WHERE id IS NULL) AS missing_id, count(*) FILTER (WHERE benchmark IS NULL) AS missing_benchmark, count(*) FILTER (WHERE prompt IS NULL) AS missing_prompt, count(*) FILTER (WHERE teacher_completion IS NULL) AS missing_teacher_completion, count(*) FILTER (WHERE error IS NULL AND teacher_completion <> '') AS valid, count(*) FILTER (WHERE error IS NULL AND teacher_completion <> '') >= 50 AS enough FROM {TEACHER}",
        "train_split": "SELECT CASE WHEN CAST('0x' || md5('42-' || id)[1:8] AS BIGINT) % 10000 < 1500 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT id) AS n_ids FROM teacher_outputs GROUP BY 1",
        "label_mask": "SELECT item_id, array_to_string(list_transform(range(1, 49), lambda i: CASE WHEN i <= p OR i > len(w) THEN -100 ELSE length(w[i]) END), ',') AS labels, p >= least(48, len(w)) AS fully_masked FROM (SELECT item_id, string_split(question, ' ') AS w, len(string_split(split_part(question, '.', 1), ' ')) AS p FROM eval_items)",
        "turn_pairs": "SELECT user_id, event_id, prompt, completion FROM (SELECT user_id, event_id, props AS prompt, value < 40 AS u, lead(props) OVER w AS completion, lead(value) OVER w >= 40 AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE u AND a",
        "leakage_exact": f"SELECT doc_id FROM documents WHERE NOT coalesce(lower(source) LIKE 'forum%', false) AND {_PLAIN.format('text')} IN (SELECT {_PLAIN.format('text')} FROM documents WHERE lower(source) LIKE 'forum%' AND {_PLAIN.format('text')} <> '')",
        "leakage_ngrams": f"WITH i AS {_grams('eval_items', 'item_id', 'question', 8)}, d AS {_grams('documents', 'doc_id', 'text', 8)}, n AS (SELECT item_id, count(*) AS n_grams FROM i GROUP BY 1) SELECT doc_id AS doc, item_id AS item, count(*) AS shared, any_value(n_grams)::INTEGER AS n_grams, round(count(*) / any_value(n_grams), 6) AS containment FROM d JOIN i USING (gram) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / any_value(n_grams) >= 0.5",
        "wording_confidence": f"SELECT row_id, round({_wording('teacher_completion')}, 6) AS confidence FROM teacher_outputs",
        "logprob_confidence": f"SELECT vec_id, round((exp(list_max({logits[0]})) + exp(list_max({logits[1]}))) / 2, 6) AS peak, round(({entropies[0]} + {entropies[1]}) / 2, 6) AS certainty FROM embeddings",
        "route_always_teacher": f"SELECT 'always_teacher' AS reason, {_SHARES} FROM (SELECT 'teacher' AS selected, t_ms AS took FROM {_PAIRS})",
        "route_cascading": f"SELECT CASE WHEN selected = 'student' THEN 'student_ok' ELSE 'student_failed_or_slow' END AS reason, {_SHARES} FROM (SELECT selected, CASE selected WHEN 'student' THEN s_ms ELSE t_ms END AS took FROM (SELECT *, CASE WHEN s_error IS NULL AND s_ms <= 2000 THEN 'student' ELSE 'teacher' END AS selected FROM {_PAIRS})) GROUP BY 1",
        "route_confidence": f"SELECT CASE WHEN selected = 'student' THEN 'confident' ELSE 'low_confidence' END AS reason, {_SHARES} FROM (SELECT selected, CASE selected WHEN 'student' THEN s_ms ELSE t_ms + coalesce(s_ms, 0) END AS took FROM (SELECT *, CASE WHEN conf >= 0.7 THEN 'student' ELSE 'teacher' END AS selected FROM {_PAIRS})) GROUP BY 1",
        "route_sweep": f"SELECT round(threshold, 6) AS threshold, count(*) AS total, count(*) FILTER (WHERE conf >= threshold) AS student, round(avg(CASE WHEN conf >= threshold THEN s_ms ELSE t_ms + coalesce(s_ms, 0) END), 6) AS latency_mean FROM {_PAIRS}, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.85::DOUBLE]) AS threshold) GROUP BY threshold",
        "repetitions": f"SELECT model_role, round(request_rate, 4) AS request_rate, count(*) AS reps, round(avg(latency), 4) AS latency_mean, round(stddev_samp(latency), 4) AS latency_sd, round(avg(tokens), 4) AS tokens_mean, round(stddev_samp(tokens), 4) AS tokens_sd FROM {_PER_RUN} GROUP BY model_role, request_rate",
        "speedup": f"WITH r AS (SELECT model_role, request_rate, avg(latency) AS latency FROM {_PER_RUN} GROUP BY ALL) SELECT round(a.request_rate, 4) AS request_rate, a.model_role, round(a.latency, 4) AS latency, round(a.latency / nullif(b.latency, 0), 4) AS ratio, round(a.latency - b.latency, 4) AS difference FROM r a LEFT JOIN r b ON b.model_role = 'teacher' AND a.request_rate = b.request_rate",
        "latest_runs": "SELECT kind, model_role, timestamp_utc, run_id, git_commit FROM run_meta QUALIFY row_number() OVER (PARTITION BY kind, model_role ORDER BY timestamp_utc DESC, run_id DESC, git_commit DESC NULLS LAST) = 1",
        "run_folders": f"SELECT run_id, {run_part[0]} AS kind, {run_part[1]} AS role, strptime({run_part[2]}, '%Y%m%dT%H%M%SZ') AS run_ts, sha256(run_id)[1:12] AS hash FROM run_meta",
        "summary_union": "SELECT run_id, count(*) AS n_requests, NULL::BIGINT AS n_answers FROM request_measurement GROUP BY 1 UNION ALL SELECT run_id, NULL, count(*) FROM teacher_outputs GROUP BY 1",
        "stdout_metrics": f"SELECT p_partkey, {', '.join(f'CASE WHEN p_partkey % 10 > 0 THEN {x.split(chr(32) + "AS" + chr(32))[0]} END AS {k}' for k, x in read.items())} FROM part",
        "training_log": f"SELECT {', '.join(loss.values())} FROM (SELECT unnest(regexp_extract_all(text, '(\\{{''[a-z_]+'':[^{{}}]*\\}})', 1)) AS v FROM documents)",
        "json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "paired_responses": f"SELECT row_id, round(t_ms, 6) AS teacher_latency_ms, round(s_ms, 6) AS student_latency_ms, s_error AS student_error, round(conf, 6) AS student_confidence FROM {_PAIRS}",
        "server_log": "SELECT p_partkey, '03-09 08:52:' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS at, p_retailprice::DOUBLE AS prompt_tps, p_size + 0.5::DOUBLE AS generation_tps, p_size::BIGINT AS running, 0::BIGINT AS waiting, p_size + 0.1::DOUBLE AS cache_usage_pct, 9.0::DOUBLE AS prefix_hit_pct FROM part WHERE p_partkey % 3 <> 0",
        "json_log": "SELECT date_trunc('milliseconds', ts) AS ts, 'INFO' AS level, event_type AS logger, 'done' AS message, user_id AS job_id FROM events WHERE event_id % 5 <> 0",
        "json_result": "SELECT p_size::BIGINT AS completed_requests, p_retailprice::DOUBLE AS total_time_s, 2.5::DOUBLE AS request_throughput_rps, p_partkey::BIGINT AS mean_ttft_ms, p_brand AS backend FROM part",
        "jsonl_records": f"SELECT id, benchmark, prompt FROM {TEACHER}",
        "csv_records": "SELECT run_id, kind, gpu_count FROM run_meta",
        "summary_file": f"SELECT benchmark, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS ok FROM {TEACHER} GROUP BY 1",
        "prompts_strict": "SELECT prompt FROM eval_items",
        "prompts_lenient": "SELECT CASE WHEN item_id % 2 = 0 THEN prompt ELSE trim(regexp_replace(question, '[ \t\n\x0b\f\r]+', ' ', 'g')) END AS prompt FROM eval_items",
        "prompts_extra": "SELECT 'extra-' || n AS id, 'extra' AS benchmark, CASE WHEN item_id % 11 = 0 THEN '' ELSE prompt END AS prompt FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS n FROM eval_items) WHERE item_id % 7 <> 0",
        "scored_files": f"SELECT row_id AS index, p AS predicted_answer, p IS NOT NULL AS scorable, p IS NOT NULL AND {_close(_parsed('p'), _parsed('reference_answer'))} AS correct, file FROM (SELECT row_id, reference_answer, CASE WHEN coalesce(error, '') = '' THEN {_last('model_response', FINAL_NUMBER_LENIENT)} END AS p FROM gsm8k_unscorable), (SELECT unnest(['results', 'unscorable']) AS file) WHERE file = 'results' OR p IS NULL",
        "teacher_files": "SELECT place, teacher_model, count(*) AS n_rows, count(error) AS failed, sum(generation_parameters.max_tokens)::BIGINT AS max_tokens, sum(length(teacher_completion))::BIGINT AS chars FROM teacher_outputs, (SELECT unnest([0, 1]) AS place) GROUP BY 1, 2",
        "run_files": f"SELECT run_id, seed, kind, role, run_ts, run_ts::DATE AS run_day FROM (SELECT run_id, seed, {run_part[0]} AS kind, {run_part[1]} AS role, strptime({run_part[2]}, '%Y%m%dT%H%M%SZ') AS run_ts FROM run_meta)",
        "boxed_examples": f"SELECT problem, level, coalesce(nullif(b, ''), {_strip('solution')}) AS reference_answer, b IS NOT NULL AS reference_is_boxed FROM (SELECT question AS problem, benchmark AS level, solution, {_strip(f'regexp_extract_all(solution, {_quoted(_BOX)}, 1)[-1]')} AS b FROM eval_items)",
        "choice_examples": "SELECT p_partkey::VARCHAR AS id, p_name AS question, array_to_string(list_transform(range(1, len(w) + 1), lambda i: ['A', 'B', 'C', 'D'][i] || ') ' || w[i]), chr(10)) AS options, ['A', 'B', 'C'][p_partkey % 3 + 1] AS reference_answer, p_brand AS category FROM (SELECT *, string_split(p_type, ' ') AS w FROM part)",
        "example_responses": f"""WITH x AS (SELECT benchmark, row_number() OVER (ORDER BY item_id) - 1 AS index, {_strip(f'CASE WHEN regexp_matches(solution, {_quoted(FINAL_NUMBER)}) THEN regexp_extract(solution, {_quoted(FINAL_NUMBER)}, 1) ELSE solution END')} AS ref FROM eval_items),
          r AS (SELECT 'gsm8k' AS benchmark, example_index AS index, CASE WHEN coalesce(error, '') = '' THEN {_last('model_response', FINAL_NUMBER_LENIENT)} END AS p, true AS there FROM gsm8k_unscorable)
          SELECT benchmark, count(*) AS total, count(*) FILTER (WHERE there IS NULL) AS unanswered, count(p) AS scorable, count(*) FILTER (WHERE p IS NOT NULL AND {_close(_parsed('p'), _parsed('ref'))}) AS correct FROM x LEFT JOIN r USING (benchmark, index) GROUP BY 1""",
        "score_reference_not_boxed": f"SELECT CASE WHEN error <> '' THEN 'request_error: ' || error WHEN b IS NULL THEN 'no_boxed_answer_in_response' WHEN row_id % 2 <> 0 THEN 'reference_not_boxed' ELSE 'scored' END AS reason, count(*) AS n FROM (SELECT row_id, error, {boxed} AS b FROM teacher_outputs) GROUP BY 1",
        "role_resolution": "SELECT run_id, model_role, CASE model_role WHEN 'teacher' THEN 'large' WHEN 'student_mid' THEN 'mid' END AS model FROM run_meta",
        "config_merge": """SELECT 7 AS seed, 2.5::DOUBLE AS rate, '3' AS kept, sha256('{"kept": [3], "run": {"rate": 2.5, "seed": 7}}')[1:12] AS config_hash""",
        "run_metadata": """SELECT 42::BIGINT AS seed, sha256('{"a": 1}')[1:12] AS config_hash, true AS gpus_counted, true AS has_packages, true AS has_time, true AS has_host""",
        "latency_summary_approx": "SELECT user_id % 5 AS request_rate, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
        "distinct_users_approx": "SELECT event_type, count(DISTINCT user_id) AS n, true AS within FROM events GROUP BY 1",
    }
