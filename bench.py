"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from coppice.plans import catalog
from coppice.session import build_session, clear_scratch

HEADLINE = [
    "adv_grpo", "adv_rloo", "adv_gae", "adv_reinforce_pp", "adv_remax", "apply_kl_penalty", "kl_controller", "policy_loss",
    "value_loss", "masked_whiten", "data_metrics", "eos_mask", "position_ids", "token_logprob", "entropy_from_logits",
    "score_boxed", "score_gsm", "score_math", "format_reward", "normalize_math", "simplify_steps",
    "shuffle_rows", "make_batches", "shard_rows", "batch_repeat", "balance_snake", "balance_partitions",
    "filter_prompt_length", "pack_sequences", "rl_batch_left_pad", "content_token_mask", "shape_rl_record", "render_chat",
    "param_parent_join", "hierarchy_rollup", "solve_problems", "render_answer_plain", "render_answer_cot",
    "stream_step_metrics",
]
#: Timed too, but not part of the total: queries that run rounds of jobs.
ITERATIVE = ["topo_levels", "necessary_vs_redundant", "ancestor_closure"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    queries = catalog.queries()
    for name in ("batch_select", "group_stat_join"):  # start the session and compile a first join of aggregates
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    seconds = {}
    for name in only or [*HEADLINE, *ITERATIVE]:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = sum(s for name, s in seconds.items() if name not in ITERATIVE)
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
