"""The registered queries of the library, by area; each plays its operators on the given tables."""

from . import chat_plans, example_plans, group_plans, math_plans, metric_plans, ordered_plans, predicate_plans, reward_plans, sample_plans, selection_plans, step_plans, stream_plans, text_plans, token_plans

AREAS = [group_plans, chat_plans, example_plans, math_plans, metric_plans, reward_plans, token_plans, ordered_plans, predicate_plans, sample_plans, selection_plans, step_plans, stream_plans, text_plans]
QUERIES = {k: v for m in AREAS for k, v in m.R.queries.items()}
SQL = {k: v for m in AREAS for k, v in m.R.sql.items()}
