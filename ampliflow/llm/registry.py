"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import fill_in_middle, leaks, line_templates, main_text, mixing, near_duplicates, neighbours, private_data, quality, repeated_runs, secrets, sharding, token_shards

QUERIES = {
    "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_main_text": main_text.op12_main_text,
    "op13_repeated_runs": repeated_runs.op13_repeated_runs,
    "op1_quality": quality.op1_quality,
    "op2_token_shards": token_shards.op2_token_shards,
    "op3_private_data": private_data.op3_private_data,
    "op4_mix": mixing.op4_mix,
    "op5_line_templates": line_templates.op5_line_templates,
    "op6_leaks": leaks.op6_leaks,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_shards": sharding.op8_shards,
    "op9_secrets": secrets.op9_secrets,
}
SQL = {
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op4_mix": mixing.OP4_SQL,
    "op5_line_templates": line_templates.OP5_SQL,
    "op8_shards": sharding.OP8_SQL,
}
