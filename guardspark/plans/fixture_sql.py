"""DuckDB twins of :mod:`guardspark.sources.fixtures` (oracle inputs)."""
from __future__ import annotations

from ..functions.patterns import EVENT_ACTIONS, EVENT_TEXT_CHARS
from ..sources.fixtures import AUDIT_CATEGORIES, AUDIT_TYPE_MAP
from . import sqlgen as S


def _names(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def audit_events_cte(name: str = "audit_events") -> str:
    cats = _names(AUDIT_CATEGORIES)
    etype = ("CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'PROMPT_LEAK_BLOCKED' "
             "ELSE 'INPUT_BLOCKED' END "
             + " ".join(f"WHEN event_type = '{s}' THEN '{d}'" for s, d in AUDIT_TYPE_MAP) + " END")
    action = "CASE " + " ".join(f"WHEN et = '{t}' THEN '{a}'" for t, a in EVENT_ACTIONS) + " ELSE '' END"
    return (f"{name} AS (SELECT event_id, timestamp, et AS event_type, input_text, categories, patterns_matched, "
            f"threat_level, {action} AS action_taken, session_id FROM ("
            f"SELECT event_id, ts AS timestamp, {etype} AS et, "
            f"left('user ' || CAST(user_id AS VARCHAR) || ' ' || props, {EVENT_TEXT_CHARS}) AS input_text, "
            f"CASE WHEN event_id % 7 = 0 THEN []::VARCHAR[] ELSE [{cats}[event_id % 10 + 1], "
            f"{cats}[(event_id + 3) % 10 + 1]] END AS categories, "
            f"CASE WHEN event_id % 14 = 0 THEN [{cats}[event_id % 10 + 1]] ELSE []::VARCHAR[] END "
            f"AS patterns_matched, least(1.0, value / 200.0) AS threat_level, "
            f"CAST(user_id AS VARCHAR) AS session_id FROM events))")


def _arr(phrases) -> str:
    from .sqlgen import lit
    return "[" + ", ".join(lit(p) for p in phrases) + "]"


def _pick(phrases, idx: str) -> str:
    return f"{_arr(phrases)}[({idx}) + 1]"


def canary_token_sql(seed: str, nonce: str) -> str:
    return (f"'CANARY-' || upper(left(sha256('CANARY:' || coalesce({seed}, '') || ':' || "
            f"CAST({nonce} AS VARCHAR)), 20))")


def prompt_ctes() -> list[str]:
    from ..sources.fixtures import (ANSWER_PHRASES, PROMPT_PHRASES, SYSTEM_PHRASES, VERDICT_TEMPLATES)
    h = "(u.conv_id * 31 + u.turn)"
    a = "(conv_id * 17 + turn)"
    v = f"((conv_id * 7 + turn) % {len(VERDICT_TEMPLATES) + 1})"
    ans = _pick(ANSWER_PHRASES, f"{a} % {len(ANSWER_PHRASES)}")
    ans = (f"CASE WHEN {ans} = '{{canary}}' THEN 'Session token ' || {canary_token_sql('query', 'prompt_id')} "
           f"|| ' as asked.' ELSE {ans} END")
    return [
        "turns AS (SELECT c.*, n.role AS next_role, n.text AS next_text FROM conversations c LEFT JOIN conversations n "
        "ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)",
        "sysp AS (SELECT conv_id, arg_min(text, turn) AS _sys FROM turns WHERE role = 'system' GROUP BY conv_id)",
        f"prompts AS (SELECT " + S.pair_id("u.conv_id", "u.turn") + " AS prompt_id, u.conv_id, u.turn, "
        f"CASE WHEN {h} % 4 <> 0 THEN u.text || ' ' || {_pick(PROMPT_PHRASES, f'{h} % {len(PROMPT_PHRASES)}')} "
        f"ELSE u.text END AS query, ((u.conv_id + u.turn) % 5 <> 0) AS guardrails, "
        f"CASE WHEN u.conv_id % 2 = 0 THEN s._sys || ' ' || {_pick(SYSTEM_PHRASES, f'u.conv_id % {len(SYSTEM_PHRASES)}')} "
        f"ELSE s._sys END AS system_prompt, 5 AS top_k, next_role, next_text "
        f"FROM turns u LEFT JOIN sysp s ON u.conv_id = s.conv_id WHERE u.role = 'user')",
        f"answers AS (SELECT prompt_id, CASE WHEN {a} % 4 <> 0 THEN next_text || ' ' || ({ans}) ELSE next_text END "
        f"AS raw_answer FROM prompts WHERE next_role = 'assistant')",
        f"verdicts AS (SELECT prompt_id, {_pick(VERDICT_TEMPLATES, v)} AS raw FROM prompts "
        f"WHERE {v} < {len(VERDICT_TEMPLATES)})",
    ]


def system_turns_cte() -> str:
    from ..sources.fixtures import SYSTEM_PHRASES
    h = "(conv_id * 13 + turn)"
    return (f"system_turns AS (SELECT {S.pair_id('conv_id', 'turn')} AS prompt_id, CASE WHEN {h} % 4 <> 0 THEN text || ' ' || "
            f"{_pick(SYSTEM_PHRASES, f'{h} % {len(SYSTEM_PHRASES)}')} ELSE text END AS system_prompt "
            f"FROM conversations WHERE role = 'system')")


def dirty_texts_cte() -> str:
    from ..sources.fixtures import DIRTY_BLOCKS
    return (f"dirty_texts AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 4 <> 0 THEN text || ' ' || "
            f"{_pick(DIRTY_BLOCKS, f'doc_id % {len(DIRTY_BLOCKS)}')} ELSE text END AS text FROM documents)")
