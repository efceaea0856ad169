"""Batch jobs: corpus ingest, guarded and unguarded answering, mode
comparison, layer traces, guard activity and derived security events.

A request of the interactive service is one row here. The guarded job is
staged DataFrames joined by ``prompt_id``:

    prompts -> screen (column expressions)
            -> stored screened rows (read by both branches below)
    blocked:  refusal rows
    allowed:  exact top-k over the chunk table
              -> trust + sanitize per hit (column expressions)
              -> per-prompt window: average trust, cap, running length
              -> left join answers -> canary scan -> output guard
    union of both -> one wide row per prompt, plus ``trace`` and ``logs``

Model answers are an input table; generation happens outside Spark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import vectors as V
from ..functions.regex import sql_lit
from ..operators import output_scan as OS
from ..operators import prompts as PR
from ..operators import retrieval as R
from ..operators import scrub as SC
from ..operators import screen as SCR
from ..session import stored
from ..sources.chunk_table import provenance

STEP_T = "struct<stage:string,layer:string,status:string,score:double,detail:string,category:string>"
LOG_T = "struct<stage:string,action:string,reason:string,threat_level:double,source:string,chunk:bigint>"


def _log(stage, action, reason=None, threat=None, source=None, chunk=None) -> F.Column:
    c = lambda x, t: (x if isinstance(x, F.Column) else F.lit(x)).cast(t)
    return F.struct(c(stage, "string").alias("stage"), c(action, "string").alias("action"),
                    c(reason, "string").alias("reason"), c(threat, "double").alias("threat_level"),
                    c(source, "string").alias("source"), c(chunk, "bigint").alias("chunk"))


def retrieve_for(prompts: DataFrame, chunks: DataFrame, k: int = P.CHAT_TOP_K,
                 threshold: float = P.SIMILARITY_THRESHOLD, embedder=V.HASHED, k_col: str | None = None) -> DataFrame:
    """Hits of each prompt: (prompt_id, id, rank, score, source_file, chunk_index, content),
    and the chunks' ``metadata`` where they have it. ``k_col`` names a column
    with each prompt's own number of hits (null: ``k``); one aggregate finds
    the highest."""
    pv = prompts.select("prompt_id", embedder.column("query").alias("vector"))
    if k_col is not None:
        own = F.greatest(F.coalesce(F.col(k_col).cast("int"), F.lit(k)), F.lit(0))
        k = prompts.agg(F.max(own)).first()[0] or 0
        pv = prompts.select("prompt_id", own.alias("_k"), embedder.column("query").alias("vector"))
    hits = R.cosine_topk(pv, chunks, k=max(k, 1), threshold=threshold, query_id="prompt_id", query_vec="vector",
                         corpus_id="id", corpus_vec="vector", k_col=None if k_col is None else "_k",
                         payload=["source_file", "chunk_index", "content"] + [c for c in ("metadata",) if c in chunks.columns])
    return hits.withColumnRenamed("query_id", "prompt_id")


def guarded_batch(prompts: DataFrame, chunks: DataFrame, answers: DataFrame, verdicts: DataFrame | None = None,
                  judge_enabled: bool = False, k: int = P.CHAT_TOP_K, canary_enabled: bool = True,
                  strict_output: bool = True, embedder=V.HASHED, hits: DataFrame | None = None,
                  k_col: str | None = None, as_of: str | None = None) -> DataFrame:
    """Guarded answering for a prompt table (``prompt_id, query, system_prompt``).

    ``chunks`` needs ``id, source_file, chunk_index, content, vector``; where
    it has ``metadata``, provenance counts towards trust (:func:`provenance`,
    with ``as_of``). ``answers`` holds ``prompt_id, raw_answer``; ``embedder``
    is the one that made the chunks' vectors; ``k_col`` as in
    :func:`retrieve_for`. ``hits``: the prompts' rows of :func:`retrieve_for`,
    where they are known already. One output row per prompt.
    """
    own_k = [] if k_col is None else [k_col]
    screened = SCR.screen_prompts(prompts.select("prompt_id", "query", "system_prompt"), "query", "prompt_id",
                                  verdicts=verdicts, judge_enabled=judge_enabled, embedder=embedder)
    screened = stored(screened.select("prompt_id", "query", "system_prompt", "blocked", "decision", "threat_level",
                                      "reason", "categories", "category_votes", "regex_score", "semantic_score", "input_trace"),
                      "screened")   # read twice and filtered on `blocked`
    allowed = screened.where(~F.col("blocked"))

    # S2-S3: retrieve, then trust on raw text and sanitize per hit.
    asking = allowed if k_col is None else allowed.join(prompts.select("prompt_id", *own_k), "prompt_id")
    hits = (retrieve_for(asking, chunks, k, embedder=embedder, k_col=k_col) if hits is None
            else hits.join(allowed.select("prompt_id"), "prompt_id", "left_semi"))
    if "metadata" in hits.columns:
        hits = provenance(hits, as_of).withColumn("trust_score", SC.trust_score("content", "score", "verified", "fresh"))
    else:
        hits = hits.withColumn("trust_score", SC.trust_score("content", "score"))
    hits = SC.sanitize_text(hits, "content", "sanitized")
    hits = hits.withColumn("was_sanitized", F.col("sanitized") != F.col("content"))

    # S4: trust-capped context; the fit test is monotone, so kept = prefix.
    wp = Window.partitionBy("prompt_id")
    upto = wp.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blk = F.concat(F.lit("[Source: "), F.col("source_file"), F.lit("]\n"), F.col("sanitized"))
    hits = (hits.withColumn("_blk", blk)
                .withColumn("_avg", F.avg("trust_score").over(wp))
                .withColumn("_cap", SC.max_context_length("_avg"))
                .withColumn("_run", F.sum(F.length("_blk")).over(upto))
                .withColumn("in_context", F.col("_run") <= F.col("_cap")))
    per_prompt = (hits.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if("was_sanitized").alias("n_sanitized"),
        F.avg("trust_score").alias("avg_trust"),
        F.count_if("in_context").alias("n_context_chunks"),
        F.array_sort(F.collect_list(F.struct("rank", "_blk", "in_context", "source_file", "chunk_index",
                                             "score", "trust_score", "sanitized", "was_sanitized"))).alias("_hits")))
    per_prompt = per_prompt.select(
        "prompt_id", "n_sources", "n_sanitized", "avg_trust", "n_context_chunks",
        F.array_join(F.transform(F.filter("_hits", lambda h: h["in_context"]), lambda h: h["_blk"]), "\n\n")
         .alias("_ctx"),
        F.transform("_hits", lambda h: F.struct(h["source_file"].alias("file"), h["chunk_index"].alias("chunk"),
                                               h["score"].alias("score"), h["trust_score"].alias("trust_score"),
                                               F.when(F.length(h["sanitized"]) > 200,
                                                      F.concat(F.substring(h["sanitized"], 1, 200), F.lit("...")))
                                                .otherwise(h["sanitized"]).alias("preview"))).alias("sources"),
        F.transform(F.filter("_hits", lambda h: h["was_sanitized"]), lambda h: _log(
            "retrieval", "sanitized", None, None, h["source_file"], h["chunk_index"])).alias("_san_logs"))

    a = allowed.join(per_prompt, "prompt_id", "left").join(answers.select("prompt_id", "raw_answer"), "prompt_id", "left")
    avg = F.coalesce(F.col("avg_trust"), F.lit(0.5))
    n_src = F.coalesce(F.col("n_sources"), F.lit(0))
    n_san = F.coalesce(F.col("n_sanitized"), F.lit(0))
    n_ctx = F.coalesce(F.col("n_context_chunks"), F.lit(0))
    a = a.withColumns({
        "avg_trust": avg, "n_sources": n_src.cast("bigint"), "n_sanitized": n_san.cast("bigint"),
        "n_context_chunks": n_ctx.cast("bigint"), "max_context": SC.max_context_length(avg), "context_limited": n_ctx < n_src,
        "context": F.when(n_ctx > 0, F.col("_ctx")).otherwise(F.lit(P.NO_CONTEXT)),
        "sources": F.coalesce("sources", F.array().cast(
            "array<struct<file:string,chunk:bigint,score:double,trust_score:double,preview:string>>"))})

    # S5: locked prompt, override attempt, canary.
    sp = F.col("system_prompt")
    a = a.withColumns({
        "override_blocked": F.coalesce(sp.isNotNull() & (sp != "") & (sp != F.lit(PR.LOCKED_PROMPT)), F.lit(False)),
        "canary_token": OS.canary_token("query", "prompt_id") if canary_enabled else F.lit(""),
        "full_prompt": PR.fill(PR.GUARDED_TEMPLATE, context="context", query="query")})
    a = a.withColumn("effective_system_prompt",
                     PR.effective_system_prompt(F.lit(True), F.lit(None).cast("string"),
                                                OS.canary_instruction("canary_token") if canary_enabled else None))

    # S6-S8: answer, canary leak, output guard.
    a = OS.canary_scan(a.withColumn("raw_answer", F.coalesce("raw_answer", F.lit(""))), "raw_answer", "canary_token",
                       enabled=canary_enabled)
    a = OS.check_outputs(a.withColumn("_checked_in", F.col("canary_sanitized")), "_checked_in", strict=strict_output)
    leaked = F.col("canary_leaked")
    said = {key: sql_lit(text) for key, text in P.TRACE_TEXTS.items()}

    # Trace and log are SQL text, parsed in one call each.
    def step(stage, layer, status, score, detail):
        return (f"named_struct('stage', '{stage}', 'layer', '{layer}', 'status', {status}, 'score', CAST({score} AS DOUBLE), "
                f"'detail', {detail}, 'category', '')")

    def log(when, stage, action, reason, threat="NULL"):
        return (f"IF({when}, array(CAST(named_struct('stage', '{stage}', 'action', {action}, 'reason', {reason}, 'threat_level', {threat}, "
                f"'source', NULL, 'chunk', NULL) AS {LOG_T})), CAST(array() AS array<{LOG_T}>))")

    issue_cats = "array_join(array_sort(array_distinct(transform(out_issues, i -> i.category))), ', ')"
    off = "skipped" if not canary_enabled else "pass"
    steps = [
        step("retrieval", "Document Sanitizer", "IF(n_sanitized > 0, 'warn', 'pass')",
             "IF(n_sources > 0, bround(n_sanitized / n_sources, 3), 0.0D)",
             f"IF(n_sanitized > 0, format_string({said['sanitized']}, n_sanitized, n_sources), format_string({said['clean']}, n_sources))"),
        step("retrieval", "Trust Scorer", f"IF(avg_trust < {P.TRUST_THRESHOLD!r}D, 'warn', 'pass')", "bround(avg_trust, 3)",
             f"concat(format_string({said['trust']}, avg_trust * 100, max_context), IF(context_limited, {said['truncated']}, ''))"),
        step("prompt", "System Prompt Lock", "IF(override_blocked, 'block', 'pass')", "IF(override_blocked, 1.0D, 0.0D)",
             f"IF(override_blocked, {said['override']}, {said['locked']})"),
        step("output", "Canary Token", f"IF(canary_leaked, 'block', '{off}')", "IF(canary_leaked, 1.0D, 0.0D)",
             f"IF(canary_leaked, {said['leak']}, {said['no_leak'] if canary_enabled else said['canary_off']})"),
        step("output", "Output Guard", "CASE WHEN out_blocked THEN 'block' WHEN out_had_issues THEN 'warn' ELSE 'pass' END",
             "CASE WHEN out_blocked THEN 1.0D WHEN out_had_issues THEN 0.5D ELSE 0.0D END",
             f"IF(out_had_issues, concat(CAST(size(out_issues) AS STRING), {said['issues']}, {issue_cats}), {said['output_clean']})"),
    ]
    # A leak ends the run before the output guard.
    trace = F.expr(f"CAST(concat(input_trace, slice(array({', '.join(steps)}), 1, IF(canary_leaked, 4, 5))) AS array<{STEP_T}>)")
    logs = F.expr("concat(" + ", ".join([
        log("coalesce(decision = 'warn', false)", "input", "'warning'", "array_join(categories, ', ')", "threat_level"),
        f"coalesce(_san_logs, CAST(array() AS array<{LOG_T}>))",
        log("coalesce(context_limited, false)", "retrieval", "'context_limited'", "'trust_score_limit'"),
        log("override_blocked", "prompt", "'override_blocked'", "'system_prompt_locked'"),
        log("canary_leaked OR out_had_issues", "output", "IF(canary_leaked OR out_blocked, 'blocked', 'sanitized')",
            f"IF(canary_leaked, 'system_prompt_leak_detected', {issue_cats})")]) + ")")
    allowed_rows = a.select(
        "prompt_id", "query", "system_prompt", F.lit(True).alias("guardrails_active"),
        leaked.alias("blocked"), "decision",
        F.when(leaked, F.lit(P.LEAK_EVENT_THREAT)).otherwise(F.col("threat_level")).alias("threat_level"),
        F.when(leaked, F.lit(PR.LEAK_REASON)).otherwise(F.lit(None).cast("string")).alias("block_reason"),
        "categories", "n_sources", "n_sanitized", "avg_trust", "max_context", "n_context_chunks", "context_limited",
        "regex_score", "semantic_score", "category_votes", "context", "override_blocked", "canary_leaked", F.col("out_blocked").alias("output_blocked"),
        F.col("out_had_issues").alias("output_had_issues"), "out_issues",
        F.when(leaked, F.lit(PR.REFUSE_LEAK)).when(F.col("out_blocked"), F.lit(PR.REFUSE_OUTPUT))
         .otherwise(F.col("out_sanitized")).alias("answer"),
        F.when(leaked, F.array().cast(
            "array<struct<file:string,chunk:bigint,score:double,trust_score:double,preview:string>>"))
         .otherwise(F.col("sources")).alias("sources"),
        trace.alias("trace"),
        logs.alias("logs"))

    blocked_rows = screened.where(F.col("blocked")).select(
        "prompt_id", "query", "system_prompt", F.lit(True).alias("guardrails_active"), F.lit(True).alias("blocked"), "decision",
        "threat_level", F.col("reason").alias("block_reason"), "categories",
        F.lit(0).cast("bigint").alias("n_sources"), F.lit(0).cast("bigint").alias("n_sanitized"),
        F.lit(None).cast("double").alias("avg_trust"), F.lit(None).cast("int").alias("max_context"),
        F.lit(0).cast("bigint").alias("n_context_chunks"), F.lit(False).alias("context_limited"),
        "regex_score", "semantic_score", "category_votes", F.lit("").alias("context"), F.lit(False).alias("override_blocked"), F.lit(False).alias("canary_leaked"),
        F.lit(False).alias("output_blocked"), F.lit(False).alias("output_had_issues"),
        F.array().cast(f"array<{OS._ISSUE}>").alias("out_issues"),
        F.lit(PR.REFUSE_INPUT).alias("answer"),
        F.array().cast("array<struct<file:string,chunk:bigint,score:double,trust_score:double,preview:string>>")
         .alias("sources"),
        F.col("input_trace").cast(f"array<{STEP_T}>").alias("trace"),
        F.array(_log("input", "blocked", F.col("reason"), F.col("threat_level"))).alias("logs"))
    return allowed_rows.unionByName(blocked_rows)


def unguarded_batch(prompts: DataFrame, chunks: DataFrame, answers: DataFrame, k: int = P.CHAT_TOP_K,
                    embedder=V.HASHED, hits: DataFrame | None = None, k_col: str | None = None) -> DataFrame:
    """No checks: full context and its sources, the caller's (or permissive)
    system prompt, the raw answer."""
    hits = (retrieve_for(prompts, chunks, k, embedder=embedder, k_col=k_col) if hits is None
            else hits.join(prompts.select("prompt_id"), "prompt_id", "left_semi"))
    ctx = R.format_context(hits.withColumnRenamed("prompt_id", "query_id"),
                           prompts.select(F.col("prompt_id").alias("query_id")))
    part = F.struct("rank", F.col("source_file").alias("file"), F.col("chunk_index").alias("chunk"), "score",
                    F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("...")))
                     .otherwise(F.col("content")).alias("preview"))
    n = hits.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_list(part)).alias("_src")) \
            .select("prompt_id", "n_sources", F.transform("_src", lambda h: h.dropFields("rank")).alias("sources"))
    p = (prompts.select("prompt_id", "query", "system_prompt")
                .join(ctx.withColumnRenamed("query_id", "prompt_id"), "prompt_id", "left")
                .join(n, "prompt_id", "left")
                .join(answers.select("prompt_id", "raw_answer"), "prompt_id", "left"))
    return p.select("prompt_id", "query", F.lit(False).alias("guardrails_active"), F.lit(False).alias("blocked"),
                    F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
                    F.coalesce("sources", F.array().cast("array<struct<file:string,chunk:bigint,score:double,preview:string>>"))
                     .alias("unguarded_sources"), "context",
                    PR.effective_system_prompt(F.lit(False), "system_prompt").alias("effective_system_prompt"),
                    PR.fill(PR.UNGUARDED_TEMPLATE, context="context", query="query").alias("full_prompt"),
                    F.coalesce("raw_answer", F.lit("")).alias("answer"))


def route_mode(prompts: DataFrame, chunks: DataFrame, answers: DataFrame, **kw) -> DataFrame:
    """Guarded rows where ``guardrails`` is true, unguarded elsewhere; one
    retrieval serves both."""
    hits = stored(retrieve_for(prompts, chunks, k_col=kw.get("k_col")), "hits")
    g = guarded_batch(prompts.where(F.col("guardrails")), chunks, answers, hits=hits, **kw)
    u = unguarded_batch(prompts.where(~F.col("guardrails")), chunks, answers, hits=hits)
    return g.unionByName(u, allowMissingColumns=True)


def guard_trace(result: DataFrame) -> DataFrame:
    """One row per (prompt, step) of the layer trace."""
    steps = F.transform("trace", lambda t, i: F.struct(i.cast("bigint").alias("step"), t["stage"].alias("stage"),
                                                       t["layer"].alias("layer"), t["status"].alias("status"),
                                                       t["score"].alias("score"), t["detail"].alias("detail")))
    return result.select("prompt_id", F.inline(steps))


def guard_activity(result: DataFrame) -> DataFrame:
    """One row per guard action taken for a prompt."""
    rows = F.transform("logs", lambda x, i: F.struct(i.cast("bigint").alias("seq"), x["stage"].alias("stage"),
                                                     x["action"].alias("action"), x["reason"].alias("reason"),
                                                     x["threat_level"].alias("threat_level"),
                                                     x["source"].alias("source"), x["chunk"].alias("chunk")))
    return result.select("prompt_id", F.inline(rows))


def derive_events(result: DataFrame) -> DataFrame:
    """Security events of a guarded batch, in the audit-log schema (minus
    the wall-clock stamp, which the writer adds)."""
    r = result
    cats = F.col("categories")
    empty = F.array().cast("array<string>")

    issues = F.array_sort(F.array_distinct(F.transform("out_issues", lambda i: i["category"])))

    def more(found=None, scored=False):
        def of(name, kind):
            return (F.col(name) if scored else F.lit(None)).cast(kind).alias(name)
        return ((F.lit(None) if found is None else found).cast("array<string>").alias("issues"), of("regex_score", "double"),
                of("semantic_score", "double"), of("category_votes", "map<string,double>"))

    def ev(etype, text, threat, action, categories=None, reason=None, chunk=None, cond=None, extra=None):
        return F.when(cond, F.array(F.struct(
            F.lit(etype).alias("event_type"), F.substring(text, 1, P.EVENT_TEXT_CHARS).alias("input_text"),
            F.struct((categories if categories is not None else empty).alias("categories"),
                     empty.alias("patterns_matched"), F.lit(reason).cast("string").alias("reason"),
                     F.lit(chunk).cast("bigint").alias("chunk_index"), *(more() if extra is None else extra)).alias("details"),
            threat.cast("double").alias("threat_level"), F.lit(action).alias("action_taken")))) \
            .otherwise(F.array())

    san = F.transform(F.filter("logs", lambda l: (l["stage"] == "retrieval") & (l["action"] == "sanitized")),
                      lambda l: F.struct(F.lit("DOCUMENT_SANITIZED").alias("event_type"),
                                         F.substring(l["source"], 1, P.EVENT_TEXT_CHARS).alias("input_text"),
                                         F.struct(empty.alias("categories"), empty.alias("patterns_matched"),
                                                  F.lit(None).cast("string").alias("reason"),
                                                  l["chunk"].alias("chunk_index"), *more()).alias("details"),
                                         F.lit(0.0).alias("threat_level"), F.lit("sanitized").alias("action_taken")))
    input_blocked = F.col("blocked") & ~F.col("canary_leaked")
    events = F.concat(
        ev("INPUT_BLOCKED", F.col("query"), F.col("threat_level"), "blocked", cats, cond=input_blocked,
           extra=more(scored=True)),
        san,
        ev("PROMPT_OVERRIDE_BLOCKED", F.coalesce(F.col("system_prompt"), F.lit("")), F.lit(P.OVERRIDE_EVENT_THREAT), "blocked",
           cond=F.col("override_blocked")),
        ev("PROMPT_LEAK_BLOCKED", F.col("query"), F.lit(P.LEAK_EVENT_THREAT), "blocked",
           reason="canary token leaked in output", cond=F.col("canary_leaked")),
        ev("OUTPUT_BLOCKED", F.col("query"), F.lit(0.0), "blocked",
           cond=~F.col("canary_leaked") & F.col("output_blocked"), extra=more(issues)),
        ev("OUTPUT_SANITIZED", F.col("query"), F.lit(0.0), "sanitized",
           cond=~F.col("canary_leaked") & ~F.col("output_blocked") & F.col("output_had_issues"), extra=more(issues)))
    return r.select("prompt_id", F.posexplode(events).alias("seq", "e")).select(
        "prompt_id", F.col("seq").cast("bigint").alias("seq"), "e.*")
