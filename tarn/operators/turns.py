"""Conversation corpora: turns, their usage and feedback, signals, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_space

#: Texts that tell of a failed or an aborted tool, and of a user's correction.
FAIL_HINT = r"(?i)(失败|error|aborted|timeout|timed out|traceback|exception|请先登录|413 |502 |503 |target_not_resolved|未获得有效|outside the runtime ceiling|模型服务返回)"
ABORT_HINT = r"(?i)abort|中止|取消|cancelled|canceled"
STRATA = ["neg_feedback", "software_fail", "correction", "pos_feedback", "degraded", "ordinary"]


def number_turns(msgs: DataFrame, conversation: str, order: str, role: str) -> DataFrame:
    """``msgs`` with turn_no: a user message opens a turn up to the next one; what comes before the first goes.
    ``order`` is unique in a conversation. Conversations are the window's key: payload columns are best joined later."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return msgs.withColumn("turn_no", F.sum((F.col(role) == "user").cast("int")).over(w)).where("turn_no > 0")


def slice_turns(msgs: DataFrame, conversation: str = "conversation_id", order: str = "ordinal", role: str = "role", content: str = "content") -> DataFrame:
    """One row per turn: question (its first message), answer (the last non-blank assistant text), first and last
    order, messages, the previous turn's question, and where the next turn starts. Turns with a blank question go,
    after they have served as previous questions."""
    text, blank = F.col(content), F.trim(F.coalesce(F.col(content), F.lit(""))) == ""
    turns = number_turns(msgs, conversation, order, role).groupBy(conversation, "turn_no").agg(
        F.min_by(text, order).alias("question"),
        F.max_by(F.when((F.col(role) == "assistant") & ~blank, text), F.when((F.col(role) == "assistant") & ~blank, F.col(order))).alias("answer"),
        F.min(order).alias("first_order"),
        F.max(order).alias("last_order"),
        F.count("*").alias("n_messages"),
    )
    w = Window.partitionBy(conversation).orderBy("turn_no")
    turns = turns.withColumn("previous_question", F.lag("question").over(w)).withColumn("next_order", F.lead("first_order").over(w))
    return turns.where(F.trim(F.coalesce("question", F.lit(""))) != "")


def previous_of_role(msgs: DataFrame, conversation: str, order: str, role: str, wanted: str, ident: str) -> Column:
    """The id of the latest earlier message of a role in the conversation."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col(role) == wanted, F.col(ident)), ignorenulls=True).over(w)


def anchor_of(conversation: str, order: str, role: str, wanted: str, ident: str) -> Column:
    """The id of the latest earlier message of a role in the conversation, else the message's own."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(F.col(role) == wanted, F.col(ident)), ignorenulls=True).over(w), F.col(ident))


def bind_usage(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """(turn_id, run_id, tier): runs of a turn by run id (1), else by the question's normal form (2), else by a start in
    [start, next_start) of the same conversation (3). A lower tier counts only where no higher one found a run.

    turns: turn_id, conversation_id, run_id, question, start, next_start; runs: run_id, conversation_id, question, start.
    """
    by_id = turns.where("run_id is not null").join(runs.select(F.col("run_id").alias("r")), F.col("run_id") == F.col("r")).select("turn_id", F.col("r").alias("run_id"), F.lit(1).alias("tier"))
    q = turns.select("turn_id", "conversation_id", norm_space(F.col("question")).alias("q")).where("q <> ''")
    by_text = q.join(runs.select("run_id", "conversation_id", norm_space(F.col("question")).alias("q")), ["conversation_id", "q"]).select("turn_id", "run_id", F.lit(2).alias("tier"))
    spans = turns.select("turn_id", "conversation_id", F.col("start").alias("low"), "next_start")
    by_time = spans.join(runs.select("run_id", "conversation_id", "start"), "conversation_id").where("start >= low and (next_start is null or start < next_start)").select("turn_id", "run_id", F.lit(3).alias("tier"))
    every = by_id.unionByName(by_text).unionByName(by_time).distinct()
    return best_tier(every, ["turn_id"])


def best_tier(found: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows of each key's best (lowest) tier."""
    return found.withColumn("_best", F.min("tier").over(Window.partitionBy(*keys))).where("tier = _best").drop("_best")


def bind_any(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows that agree in any of the key pairs, each once: an equi-join for each pair instead of
    one join with OR. Null keys match nothing."""
    out = None
    for a, b in keys:
        x = left.select(left_id, F.col(a).alias("_k")).where("_k is not null")
        y = right.select(right_id, F.col(b).alias("_k")).where("_k is not null")
        one = x.join(y, "_k").select(left_id, right_id)
        out = one if out is None else out.union(one)
    return out.distinct()


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: an ambiguous key resolves to none."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def compact_messages(msgs: DataFrame, keys: list[str], order: str, content: str, budget: int = 24_000, field: int = 4_000, cut: int = 200) -> DataFrame:
    """``content`` cut to ``field``; after a turn's messages have used up the budget, to ``cut``. What a message uses
    is its size before the second cut."""
    used = F.length(F.substring(F.coalesce(F.col(content), F.lit("")), 1, field))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_used").over(w), F.lit(0))
    text = F.substring(F.coalesce(F.col(content), F.lit("")), 1, F.lit(field))
    out = msgs.withColumn("_used", used).withColumn("_before", before)
    return out.withColumn("compact", F.when(F.col("_before") >= budget, F.substring(text, 1, cut)).otherwise(text)).drop("_used", "_before")


def turn_signals(msgs: DataFrame, keys: list[str], tool: str, result: str, content: str) -> DataFrame:
    """Per turn: tool messages that went well and that failed, counts by tool, the level."""
    blob = F.concat_ws("\n", result, content)
    named = F.trim(F.coalesce(F.col(tool), F.lit(""))) != ""
    bad = named & blob.rlike(FAIL_HINT)
    per = msgs.groupBy(*keys).agg(F.sum((named & ~bad).cast("long")).alias("tool_ok"), F.sum(bad.cast("long")).alias("tool_fail"))
    counts = msgs.where(named).groupBy(*keys, tool).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tool, "n")))).alias("tool_counts"))
    return per.join(counts, keys, "left").withColumn("level", F.when(F.col("tool_fail") > 0, "degraded").otherwise("clean"))


def run_level(statuses: Column, errors: Column) -> Column:
    """hard_fail if a run failed or was aborted, degraded if it timed out, else clean. Both are arrays."""
    failed = F.array_contains(statuses, "failed")
    aborted = F.exists(errors, lambda e: e.rlike(ABORT_HINT))
    late = F.exists(errors, lambda e: F.lower(e).contains("timeout") | F.lower(e).contains("timed out"))
    return F.when(F.coalesce(failed | aborted, F.lit(False)), "hard_fail").when(F.coalesce(late, F.lit(False)), "degraded").otherwise("clean")


def turn_report(turns: DataFrame, msgs: DataFrame, runs: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """One row per turn of ``turns`` (key): what its messages, runs and calls say, each counted by itself before the join.

    msgs: key, ord, tool, result, content; runs: key, ord, status, error, duration_ms; calls: key, ord, purpose, status,
    input_tokens, output_tokens, total_tokens. A message with a tool name went well or failed by its result and content.
    duration_ms is null if 0; tokens_by_purpose and tool_counts are maps; run_error is the first error (500 characters),
    run_errors the first 6 (400 each), tool_errors the first 8 (240 each). kinds, in this order: usage_run_failed, aborted,
    timeout, tool_error, auth_required. level: unobserved without messages and runs, else hard_fail (a run failed or was
    aborted), degraded (any other kind) or clean. Turns without any rows have zeros and empty lists.
    """
    first = lambda order, text, n, size: F.transform(F.slice(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), F.substring(text, 1, size).alias("x"))))), 1, n), lambda e: e["x"])
    name = F.trim(F.coalesce("tool", F.lit("")))
    blob = F.concat_ws("\n", F.when(F.col("result") != "", F.col("result")), F.when(F.col("content") != "", F.col("content")))
    m = msgs.select(key, "ord", name.alias("_name"), blob.alias("_blob"), F.when(F.col("result") != "", F.col("result")).alias("_result"))
    m = m.withColumn("_bad", (F.col("_name") != "") & F.col("_blob").rlike(FAIL_HINT))
    tool_error = F.when(F.col("_bad"), F.concat("_name", F.lit(": "), F.substring(F.coalesce("_result", "_blob"), 1, 240)))
    said = m.groupBy(key).agg(F.count("*").alias("_messages"), F.count_if((F.col("_name") != "") & ~F.col("_bad")).alias("tool_ok"), F.count_if("_bad").alias("tool_fail"), first(F.col("ord"), tool_error, 8, 500).alias("tool_errors"))
    pairs = lambda df, name, value: df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))))
    tools = pairs(m.where("_name <> ''").groupBy(key, "_name").agg(F.count("*").alias("n")), "_name", "n").toDF(key, "tool_counts")
    error = F.when(F.col("error") != "", F.col("error"))
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))
    lower = F.lower("error")
    ran = runs.groupBy(key).agg(
        F.count("*").alias("_runs"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "", F.col("status")))), ",").alias("run_status"),
        F.substring(F.min_by(error, F.when(error.isNotNull(), F.col("ord"))), 1, 500).alias("run_error"), first(F.col("ord"), error, 6, 400).alias("run_errors"),
        any_of(F.col("status") == "failed").alias("_failed"), any_of(error.rlike(ABORT_HINT)).alias("aborted"), any_of(lower.contains("timeout") | lower.contains("timed out")).alias("_late"), any_of(error.contains("请先登录")).alias("_auth"),
    )
    c = calls.withColumn("purpose", F.when(F.col("purpose") != "", F.col("purpose")))
    number = lambda x: F.sum(F.coalesce(x, F.lit(0)))
    spent = c.groupBy(key).agg(*[number(x).alias(x) for x in ("input_tokens", "output_tokens", "total_tokens")], first(F.col("ord"), F.when(F.col("status").isin("failed", "stopped"), F.coalesce("purpose", F.lit(""))), 1 << 30, 1 << 30).alias("failed_call_purposes"))
    by = pairs(c.groupBy(key, F.coalesce("purpose", F.lit("unknown")).alias("_purpose")).agg(number("total_tokens").alias("n")), "_purpose", "n").toDF(key, "tokens_by_purpose")
    out = turns.select(key).distinct()
    for part in (said, tools, ran, spent, by):
        out = out.join(part, key, "left")
    zero = ["_messages", "_runs", "tool_ok", "tool_fail", "input_tokens", "output_tokens", "total_tokens"]
    out = out.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in zero}).withColumns({x: F.coalesce(x, F.lit(False)) for x in ("_failed", "aborted", "_late", "_auth")})
    out = out.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in ("tool_errors", "run_errors", "failed_call_purposes")}).withColumns({x: F.coalesce(x, F.create_map().cast("map<string,bigint>")) for x in ("tool_counts", "tokens_by_purpose")})
    kinds = F.array_compact(F.array(F.when(F.col("_failed"), "usage_run_failed"), F.when(F.col("aborted"), "aborted"), F.when(F.col("_late"), "timeout"), F.when(F.col("tool_fail") > 0, "tool_error"), F.when(F.col("_auth"), "auth_required")))
    out = out.withColumn("kinds", kinds)
    level = F.when((F.col("_runs") == 0) & (F.col("_messages") == 0), "unobserved").when(F.col("_failed") | F.col("aborted"), "hard_fail").when(F.size("kinds") > 0, "degraded").otherwise("clean")
    out = out.withColumn("level", level).withColumn("duration_ms", F.when(F.col("duration_ms") != 0, F.col("duration_ms"))).withColumn("run_status", F.when(F.col("run_status") != "", F.col("run_status")))
    return out.withColumnRenamed("_failed", "hard_fail").drop("_messages", "_runs", "_late", "_auth")


def stratified_sample(cases: DataFrame, case: str, stratum: str, order: str, n: int, strata: list[str] | None = None) -> DataFrame:
    """One case from each stratum in turn, in the order of the strata, until there are ``n``; a repeated case counts
    once, where it comes first. Only the first ``n`` of a stratum are ranked together."""
    strata = STRATA if strata is None else strata
    rank = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(stratum))
    once = latest_per_key(cases.withColumn("_s", rank).where("_s > 0"), [case], F.col("_s"), F.col(order))
    inside = once.withColumn("_part", F.pmod(F.xxhash64(case), F.lit(64)))
    first = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_part").orderBy(order))).where(F.col("_r") <= n)
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(order)))
    return ranked.orderBy("_r", "_s").limit(n).drop("_s", "_part", "_r")


def claim_wave(cases: DataFrame, judged: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first case of each key that is not judged yet, at most ``n`` in order."""
    return latest_per_key(cases.join(judged, key, "left_anti"), [key], F.col(order)).orderBy(order).limit(n)


def top_attachments(df: DataFrame, turn: str, path: str, rank: str, n: int) -> DataFrame:
    """Per turn the ``n`` best paths (each at its best rank, then by name) as an array, and how many were left out."""
    best = df.groupBy(turn, path).agg(F.min(rank).alias("_rank"))
    w = Window.partitionBy(turn).orderBy("_rank", path)
    ranked = best.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(turn).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= n, F.struct("_rn", path)))), lambda x: x[path]).alias("paths"),
        F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"),
    )


def role_profile(msgs: DataFrame, role: str, fields: dict[str, str]) -> DataFrame:
    """Per role: messages, and how many have each field filled."""
    filled = [F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(name) for name, c in fields.items()]
    return msgs.groupBy(role).agg(F.count("*").alias("messages"), *filled)


def duplicate_content(objs: DataFrame, digest: str) -> DataFrame:
    """Digests that occur more than once, and how many objects could go."""
    return objs.groupBy(digest).agg(F.count("*").alias("copies")).where("copies > 1").withColumn("extra", F.col("copies") - 1)


def usage_only_cases(users: DataFrame, archived: DataFrame, runs: DataFrame, user: str, question: str, answer: str, run: str) -> DataFrame:
    """Runs of users without an archived conversation, as pseudo-turns of a user and an assistant message."""
    alone = users.join(archived, user, "left_anti").join(runs, user)
    pair = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("user").alias("role"), F.col(question).alias("content")), F.struct(F.lit(1).alias("ordinal"), F.lit("assistant").alias("role"), F.col(answer).alias("content")))
    return alone.select(user, run, F.explode(pair).alias("m")).select(user, run, "m.*")


def sync_messages(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, fields: list[str], synced: DataFrame | None = None) -> DataFrame:
    """The stored messages (keys: conversation, then the source's key; fields; is_deleted) after a sync.

    All messages of the synced conversations are marked deleted, then each incoming one takes the place of its key, or is
    added, and counts as not deleted; of several with one key the last by ``order`` stays (order must be a field).
    Conversations that aren't synced stay as they are. synced: the conversations, if some of them come without messages."""
    conversation = keys[0]
    latest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_new"))
    touched = incoming.select(conversation) if synced is None else incoming.select(conversation).union(synced.select(conversation))
    old = current.select(*keys, F.struct(*fields).alias("_old"), F.col("is_deleted").alias("_gone"))
    old = old.join(touched.distinct().withColumn("_touched", F.lit(True)), conversation, "left")
    both = old.join(latest, keys, "full")
    gone = F.when(F.col("_new").isNotNull(), False).when(F.col("_touched"), True).otherwise(F.col("_gone"))
    return both.select(*keys, F.coalesce("_new", "_old").alias("_row"), gone.alias("is_deleted")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in fields], "is_deleted")
