"""Registered queries for prompts, answers and request bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.functions import texts
from gridvigil.functions.bounded import broadcast_if_small
from gridvigil.functions.statistics import request_key
from gridvigil.operators import ensembles, prompts, sampling
from gridvigil.plans.detections import rounded
from gridvigil.session import scratch_path
from gridvigil.plans.registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


def flows(spark, sf):
    rows = table(spark, sf, "lineitem")
    # narrow rows are dealt out evenly before they grow into texts
    return rows.select(*_KEYS, *FEATURES, "l_linestatus", "l_returnflag").repartition(*_KEYS)


@query(
    "row_to_raw_json",
    f"SELECT {', '.join(_KEYS)}, CAST(to_json(struct_pack({', '.join(f'{f} := {f}' for f in FEATURES)})) AS VARCHAR) AS row_text FROM lineitem",
)
def row_to_raw_json(spark, sf):
    return flows(spark, sf).select(*_KEYS, texts.raw_json(FEATURES).alias("row_text"))


@query(
    "row_to_typed_json",
    f"""SELECT {', '.join(_KEYS)}, CAST(to_json(struct_pack(load := round(l_extendedprice / 7, 4), l_tax := round(l_tax, 4),
      l_linenumber := l_linenumber, l_linestatus := l_linestatus)) AS VARCHAR) AS row_text FROM lineitem""",
)
def row_to_typed_json(spark, sf):
    rows = flows(spark, sf).withColumn("load", F.col("l_extendedprice") / 7)
    shown = texts.typed_json(rows, ["load", "l_tax", "l_linenumber", "l_linestatus"])
    return rows.select(*_KEYS, shown.alias("row_text"))


@query(
    "row_to_narrative",
    f"""SELECT {', '.join(_KEYS)}, printf('l_quantity = %.4g; l_extendedprice = %.4g; small = %.4g; l_linenumber = %d',
      l_quantity, l_extendedprice, l_tax / 900, l_linenumber) AS row_text FROM lineitem""",
)
def row_to_narrative(spark, sf):
    rows = flows(spark, sf).withColumn("small", F.col("l_tax") / 900)
    names = ["l_quantity", "l_extendedprice", "small", "l_linenumber"]
    return texts.with_narrative(rows, names, "row_text").select(*_KEYS, "row_text")


_SHOT_SQL = """ev AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END AS label FROM events),
  j AS (SELECT *, CAST(to_json(struct_pack(value := round(value, 4), user_id := user_id)) AS VARCHAR) AS row_text FROM ev),
  s AS (SELECT j.*, seed, md5(concat(seed, ':', event_id)) AS h FROM j, (VALUES (42), (43)) v(seed)),
  r AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY h) AS rn FROM s),
  b AS (SELECT seed, 'Allowed labels: Attack | Normal' || chr(10) || chr(10) || 'Labeled examples (in-context):' || chr(10)
      || string_agg('  Input: ' || row_text || chr(10) || '  Output: ' || label, chr(10) ORDER BY h) AS head
    FROM r WHERE rn <= 5 GROUP BY seed)"""


@query(
    "prompt_assembly",
    f"""WITH {_SHOT_SQL} SELECT r.seed, event_id, head || chr(10) || chr(10) || 'Classify this new snapshot. Answer with one label only.'
      || chr(10) || '  Input: ' || row_text || chr(10) || '  Output:' AS prompt
    FROM r JOIN b USING (seed) WHERE rn > 5""",
)
def prompt_assembly(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "value",
        F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("label"),
    )
    seeds = [42, 43]
    shots = sampling.per_class(events, "label", 5, ["event_id"], seeds)
    rest = sampling.with_seeds(events, seeds, ["event_id"]).join(
        broadcast_if_small(shots.select("seed", "event_id")), ["seed", "event_id"], "left_anti"
    )
    made = prompts.prompt_table(
        shots, rest, ["seed"], ["value", "user_id"], "label", "typed-json", "digest", "swat"
    )
    return made.select("seed", "event_id", "prompt")


@query(
    "role_text",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '{prompts.DEFAULT_ROLE}'
      WHEN o_orderstatus = 'F' THEN '{prompts.ROLES["swat"]}' WHEN o_orderstatus = 'O' THEN '{prompts.ROLES["hai"]}'
      ELSE '{prompts.DEFAULT_ROLE}' END AS role FROM orders""",
)
def role_text(spark, sf):
    dataset = (
        F.when(F.col("o_orderstatus") == "F", "swat")
        .when(F.col("o_orderstatus") == "O", "hai")
        .otherwise("unknown")
    )
    form = F.when(F.col("o_custkey") % 2 == 0, "raw-json").otherwise("role-instructed-ot")
    return table(spark, sf, "orders").select(
        "o_orderkey", prompts.role_text(dataset, form).alias("role")
    )


ANSWERS = [
    "Every value lies in its usual band, so: Normal",
    "Pump and valve disagree. Verdict: Attack",
    "I would call this an Attack, although the level is Normal for the season. Attack",
    "Label = Normal, confidence high.",
    "There is too little to go on.",
    "First thought normal, on a second look ATTACK",
    "Counter_Normal belongs to Attackers, not to us",
    "Normal",
]


def answers(spark, sf):
    """Every message with a classifier's closing words."""
    ending = F.element_at(
        F.array(*[F.lit(a) for a in ANSWERS]),
        ((F.col("conv_id") * 3 + F.col("turn")) % len(ANSWERS) + 1).cast("int"),
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", F.lit("\n"), ending).alias("text")
    )


_ANSWER_LIST = ", ".join(f"'{a}'" for a in ANSWERS)
_ANSWER_SQL = f"""ans AS (SELECT conv_id, turn, role, text || chr(10) || list_extract([{_ANSWER_LIST}],
  CAST((conv_id * 3 + turn) % {len(ANSWERS)} + 1 AS INT)) AS text FROM conversations)"""


def _hit_sql(label: str) -> str:
    pattern = f"(?is)^((?:.*[^A-Za-z0-9_])?){label}(?:[^A-Za-z0-9_].*)?$"
    return f"""CASE WHEN regexp_matches(text, '{pattern}') THEN length(regexp_extract(text, '{pattern}', 1)) ELSE -1 END"""


_LAST_SQL = f"""{_ANSWER_SQL}, pos AS (SELECT *, {_hit_sql("Normal")} AS pn, {_hit_sql("Attack")} AS pa FROM ans),
lab AS (SELECT *, CASE WHEN pn < 0 AND pa < 0 THEN NULL WHEN pn > pa THEN 'Normal' ELSE 'Attack' END AS label FROM pos)"""


@query("label_last_hit", f"WITH {_LAST_SQL} SELECT conv_id, turn, label FROM lab")
def label_last_hit(spark, sf):
    found = texts.last_label(F.col("text"), ["Normal", "Attack"])
    return answers(spark, sf).select("conv_id", "turn", found.alias("label"))


@query(
    "label_longest_first",
    f"""WITH {_ANSWER_SQL} SELECT conv_id, turn, CASE
      WHEN regexp_matches(text, '(?is)(^|[^A-Za-z0-9_])Normal([^A-Za-z0-9_]|$)') THEN 'Normal'
      WHEN regexp_matches(text, '(?is)(^|[^A-Za-z0-9_])Attack([^A-Za-z0-9_]|$)') THEN 'Attack'
      WHEN contains(lower(text), 'normal') THEN 'Normal' WHEN contains(lower(text), 'attack') THEN 'Attack' END AS label
    FROM ans""",
)
def label_longest_first(spark, sf):
    found = texts.first_label(F.col("text"), ["Normal", "Attack"])
    return answers(spark, sf).select("conv_id", "turn", found.alias("label"))


@query(
    "conversation_vote",
    f"""WITH {_LAST_SQL}, b AS (SELECT conv_id, label, count(*) AS votes, min(turn) AS seen FROM lab
      WHERE label IS NOT NULL GROUP BY ALL)
    SELECT conv_id, label, votes FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, seen) = 1""",
)
def conversation_vote(spark, sf):
    found = texts.last_label(F.col("text"), ["Normal", "Attack"])
    parsed = answers(spark, sf).withColumn("label", found)
    return ensembles.vote_by_key(parsed, ["conv_id"], "label", "turn")


@query(
    "request_reuse",
    """SELECT l_orderkey, l_partkey, l_suppkey, length(concat_ws('|', round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_linestatus))::INTEGER AS answer
    FROM lineitem""",
)
def request_reuse(spark, sf):
    """Requests repeat heavily: every row with equal fields shares one answer."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    rows = table(spark, sf, "lineitem").withColumn(
        "prompt", F.concat_ws("|", cents("l_discount"), cents("l_tax"), "l_linestatus")
    )
    rows = rows.select(*_KEYS, "prompt").withColumn("request", request_key("prompt"))
    scored = prompts.score_distinct(
        rows, "request", lambda once: once.withColumn("answer", F.length("prompt"))
    )
    return scored.select(*_KEYS, "answer")


@query(
    "stored_answers",
    """WITH p AS (SELECT conv_id, turn, role || ':' || length(text) % 50 AS prompt FROM conversations),
    old AS (SELECT DISTINCT prompt FROM p WHERE conv_id % 3 = 0)
    SELECT conv_id, turn, prompt || CASE WHEN prompt IN (SELECT prompt FROM old) THEN '/first' ELSE '/second' END AS answer FROM p""",
)
def stored_answers(spark, sf):
    """The second run of a sweep asks only what the first one did not."""
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws(":", "role", (F.length("text") % 50).cast("string")).alias("prompt")
    )
    rows = rows.withColumn("request", request_key("prompt"))
    store = scratch_path(spark, "answers")

    def run(asked, name):
        answer = lambda once: once.withColumn("answer", F.concat("prompt", F.lit(f"/{name}")))
        return prompts.score_distinct(asked, "request", answer, store=store)

    run(rows.where("conv_id % 3 = 0"), "first")
    return run(rows, "second").select("conv_id", "turn", "answer")


_CALLS_SQL = """calls AS (SELECT role AS model, turn > 3 AS cached, length(text) < 60 AS failed,
  length(text) // 4 AS prompt_tok, turn + 1 AS completion_tok, (turn * 0.25)::DOUBLE AS seconds FROM conversations),
usage AS (SELECT model, count(*) AS calls, sum(cached::INT)::BIGINT AS cached, sum(failed::INT)::BIGINT AS errors,
  sum(prompt_tok)::BIGINT AS prompt_tok, sum(completion_tok)::BIGINT AS completion_tok, sum(seconds) AS wall_s,
  round(sum(prompt_tok + completion_tok) / count(*), 6) AS tok_per_call, round(sum(seconds) / count(*), 6) AS s_per_call
  FROM calls GROUP BY model)"""


def usage(spark, sf):
    calls = table(spark, sf, "conversations").select(
        F.col("role").alias("model"),
        (F.col("turn") > 3).alias("cached"),
        (F.length("text") < 60).alias("failed"),
        F.expr("length(text) div 4").alias("prompt_tok"),
        (F.col("turn") + 1).alias("completion_tok"),
        (F.col("turn") * 0.25).alias("seconds"),
    )
    return prompts.usage_totals(calls)


@query("usage_totals", f"WITH {_CALLS_SQL} SELECT * FROM usage")
def usage_totals(spark, sf):
    return rounded(usage(spark, sf), ["tok_per_call", "s_per_call"], 6)


@query(
    "cost_preview",
    f"""WITH {_CALLS_SQL} SELECT model, round(prompt_tok / calls * 2.5 * 2000, 4) AS est_prompt_tok,
      round(completion_tok / calls * 2000, 4) AS est_completion_tok,
      round((prompt_tok / calls * 2.5 * 2000 * CASE model WHEN 'user' THEN 0.3 WHEN 'assistant' THEN 1.0 ELSE 0 END
        + completion_tok / calls * 2000 * CASE model WHEN 'user' THEN 0.9 WHEN 'assistant' THEN 3.0 ELSE 0 END) / 1e6, 9) AS est_cost_usd,
      round(wall_s / calls * 2000 / 8, 6) AS est_wall_s FROM usage""",
)
def cost_preview(spark, sf):
    rates = spark.createDataFrame(
        [("user", 0.3, 0.9), ("assistant", 1.0, 3.0)], "model string, price_in double, price_out double"
    )
    priced = ensembles.rate_lookup(usage(spark, sf), rates)
    made = prompts.cost_preview(priced, rows=2000, shots=25, measured_shots=10, workers=8)
    made = rounded(made, ["est_prompt_tok", "est_completion_tok"], 4)
    made = rounded(rounded(made, ["est_cost_usd"], 9), ["est_wall_s"], 6)
    return made.select("model", "est_prompt_tok", "est_completion_tok", "est_cost_usd", "est_wall_s")


@query(
    "retry_unparsed",
    f"""WITH {_LAST_SQL} SELECT conv_id, turn, CASE WHEN label IS NULL THEN 2 ELSE 1 END AS n_candidates,
      coalesce(label, CASE WHEN turn % 2 = 0 THEN 'Attack' END) AS label FROM lab""",
)
def retry_unparsed(spark, sf):
    def again(rows):
        text = F.when(F.col("turn") % 2 == 0, "Answer: Attack").otherwise("no idea")
        return rows.withColumn("retry_text", text)

    made = prompts.retry_unparsed(
        answers(spark, sf), ["conv_id", "turn"], ["Normal", "Attack"], again
    )
    return made.select(
        "conv_id",
        "turn",
        F.size("candidates").alias("n_candidates"),
        ensembles.majority_vote("candidates").alias("label"),
    )
