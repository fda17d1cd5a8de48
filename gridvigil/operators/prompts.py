"""Prompt tables, answer parsing, request reuse and usage totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridvigil.functions.bounded import broadcast_if_small, materialise
from gridvigil.functions.texts import last_label, with_row_text

# --- fixed values: prompt layout ---
HEADER = "Allowed labels: {labels}\n\nLabeled examples (in-context):\n"
EXAMPLE = "  Input: {row}\n  Output: {label}"
QUESTION = "\n\nClassify this new snapshot. Answer with one label only.\n  Input: {row}\n  Output:"
# --- end of fixed values ---

ROLES = {
    "swat": "You watch the sensors and actuators of a water-treatment plant in six stages.",
    "hai": "You watch a plant testbed with a turbine, a boiler and a water-treatment loop.",
    "wustl": "You watch network flows of an industrial testbed that talks Modbus over TCP.",
}
DEFAULT_ROLE = "You label snapshots of an industrial process. Answer with one label only."


#: buckets of an answer store, and requests asked before their answers are stored
BUCKETS = 64
ASK_ROWS = 100_000


def _fill(template: str, **parts: Column) -> Column:
    """Concatenate a template, with ``{name}`` replaced by a column."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def role_text(dataset: Column, form: Column, roles: dict[str, str] = ROLES) -> Column:
    """Role of the data set for role-instructed prompts, else the default role."""
    pairs = [F.lit(x) for item in roles.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), dataset)
    return F.when(form == "role-instructed-ot", F.coalesce(known, F.lit(DEFAULT_ROLE))).otherwise(
        DEFAULT_ROLE
    )


def example_blocks(
    shots: DataFrame, run: Sequence[str], features: Sequence[str], label: str, form: str, order_col: str
) -> DataFrame:
    """(run, header, examples, labels): the few-shot part of a prompt, once per run.

    The shots are k rows per class, so a group is small by construction.
    """
    shots = with_row_text(shots, features, form, "_row")
    line = _fill(EXAMPLE, row=F.col("_row"), label=F.col(label))
    lines = F.sort_array(F.collect_list(F.struct(order_col, line.alias("line"))))
    names = F.sort_array(F.collect_set(label))
    return shots.groupBy(*run).agg(
        _fill(HEADER, labels=F.array_join(names, " | ")).alias("header"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("examples"),
        names.alias("labels"),
    )


def prompt_table(
    shots: DataFrame,
    queries: DataFrame,
    run: Sequence[str],
    features: Sequence[str],
    label: str,
    form: str,
    order_col: str,
    dataset: str | Column = "",
) -> DataFrame:
    """``system`` and ``prompt`` for every query row; example blocks are broadcast."""
    blocks = broadcast_if_small(
        example_blocks(shots, run, features, label, form, order_col), max_rows=10_000
    )
    rows = with_row_text(queries, features, form, "_row")
    prompt = F.concat("header", "examples", _fill(QUESTION, row=F.col("_row")))
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    return (
        rows.join(blocks, list(run))
        .withColumn("system", role_text(name, F.lit(form)))
        .withColumn("prompt", prompt)
        .drop("_row", "header", "examples", "labels")
    )


def score_distinct(
    requests: DataFrame,
    key: str,
    score: Callable[[DataFrame], DataFrame],
    answer: str = "answer",
    store: str | None = None,
) -> DataFrame:
    """Answer each distinct request once and give the answer to all its rows.

    ``score`` adds column ``answer``. Used where equal requests have equal answers
    (temperature 0). The distinct step combines map-side, so a request that makes up much
    of the table is sent once per task. Answers are kept in the checkpoint folder: a lost
    executor does not ask again. In the join back a hot request is split by adaptive
    execution. With ``store`` (a folder) answers outlive the call; see ``stored_answers``.
    """
    if store is not None:
        once = stored_answers(requests, key, score, answer, store)
    else:
        once = materialise(score(requests.dropDuplicates([key])).select(key, answer))
    return requests.join(once, key)


def stored_answers(
    requests: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], answer: str, store: str
) -> DataFrame:
    """(key, answer) of every distinct request, from the answers in ``store`` and new ones.

    The store is a Parquet table in buckets of the key's hash. Only requests without an answer
    there are asked, ``ASK_ROWS`` or so at a time, and each lot is appended as soon as it is
    answered: a run that fails later loses none of the earlier lots, and a second run asks
    nothing. Two runs at once may answer a request twice; the lesser answer then counts for
    both. A request with a null key or a null answer is asked each time.
    """
    spark = requests.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    kinds = requests.select(key).schema

    def known() -> DataFrame | None:
        # a first run that failed may have left the folder without answers
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_bucket=*/*.parquet")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            return None
        held = spark.read.parquet(store)
        return held.groupBy("_bucket", key).agg(F.min(answer).alias(answer))

    held = known()
    wanted = requests.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", bucket)
    asked = wanted if held is None else wanted.join(held.select("_bucket", key), ["_bucket", key], "left_anti")
    asked = materialise(asked)
    # buckets are filled evenly by the hash, so lots of whole buckets are of even size
    sizes = {r["_bucket"]: r["count"] for r in asked.groupBy("_bucket").count().collect()}
    lots: list[list[int]] = []
    filled = ASK_ROWS
    for number in sorted(sizes):
        if filled + sizes[number] > ASK_ROWS:
            lots.append([])
            filled = 0
        lots[-1].append(number)
        filled += sizes[number]
    for lot in lots:
        new = score(asked.where(F.col("_bucket").isin(lot)).drop("_bucket"))
        new = new.where(F.col(answer).isNotNull()).select(key, answer, bucket)
        new.write.mode("append").partitionBy("_bucket").parquet(store)
    held = known()
    if held is None:
        empty = spark.createDataFrame([], kinds)
        return empty.withColumn(answer, F.lit(None).cast("string"))
    return wanted.select(key, "_bucket").join(held, ["_bucket", key]).select(key, answer)


def usage_totals(calls: DataFrame, run: Sequence[str] = ("model",)) -> DataFrame:
    """Calls, cached calls, errors, tokens and seconds, with averages per call."""
    count = F.count(F.lit(1))
    return calls.groupBy(*run).agg(
        count.alias("calls"),
        F.sum(F.col("cached").cast("long")).alias("cached"),
        F.sum(F.col("failed").cast("long")).alias("errors"),
        F.sum("prompt_tok").alias("prompt_tok"),
        F.sum("completion_tok").alias("completion_tok"),
        F.sum("seconds").alias("wall_s"),
        (F.sum(F.col("prompt_tok") + F.col("completion_tok")) / count).alias("tok_per_call"),
        (F.sum("seconds") / count).alias("s_per_call"),
    )


def cost_preview(
    usage: DataFrame, rows: int, shots: int, measured_shots: int, workers: int = 1
) -> DataFrame:
    """Expected cost and time of ``rows`` calls; prompts grow with the number of shots.

    ``usage`` is ``usage_totals`` with the rates price_in and price_out per million tokens.
    """
    calls = F.greatest(F.lit(1), F.col("calls"))
    scale = max(1.0, shots / max(1, measured_shots))
    prompt = F.col("prompt_tok") / calls * scale * rows
    completion = F.col("completion_tok") / calls * rows
    rate = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    cost = (prompt * rate("price_in") + completion * rate("price_out")) / 1e6
    return usage.withColumns(
        {
            "est_prompt_tok": prompt,
            "est_completion_tok": completion,
            "est_cost_usd": cost,
            "est_wall_s": F.col("wall_s") / calls * rows / max(1, workers),
        }
    )


def retry_unparsed(
    answers: DataFrame,
    keys: Sequence[str],
    labels: Sequence[str],
    again: Callable[[DataFrame], DataFrame],
    text: str = "text",
) -> DataFrame:
    """Rows without a label get one more answer; ``candidates`` holds what was parsed.

    ``again`` adds column ``retry_text``. Only the unparsed rows go through it and no
    join is needed to bring them back.
    """
    parsed = answers.withColumn("_first", last_label(F.col(text), labels))
    good = parsed.where(F.col("_first").isNotNull()).withColumn("candidates", F.array("_first"))
    retried = again(parsed.where(F.col("_first").isNull())).withColumn(
        "candidates",
        F.array(F.lit(None).cast("string"), last_label(F.col("retry_text"), labels)),
    )
    columns = [*keys, "candidates"]
    return good.select(*columns).unionByName(retried.select(*columns))
